"""Catalogue: moving averages, recursive filters and rolling statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.ewm import ewm, span
from ..operators import technical as t
from ..sources.bars import interval_bars
from . import views as v
from .catalog_sources import ticks
from .registry import CATALOG, query, sql_view


def win(n):
    return f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"


def q_full(agg, x, n, sample=None):
    return f"CASE WHEN count({x}) OVER {win(n)} = {n} THEN {agg}({x}) OVER {win(n)} END"


def q_sma(x, n):
    return q_full("avg", x, n)


def q_ewm(x, a):
    """Direct recursion over the non-null prefix."""
    return (
        f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date), "
        f"lambda y, v: {a!r}::DOUBLE * v + (1 - {a!r}::DOUBLE) * y)"
    )


LAG = "OVER (PARTITION BY symbol ORDER BY date)"


@query(
    "sma",
    "symbol, date:d, sma20:4, sma50:4, sma200:4",
    f"SELECT symbol, date, {q_sma('close', 20)} AS sma20, {q_sma('close', 50)} AS sma50, {q_sma('close', 200)} AS sma200 FROM bars",
)
def _(spark, sf):
    return v.bars(spark, sf).withColumns({f"sma{n}": w.sma("close", n) for n in (20, 50, 200)})


@query(
    "ewm_span",
    "symbol, date:d, ema12:4, ema50:4, half:4",
    f"""SELECT symbol, date, {q_ewm('close', span(12))} AS ema12, {q_ewm('close', span(50))} AS ema50,
  {q_ewm('close', 0.5)} AS half FROM bars""",
)
def _(spark, sf):
    return ewm(
        v.bars(spark, sf),
        {"ema12": ("close", span(12)), "ema50": ("close", span(50)), "half": ("close", 0.5)},
    )


@query(
    "ewm_with_gaps",
    "symbol, date:d, y:4",
    """SELECT symbol, date, list_reduce(list_transform(list(struct_pack(rn := rn, x := x)) FILTER (x IS NOT NULL)
    OVER (PARTITION BY symbol ORDER BY date), lambda s: struct_pack(rn := s.rn, y := s.x)),
  lambda a, b: struct_pack(rn := b.rn, y := (pow(0.9::DOUBLE, b.rn - a.rn) * a.y + 0.1::DOUBLE * b.y)
    / (pow(0.9::DOUBLE, b.rn - a.rn) + 0.1::DOUBLE))).y AS y
FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
  CASE WHEN volume >= 150 THEN close END AS x FROM bars)""",
)
def _(spark, sf):
    holes = v.bars(spark, sf).withColumn("x", F.when(F.col("volume") >= 150, F.col("close")))
    return ewm(holes, {"y": ("x", 0.1)}, gaps=True)


sql_view(
    "q_macd",
    f"""SELECT symbol, date, close, macd, {q_ewm('macd', span(9))} AS macd_signal FROM (
  SELECT symbol, date, close, {q_ewm('close', span(12))} - {q_ewm('close', span(26))} AS macd FROM bars)""",
)


@query(
    "macd",
    "symbol, date:d, macd:4, macd_signal:4, macd_hist:4",
    "SELECT *, macd - macd_signal AS macd_hist FROM q_macd",
)
def _(spark, sf):
    return t.macd(v.bars(spark, sf))


sql_view(
    "q_rsi",
    f"""SELECT symbol, date, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) END AS rsi FROM (
  SELECT symbol, date, {q_ewm('up', 1 / 14)} AS g, {q_ewm('dn', 1 / 14)} AS l FROM (
    SELECT symbol, date, CASE WHEN d > 0 THEN d ELSE 0.0::DOUBLE END AS up, CASE WHEN d < 0 THEN -d ELSE 0.0::DOUBLE END AS dn
    FROM (SELECT symbol, date, close - lag(close) {LAG} AS d FROM bars)))""",
)


@query("rsi", "symbol, date:d, rsi:6", "SELECT * FROM q_rsi")
def _(spark, sf):
    return t.rsi(v.bars(spark, sf))


@query(
    "rsi_simple",
    "symbol, date:d, rsi_simple:6",
    f"""SELECT symbol, date, CASE WHEN g IS NULL THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi_simple
FROM (SELECT symbol, date, {q_sma('up', 14)} AS g, {q_sma('dn', 14)} AS l FROM (
  SELECT symbol, date, CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0::DOUBLE END AS up,
    CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0::DOUBLE END AS dn
  FROM (SELECT symbol, date, close - lag(close) {LAG} AS d FROM bars)))""",
)
def _(spark, sf):
    return t.rsi_simple(v.bars(spark, sf))


def q_seed(x, n):
    return f"""CASE WHEN count({x}) OVER (PARTITION BY symbol ORDER BY date) = {n}
  THEN avg({x}) OVER (PARTITION BY symbol ORDER BY date)
  WHEN count({x}) OVER (PARTITION BY symbol ORDER BY date) > {n} THEN {x} END"""


@query(
    "macd_chart",
    "symbol, date:d, macd_line:4, macd_signal_line:4, macd_histogram:4",
    f"""SELECT symbol, date, line AS macd_line, sig AS macd_signal_line, line - sig AS macd_histogram FROM (
  SELECT *, {q_ewm('s', span(9))} AS sig FROM (SELECT *, {q_seed('line', 9)} AS s FROM (
    SELECT symbol, date, {q_ewm('f', span(12))} - {q_ewm('g', span(26))} AS line FROM (
      SELECT symbol, date, {q_seed('close', 12)} AS f, {q_seed('close', 26)} AS g FROM bars))))""",
)
def _(spark, sf):
    return t.macd_chart(v.bars(spark, sf))


@query(
    "ema_seeded",
    "symbol, date:d, ema12:4",
    f"SELECT symbol, date, {q_ewm('f', span(12))} AS ema12 FROM (SELECT symbol, date, {q_seed('close', 12)} AS f FROM bars)",
)
def _(spark, sf):
    return t.ema_seeded(v.bars(spark, sf), "close", 12, "ema12")


sql_view(
    "q_moves",
    f"""SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN up > down AND up > 0 THEN up ELSE 0.0::DOUBLE END AS pdm,
  CASE WHEN down > up AND down > 0 THEN down ELSE 0.0::DOUBLE END AS mdm
FROM (SELECT *, lag(close) {LAG} AS pc, high - lag(high) {LAG} AS up, -(low - lag(low) {LAG}) AS down FROM bars)""",
)


@query(
    "atr",
    "symbol, date:d, true_range:4, atr:4, atr_pct:6",
    f"""SELECT symbol, date, tr AS true_range, atr, atr / close AS atr_pct
FROM (SELECT *, {q_ewm('tr', 1 / 14)} AS atr FROM q_moves)""",
)
def _(spark, sf):
    return t.atr(v.bars(spark, sf))


@query(
    "adx",
    "symbol, date:d, plus_di:6, minus_di:6, adx:6",
    f"""SELECT symbol, date, pdi AS plus_di, mdi AS minus_di,
  list_reduce(list(struct_pack(rn := rn, y := dx)) FILTER (dx IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date),
  lambda a, b: struct_pack(rn := b.rn, y := (pow(1 - 1 / 14.0::DOUBLE, b.rn - a.rn) * a.y + 1 / 14.0::DOUBLE * b.y)
    / (pow(1 - 1 / 14.0::DOUBLE, b.rn - a.rn) + 1 / 14.0::DOUBLE))).y AS adx FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
    CASE WHEN pdi + mdi <> 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM (
    SELECT symbol, date, 100 * {q_ewm('pdm', 1 / 14)} / nullif({q_ewm('tr', 1 / 14)}, 0) AS pdi,
      100 * {q_ewm('mdm', 1 / 14)} / nullif({q_ewm('tr', 1 / 14)}, 0) AS mdi FROM q_moves))""",
)
def _(spark, sf):
    return t.adx(v.bars(spark, sf))


@query(
    "heikin_ashi",
    "symbol, date:d, ha_close:4, ha_open:4, ha_high:4, ha_low:4, ha_body_pct:6, ha_direction:0",
    f"""SELECT *, greatest(high, ha_open, ha_close) AS ha_high, least(low, ha_open, ha_close) AS ha_low,
  (ha_close - ha_open) / nullif(ha_open, 0) AS ha_body_pct, sign(ha_close - ha_open) AS ha_direction FROM (
  SELECT symbol, date, high, low, ha_close, coalesce(lag(m) {LAG}, ha_close) AS ha_open FROM (
    SELECT *, {q_ewm('ha_close', 0.5)} AS m FROM (SELECT *, (open + high + low + close) / 4 AS ha_close FROM bars)))""",
)
def _(spark, sf):
    return t.heikin_ashi(v.bars(spark, sf))


@query(
    "obv",
    "symbol, date:d, obv:2, obv_slope:6",
    f"""SELECT *, obv / nullif(lag(obv, 20) {LAG}, 0) - 1 AS obv_slope FROM (
  SELECT symbol, date, sum(f) {LAG} AS obv FROM (
    SELECT symbol, date, coalesce(sign(close - lag(close) {LAG}), 0) * volume AS f FROM bars))""",
)
def _(spark, sf):
    return t.obv(v.bars(spark, sf))


@query(
    "session_vwap",
    "symbol, time:t, vwap:2",
    """SELECT symbol, time, sum(tp * volume) OVER q / sum(volume) OVER q AS vwap FROM (
  SELECT *, (high + low + close) / 3 AS tp FROM (SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS time,
    max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM ticks GROUP BY 1, 2)) WINDOW q AS (PARTITION BY symbol, CAST(time AS DATE) ORDER BY time)""",
)
def _(spark, sf):
    intraday = interval_bars(ticks(spark, sf), "5m", "price", F.lit(1.0), ("ts", "event_id"))
    return t.session_vwap(intraday.withColumn("session", F.col("time").cast("date")))


@query(
    "bollinger",
    "symbol, date:d, bb_mid:4, bb_upper:4, bb_lower:4, bb_width:6, bb_pctb:6",
    f"""SELECT symbol, date, m AS bb_mid, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, 4 * s / m AS bb_width,
  (close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0) AS bb_pctb
FROM (SELECT *, {q_sma('close', 20)} AS m, {q_full('stddev_pop', 'close', 20)} AS s FROM bars)""",
)
def _(spark, sf):
    return t.bollinger(v.bars(spark, sf))


@query(
    "cci",
    "symbol, date:d, cci:6",
    f"""SELECT symbol, date, (tp - m) / nullif(0.015::DOUBLE * md, 0) AS cci FROM (
  SELECT symbol, date, tp, m, CASE WHEN m IS NOT NULL THEN list_avg(list_transform(l, lambda x: abs(x - m))) END AS md FROM (
    SELECT symbol, date, tp, {q_sma('tp', 20)} AS m, list(tp) OVER {win(20)} AS l
    FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars)))""",
)
def _(spark, sf):
    return t.cci(v.bars(spark, sf))


@query(
    "mfi",
    "symbol, date:d, mfi:6",
    f"""SELECT symbol, date, CASE WHEN n > 0 THEN 100 - 100 / (1 + p / n) ELSE 100 END AS mfi FROM (
  SELECT symbol, date, {q_full('sum', 'i', 14)} AS p, {q_full('sum', 'o', 14)} AS n FROM (
    SELECT symbol, date, CASE WHEN tp > ptp THEN tp * volume ELSE 0.0::DOUBLE END AS i,
      CASE WHEN tp < ptp THEN tp * volume ELSE 0.0::DOUBLE END AS o
    FROM (SELECT *, lag(tp) {LAG} AS ptp FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars))))""",
)
def _(spark, sf):
    return t.mfi(v.bars(spark, sf))


@query(
    "returns_and_momentum",
    "symbol, date:d, ret_1d:6, ret_20d:6, ret_120d:6, roc_5d:4, mom_10d:4",
    f"""SELECT symbol, date, close / lag(close) {LAG} - 1 AS ret_1d, close / lag(close, 20) {LAG} - 1 AS ret_20d,
  close / lag(close, 120) {LAG} - 1 AS ret_120d, (close / lag(close, 5) {LAG} - 1) * 100 AS roc_5d,
  close - lag(close, 10) {LAG} AS mom_10d FROM bars""",
)
def _(spark, sf):
    return v.bars(spark, sf).transform(t.returns).transform(t.rate_of_change).transform(t.momentum)


sql_view(
    "q_ma",
    f"SELECT *, {q_sma('close', 20)} AS m20, {q_sma('close', 50)} AS m50, {q_sma('close', 200)} AS m200 FROM bars",
)


@query(
    "moving_average_block",
    """symbol, date:d, dist_sma20:6, dist_sma200:6, ma_slope_sma50_5d:6, ma_cross_20_50:0, ma_cross_20_200:0,
    ma_spread_20_50:6""",
    f"""SELECT symbol, date, close / m20 - 1 AS dist_sma20, close / m200 - 1 AS dist_sma200,
  (m50 - lag(m50, 5) {LAG}) / lag(m50, 5) {LAG} AS ma_slope_sma50_5d,
  CASE WHEN m20 > m50 AND lag(m20) {LAG} <= lag(m50) {LAG} THEN 1 WHEN m20 < m50 AND lag(m20) {LAG} >= lag(m50) {LAG} THEN -1 ELSE 0 END AS ma_cross_20_50,
  CASE WHEN m20 > m200 AND lag(m20) {LAG} <= lag(m200) {LAG} THEN 1 WHEN m20 < m200 AND lag(m20) {LAG} >= lag(m200) {LAG} THEN -1 ELSE 0 END AS ma_cross_20_200,
  (m20 - m50) / m50 AS ma_spread_20_50 FROM q_ma""",
)
def _(spark, sf):
    return t.moving_average_block(v.bars(spark, sf))


@query(
    "pivot_levels",
    "symbol, date:d, pivot_high:4, pivot_low:4, pivot_dist_high_pct:6, pivot_dist_low_pct:6",
    f"""SELECT symbol, date, h AS pivot_high, l AS pivot_low, close / h - 1 AS pivot_dist_high_pct, close / l - 1 AS pivot_dist_low_pct
FROM (SELECT *, {q_full('max', 'high', 10)} AS h, {q_full('min', 'low', 10)} AS l FROM bars)""",
)
def _(spark, sf):
    return t.pivots(v.bars(spark, sf))


@query(
    "fibonacci",
    "symbol, date:d, fib_level_pct:6, fib_dist_382:6, fib_dist_618:6",
    f"""SELECT symbol, date, (close - l) / nullif(h - l, 0) AS fib_level_pct, abs(close - (h - 0.382::DOUBLE * nullif(h - l, 0))) / close AS fib_dist_382,
  abs(close - (h - 0.618::DOUBLE * nullif(h - l, 0))) / close AS fib_dist_618
FROM (SELECT *, {q_full('max', 'high', 60)} AS h, {q_full('min', 'low', 60)} AS l FROM bars)""",
)
def _(spark, sf):
    return t.fibonacci(v.bars(spark, sf))


@query(
    "highs_and_volume",
    "symbol, date:d, dist_52w_high:6, vol_ratio_20_60:6",
    f"""SELECT symbol, date, close / max(close) OVER {win(252)} - 1 AS dist_52w_high,
  {q_sma('volume', 20)} / nullif({q_sma('volume', 60)}, 0) AS vol_ratio_20_60 FROM bars""",
)
def _(spark, sf):
    return t.highs_and_volume(v.bars(spark, sf))


# The composed group against the join of its parts' SQL.
_PARTS = [
    "bollinger", "atr", "adx", "cci", "obv", "mfi", "returns_and_momentum", "moving_average_block", "heikin_ashi",
    "pivot_levels", "fibonacci", "highs_and_volume",
]
_REST = f"""SELECT symbol, date, {', '.join(f'close / lag(close, {n}) {LAG} - 1 AS ret_{n}d' for n in (3, 5, 10, 60))},
  {', '.join(f'(close / lag(close, {n}) {LAG} - 1) * 100 AS roc_{n}d' for n in (1, 10, 20))}, close / m50 - 1 AS dist_sma50,
  {', '.join(f'(m{n} - lag(m{n}, 5) {LAG}) / lag(m{n}, 5) {LAG} AS ma_slope_sma{n}_5d' for n in (20, 200))},
  (m20 - m200) / m200 AS ma_spread_20_200, close / {q_ewm('close', span(50))} - 1 AS dist_ema50 FROM q_ma"""
_LEVELS = {"bb_upper", "bb_mid", "bb_lower", "atr", "obv", "mom_10d", "pivot_high", "pivot_low"}


@query(
    "technical_features",
    "symbol, date:d, " + ", ".join(f"{c}:{4 if c in _LEVELS else 6}" for c in t.TECHNICAL if c != "obv") + ", obv:2",
    f"SELECT * FROM ({_REST}) rest " + " ".join(f"JOIN ({CATALOG[p].body}) {p} USING (symbol, date)" for p in _PARTS),
)
def _(spark, sf):
    return t.technical_features(v.bars(spark, sf))
