"""Catalogue: risk, market-relative, beta, regime, macro, alpha and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import joins, labels, market, technical
from . import views as v
from .catalog_technical import LAG, q_full, q_sma, win
from .registry import query, sql_view

A = "sqrt(252::DOUBLE)"
sql_view(
    "q_ret",
    f"""SELECT *, close / lag(close) {LAG} - 1 AS r, (high - low) / nullif(close, 0) AS hl,
  CASE WHEN abs(open - lag(close) {LAG}) / lag(close) {LAG} > 0.01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gap FROM bars""",
)


def q_pctile(x, n, part="symbol"):
    """Window list, then the share not above the newest value."""
    spec = f"(PARTITION BY {part} ORDER BY date ROWS {n - 1} PRECEDING)"
    return (
        f"CASE WHEN count({x}) OVER {spec} = {n} THEN len(list_filter(list({x}) OVER {spec}, "
        f"lambda e: e <= {x})) / {n}::DOUBLE END"
    )


def q_dd(x, n, part="symbol"):
    spec = f"(PARTITION BY {part} ORDER BY date ROWS {n - 1} PRECEDING)"
    return (
        f"CASE WHEN count({x}) OVER {spec} = {n} THEN list_reduce(list_transform(list({x}) OVER {spec}, "
        "lambda e: struct_pack(p := e, d := 0.0::DOUBLE)), lambda a, b: struct_pack(p := greatest(a.p, b.p), "
        "d := least(a.d, b.p / greatest(a.p, b.p) - 1))).d END"
    )


@query(
    "risk_features",
    """symbol, date:d, vol_20d:6, vol_60d:6, down_vol_20d:6, vol_pctile_252d:6, vol_exp_5d:6, hl_range_20d:6,
    gap_freq_20d:6, max_dd_60d:6""",
    f"""SELECT *, {q_pctile('vol_20d', 252)} AS vol_pctile_252d, vol_20d / nullif(lag(vol_20d, 5) {LAG}, 0) AS vol_exp_5d FROM (
  SELECT symbol, date, {q_full('stddev_pop', 'r', 20)} * {A} AS vol_20d, {q_full('stddev_pop', 'r', 60)} * {A} AS vol_60d,
    CASE WHEN count(*) OVER {win(20)} = 20 THEN sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END) OVER {win(20)}) * {A} END AS down_vol_20d,
    {q_sma('hl', 20)} AS hl_range_20d, {q_sma('gap', 20)} AS gap_freq_20d, {q_dd('close', 60)} AS max_dd_60d FROM q_ret)""",
)
def _(spark, sf):
    return market.risk_block(v.bars(spark, sf))


PL = "OVER (PARTITION BY symbol ORDER BY date)"
PW = "(PARTITION BY symbol ORDER BY date ROWS {0} PRECEDING)"


def q_relative(rows, bench):
    """Relative family computed on an explicit inner join of both calendars."""
    return f"""SELECT b.symbol, b.date, rel_1, rel_5, rel_20, rs, rs / nullif(lag(rs, 5) OVER (PARTITION BY b.symbol ORDER BY b.date), 0) - 1 AS slope, corr60, volr
FROM {rows} b LEFT JOIN (
  SELECT symbol, date, s1 - m1 AS rel_1, s5 - m5 AS rel_5, s20 - m20 AS rel_20, (1 + s20) / nullif(1 + m20, 0) - 1 AS rs,
    CASE WHEN count(s1) OVER {PW.format(59)} = 60 THEN corr(s1, m1) OVER {PW.format(59)} END AS corr60,
    CASE WHEN count(s1) OVER {PW.format(19)} = 20 THEN stddev_pop(s1) OVER {PW.format(19)} / nullif(stddev_pop(m1) OVER {PW.format(19)}, 0) END AS volr
  FROM (SELECT symbol, date, c / lag(c) {PL} - 1 AS s1, m / lag(m) {PL} - 1 AS m1, c / lag(c, 5) {PL} - 1 AS s5, m / lag(m, 5) {PL} - 1 AS m5,
      c / lag(c, 20) {PL} - 1 AS s20, m / lag(m, 20) {PL} - 1 AS m20 FROM ({bench}))) x ON x.symbol = b.symbol AND x.date = b.date"""


REL = "symbol, date:d, rel_1:6, rel_5:6, rel_20:6, rs:6, slope:4, corr60:6, volr:6"


def _short(df, label):
    return df.withColumnsRenamed(
        {
            f"rel_ret_{label}_1d": "rel_1",
            f"rel_ret_{label}_5d": "rel_5",
            f"rel_ret_{label}_20d": "rel_20",
            f"rel_rs_ratio_{label}_20d": "rs",
            f"rel_rs_slope_{label}_20d": "slope",
            f"rel_corr_{label}_60d": "corr60",
            f"rel_vol_ratio_{label}_20d": "volr",
        }
    )


@query(
    "market_relative",
    REL,
    q_relative("bars", "SELECT b.symbol, b.date, b.close AS c, m.close AS m FROM bars b JOIN market m ON b.date = m.date"),
)
def _(spark, sf):
    return _short(market.market_features(v.bars(spark, sf), v.market(spark, sf)), "nifty")


sql_view(
    "sectors",
    """SELECT sector, date, sum(close * volume) / sum(volume) AS close FROM weekly
WHERE day(date) % 6 <> 0 GROUP BY sector, date""",
)


def sectors(spark, sf):
    return sector_closes(v.weekly(spark, sf))


def sector_closes(week):
    return (
        week
        .where(F.dayofmonth("date") % 6 != 0)
        .groupBy("sector", "date")
        .agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("close"))
    )


@query(
    "sector_relative",
    REL,
    q_relative(
        "weekly",
        "SELECT b.symbol, b.date, b.close AS c, s.close AS m FROM weekly b JOIN sectors s ON b.sector = s.sector AND b.date = s.date",
    ),
)
def _(spark, sf):
    return _short(market.sector_features(v.weekly(spark, sf), sectors(spark, sf)), "sector")


@query(
    "benchmark_join",
    "symbol, date:d, close:8, mkt:6",
    "SELECT b.symbol, b.date, b.close, m.close AS mkt FROM bars b LEFT JOIN ragged_market m ON b.date = m.date",
)
def _(spark, sf):
    return joins.attach_series(v.bars(spark, sf), v.ragged_market(spark, sf), "mkt")


@query(
    "beta",
    "symbol, date:d, beta:6, beta_alpha:6, beta_r2:6, residual_ret:6, residual_vol:6, residual_vol_pctile:6",
    f"""SELECT *, {q_pctile('residual_vol', 252)} AS residual_vol_pctile FROM (
  SELECT *, {q_full('stddev_pop', 'residual_ret', 20)} AS residual_vol FROM (
    SELECT b.symbol, b.date, beta, beta_alpha, beta_r2, s1 - beta * m1 AS residual_ret FROM bars b LEFT JOIN (
      SELECT *, CASE WHEN n = 60 THEN regr_slope(s1, m1) OVER q END AS beta, CASE WHEN n = 60 THEN regr_intercept(s1, m1) OVER q END AS beta_alpha,
        CASE WHEN n = 60 THEN regr_r2(s1, m1) OVER q END AS beta_r2 FROM (
        SELECT *, count(*) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING) AS n FROM (
          SELECT symbol, date, c / lag(c) {PL} - 1 AS s1, m / lag(m) {PL} - 1 AS m1 FROM (
            SELECT b.symbol, b.date, b.close AS c, m.close AS m FROM bars b JOIN market m ON b.date = m.date)) WHERE s1 IS NOT NULL)
      WINDOW q AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)) x ON x.symbol = b.symbol AND x.date = b.date))""",
)
def _(spark, sf):
    return market.beta_block(v.bars(spark, sf), v.market(spark, sf))


def q_alone(agg, x, n):
    spec = f"(ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {spec} = {n} THEN {agg}({x}) OVER {spec} END"


sql_view(
    "q_trend",
    f"""SELECT date, CASE WHEN f IS NULL OR s IS NULL THEN NULL WHEN close > f AND close > s THEN 1.0::DOUBLE
  WHEN close < f AND close < s THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS regime_trend
FROM (SELECT *, {q_alone('avg', 'close', 50)} AS f, {q_alone('avg', 'close', 200)} AS s FROM market)""",
)
sql_view(
    "q_volreg",
    f"""SELECT *, CASE WHEN p >= 0.7 THEN 1 WHEN p <= 0.3 THEN -1 WHEN p IS NOT NULL THEN 0 END AS regime_vol FROM (
  SELECT date, {q_pctile('v', 252, '1')} AS p FROM (SELECT date, {q_alone('stddev_pop', 'r', 20)} AS v FROM (
    SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM market)))""",
)
sql_view(
    "q_risk",
    f"""SELECT t.date, regime_trend, p AS regime_vix_pctile, CASE WHEN regime_trend IS NULL OR p IS NULL THEN NULL
  WHEN regime_trend = 1 AND p <= 0.5 THEN 1 WHEN regime_trend = -1 AND p > 0.5 THEN -1 ELSE 0 END AS regime_risk
FROM q_trend t LEFT JOIN (SELECT date, {q_pctile('close', 252, '1')} AS p FROM volx) x ON x.date = t.date""",
)


@query("trend_regime", "date:d, regime_trend:0", "SELECT * FROM q_trend")
def _(spark, sf):
    return market.trend_regime(v.market(spark, sf))


@query(
    "vol_regime",
    "date:d, regime_vol:0, regime_nifty_vol_pctile:6",
    "SELECT date, regime_vol, p AS regime_nifty_vol_pctile FROM q_volreg",
)
def _(spark, sf):
    return market.vol_regime(v.market(spark, sf))


@query("risk_regime", "date:d, regime_trend:0, regime_vix_pctile:6, regime_risk:0", "SELECT * FROM q_risk")
def _(spark, sf):
    return market.risk_regime(v.market(spark, sf), v.volx(spark, sf))


sql_view(
    "q_breadth",
    """SELECT date, avg(CASE WHEN close > m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS regime_breadth FROM (
  SELECT g.date, w.close, avg(w.close) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS 19 PRECEDING) AS m
  FROM (SELECT DISTINCT a.symbol, b.date FROM (SELECT DISTINCT symbol FROM weekly) a, (SELECT DISTINCT date FROM weekly) b) g
  LEFT JOIN weekly w ON w.symbol = g.symbol AND w.date = g.date) GROUP BY date""",
)


@query("breadth", "date:d, regime_breadth:6", "SELECT * FROM q_breadth")
def _(spark, sf):
    return market.breadth(v.weekly(spark, sf))


@query(
    "regime_features",
    """symbol, date:d, regime_trend:0, regime_vol:0, regime_nifty_vol_pctile:6, regime_risk:0, regime_vix_pctile:6,
    regime_breadth:6""",
    """SELECT b.symbol, b.date, regime_trend, regime_vol, p AS regime_nifty_vol_pctile, regime_risk, regime_vix_pctile, regime_breadth
FROM bars b LEFT JOIN q_risk r ON r.date = b.date LEFT JOIN q_volreg x ON x.date = b.date LEFT JOIN q_breadth y ON y.date = b.date""",
)
def _(spark, sf):
    return market.regime_features(
        v.bars(spark, sf), v.market(spark, sf), v.volx(spark, sf), market.breadth(v.weekly(spark, sf))
    )


sql_view(
    "q_macro",
    """SELECT b.symbol, b.date, d.close AS demand, s.close AS supply FROM bars b
LEFT JOIN series d ON d.date = b.date AND d.series_id = 'demand' LEFT JOIN series s ON s.date = b.date AND s.series_id = 'supply'""",
)


def q_mac(s):
    return f"""{s} / lag({s}, 5) {LAG} - 1 AS mac_{s}_ret_5d, {s} / lag({s}, 20) {LAG} - 1 AS mac_{s}_ret_20d,
  {s} / lag({s}, 60) {LAG} - 1 AS mac_{s}_ret_60d, {q_dd(s, 60)} AS mac_{s}_dd_60d,
  CASE WHEN count(r_{s}) OVER {win(60)} = 60 THEN stddev_pop(r_{s}) OVER {win(60)} * {A} END AS mac_{s}_vol_60d"""


@query(
    "macro_features",
    "symbol, date:d, "
    + ", ".join(f"mac_{s}_{k}:6" for s in ("demand", "supply") for k in ("ret_5d", "ret_20d", "ret_60d", "vol_60d", "dd_60d")),
    f"""SELECT symbol, date, {q_mac('demand')}, {q_mac('supply')} FROM (
  SELECT *, demand / lag(demand) {LAG} - 1 AS r_demand, supply / lag(supply) {LAG} - 1 AS r_supply FROM q_macro)""",
)
def _(spark, sf):
    return market.macro_features(v.bars(spark, sf), v.series(spark, sf), ["demand", "supply"])


def _c(x):
    return f"coalesce({x}, 0.5::DOUBLE)"


sql_view(
    "q_asof",
    """SELECT b.symbol, b.date, b.close, s.pe_ratio, s.roe, s.debt_to_equity FROM bars b ASOF LEFT JOIN (
  SELECT symbol, available_at, arg_max(struct_pack(p := pe_ratio, r := roe, d := debt_to_equity), seq).p AS pe_ratio,
    arg_max(struct_pack(p := pe_ratio, r := roe, d := debt_to_equity), seq).r AS roe,
    arg_max(struct_pack(p := pe_ratio, r := roe, d := debt_to_equity), seq).d AS debt_to_equity
  FROM snaps GROUP BY symbol, available_at) s ON b.symbol = s.symbol AND b.date >= s.available_at""",
)


@query(
    "alpha_factors",
    "symbol, date:d, alpha_momentum:6, alpha_mean_reversion:6, alpha_volatility:6, alpha_value:6",
    f"""SELECT symbol, date, ({_c(q_pctile('m20', 252))} + {_c(q_pctile('m60', 252))} + {_c(q_pctile('m120', 252))}) / 3 AS alpha_momentum,
  ({_c('1 - ' + q_pctile('dist', 252))} + {_c('1 - ' + q_pctile('rsi', 252))} + {_c('1 - ' + q_pctile('m20', 252))}) / 3 AS alpha_mean_reversion,
  1 - {q_pctile('vol', 252)} AS alpha_volatility, {_c('1 - ' + q_pctile('pe_ratio', 252))} AS alpha_value FROM (
  SELECT symbol, date, close / lag(close, 20) {LAG} - 1 AS m20, close / lag(close, 60) {LAG} - 1 AS m60, close / lag(close, 120) {LAG} - 1 AS m120,
    rsi, close / {q_sma('close', 20)} - 1 AS dist, {q_full('stddev_pop', 'r', 60)} AS vol, pe_ratio
  FROM (SELECT x.symbol, x.date, x.close, x.r, i.rsi, a.pe_ratio FROM q_ret x JOIN q_rsi i ON i.symbol = x.symbol AND i.date = x.date
    JOIN q_asof a ON a.symbol = x.symbol AND a.date = x.date))""",
)
def _(spark, sf):
    known = joins.as_of(v.bars(spark, sf), v.snaps(spark, sf), ["pe_ratio"], seq="seq")
    return market.alpha_factors(technical.rsi(known))


@query(
    "as_of_join",
    "symbol, date:d, pe_ratio:6, roe:6, debt_to_equity:6",
    "SELECT * FROM q_asof",
)
def _(spark, sf):
    return joins.as_of(v.bars(spark, sf), v.snaps(spark, sf), ["pe_ratio", "roe", "debt_to_equity"], seq="seq")


@query(
    "as_of_default_visibility",
    "symbol, date:d, balance:2",
    """SELECT b.symbol, b.date, CASE WHEN b.date = max(b.date) OVER (PARTITION BY b.symbol) THEN s.balance END AS balance FROM bars b LEFT JOIN (
  SELECT ['A', 'N', 'R'][1 + CAST(c_custkey % 3 AS INTEGER)] AS symbol, arg_max(c_acctbal, c_custkey) AS balance FROM customer GROUP BY 1) s ON s.symbol = b.symbol""",
)
def _(spark, sf):
    undated = v.table(spark, sf, "customer").select(
        v._flag(F.col("c_custkey")).alias("symbol"),
        F.lit(None).cast("date").alias("available_at"),
        F.col("c_custkey").alias("seq"),
        F.col("c_acctbal").alias("balance"),
    )
    panel = v.bars(spark, sf)
    return joins.as_of(panel, joins.default_visibility(undated, panel), ["balance"], seq="seq")


@query(
    "aligned_closes",
    "date:d, demand:4, supply:4, mkt:4",
    """SELECT date, max(close) FILTER (series_id = 'demand') AS demand, max(close) FILTER (series_id = 'supply') AS supply,
  max(close) FILTER (series_id = 'mkt') AS mkt FROM (SELECT * FROM series UNION ALL SELECT 'mkt', date, close FROM market) GROUP BY date""",
)
def _(spark, sf):
    return joins.align(_all_series(spark, sf), ["demand", "supply", "mkt"])


def _all_series(spark, sf):
    return v.series(spark, sf).unionByName(v.market(spark, sf).withColumn("series_id", F.lit("mkt")))


@query(
    "alignment_report",
    "series_id, rows:i, complete_rows:i, first_date:d, last_date:d, present:i",
    """SELECT * FROM (SELECT unnest(['demand', 'supply', 'mkt']) AS series_id, rows, complete_rows, first_date, last_date,
  unnest([nd, ns, nm]) AS present FROM (SELECT count(*) AS rows, count(*) FILTER (d IS NOT NULL AND s IS NOT NULL AND m IS NOT NULL) AS complete_rows,
    min(date) AS first_date, max(date) AS last_date, count(d) AS nd, count(s) AS ns, count(m) AS nm FROM (
    SELECT date, max(close) FILTER (series_id = 'demand') AS d, max(close) FILTER (series_id = 'supply') AS s, max(close) FILTER (series_id = 'mkt') AS m
    FROM (SELECT * FROM series UNION ALL SELECT 'mkt', date, close FROM market) GROUP BY date)))""",
)
def _(spark, sf):
    ids = ["demand", "supply", "mkt"]
    return joins.alignment_report(joins.align(_all_series(spark, sf), ids), ids)


# ---- labels ----------------------------------------------------------------------

sql_view(
    "q_labels",
    f"""SELECT *, CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INTEGER) END AS label_binary,
  CASE WHEN ret IS NOT NULL THEN CAST(ret > 0.01 AS INTEGER) END AS label_meaningful,
  CASE WHEN ret > 0.01 THEN 1 WHEN ret < -0.01 THEN -1 WHEN ret IS NOT NULL THEN 0 END AS label_three,
  ret / nullif(past_vol, 0) AS vol_adjusted,
  CASE WHEN ret / nullif(past_vol, 0) IS NOT NULL THEN CAST(ret / nullif(past_vol, 0) > 1 AS INTEGER) END AS label_vol_binary,
  CASE WHEN ret / past_vol > 1 THEN 1 WHEN ret / past_vol < -1 THEN -1 WHEN ret / past_vol IS NOT NULL THEN 0 END AS label_vol_three
FROM (SELECT symbol, date, close, r, lead(close, 20) {LAG} / close - 1 AS ret,
  CASE WHEN count(r) OVER b = 20 THEN stddev_samp(r) OVER b END AS past_vol, 0.5::DOUBLE * {q_full('stddev_samp', 'r', 20)} * sqrt(20::DOUBLE) AS theta
  FROM q_ret WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
)


def labelled(spark, sf):
    out = labels.add_target(v.bars(spark, sf)).transform(labels.vol_threshold_label)
    return labels.candidate_labels(labels.past_volatility(out), "target_ret_20d")


@query(
    "forward_labels",
    "symbol, date:d, target_ret_20d:6, target_up_20d:0",
    "SELECT symbol, date, ret AS target_ret_20d, label_binary AS target_up_20d FROM q_labels",
)
def _(spark, sf):
    return labels.add_target(v.bars(spark, sf))


@query(
    "vol_threshold_label",
    "symbol, date:d, vol_theta_20d:6, train_up_20d:0",
    "SELECT symbol, date, theta AS vol_theta_20d, CASE WHEN ret > theta THEN 1 WHEN ret < -theta THEN 0 END AS train_up_20d FROM q_labels",
)
def _(spark, sf):
    return labelled(spark, sf)


@query("past_volatility", "symbol, date:d, past_vol:6", "SELECT symbol, date, past_vol FROM q_labels")
def _(spark, sf):
    return labelled(spark, sf)


@query(
    "candidate_labels",
    """symbol, date:d, label_binary:i, label_meaningful:i, label_three:i, vol_adjusted:4, label_vol_binary:i,
    label_vol_three:i, label_regression:6""",
    "SELECT *, ret AS label_regression FROM q_labels",
)
def _(spark, sf):
    return labelled(spark, sf)


_UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS label, {c} AS value FROM q_labels" for c in labels.LABELS)


@query(
    "label_statistics",
    "label, value:i, n:i, n_defined:i, n_undefined:i, share:6",
    f"""SELECT label, value, n, d AS n_defined, t - d AS n_undefined, CASE WHEN value IS NOT NULL THEN n / CAST(d AS DOUBLE) END AS share FROM (
  SELECT label, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS t,
    sum(count(*)) FILTER (value IS NOT NULL) OVER (PARTITION BY label) AS d FROM ({_UNPIVOT}) GROUP BY label, value)""",
)
def _(spark, sf):
    return labels.label_counts(labelled(spark, sf))


@query(
    "near_zero_buckets",
    "lower:4, n:i, share:6",
    """SELECT lower, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM (
  SELECT CASE WHEN abs(ret) >= 0.02 THEN 0.02 WHEN abs(ret) >= 0.01 THEN 0.01 WHEN abs(ret) >= 0.005 THEN 0.005
    WHEN abs(ret) >= 0.001 THEN 0.001 ELSE 0 END AS lower FROM q_labels WHERE ret IS NOT NULL) GROUP BY lower""",
)
def _(spark, sf):
    return labels.near_zero_histogram(labelled(spark, sf), "target_ret_20d")


_PAIRS = " UNION ALL ".join(
    f"""SELECT '{a}' AS "left", '{b}' AS "right", count(*) AS n, count(*) FILTER ({a} = {b}) AS equal, corr({a}, {b}) AS corr
FROM q_labels WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
    for i, a in enumerate(labels.LABELS)
    for b in labels.LABELS[i + 1 :]
)


@query(
    "label_agreement",
    "left, right, n:i, equal:i, rate:6, corr:6",
    f"SELECT *, equal / CAST(n AS DOUBLE) AS rate FROM ({_PAIRS})",
)
def _(spark, sf):
    return labels.label_agreement(labelled(spark, sf))


@query(
    "label_band_coverage",
    "labelled:i, outside:i, ratio:6",
    """SELECT count(ret) AS labelled, count(*) FILTER (abs(ret) > theta) AS outside,
  count(*) FILTER (abs(ret) > theta) / CAST(count(ret) AS DOUBLE) AS ratio FROM q_labels""",
)
def _(spark, sf):
    return labels.band_coverage(labelled(spark, sf), "target_ret_20d", "vol_theta_20d")
