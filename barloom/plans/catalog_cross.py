"""Catalogue: cross-section, relative features, events, sentiment, options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import cross, events, joins, quality
from . import views as v
from .catalog_sources import tone
from ..sources.tone import tone_articles
from .catalog_technical import LAG
from .registry import query, sql_view


def q_mid(x, groups, least):
    ok = " AND ".join([f"{x} IS NOT NULL", *[f"{g} IS NOT NULL" for g in groups]])
    g = ", ".join(groups)
    return (
        f"CASE WHEN {ok} AND count({x}) OVER (PARTITION BY {g}) >= {least} THEN (rank() OVER (PARTITION BY {g}, {x} IS NULL ORDER BY {x})"
        f" + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {g}) END"
    )


@query(
    "cross_sectional_rank",
    "symbol, date:d, cum_ret:6, cs_rank:6",
    f"""SELECT symbol, date, cum_ret, {q_mid('cum_ret', ['date'], 1)} AS cs_rank FROM (
  SELECT symbol, date, close / lag(close, 20) {LAG} - 1 AS cum_ret FROM weekly)""",
)
def _(spark, sf):
    return cross.compounded_rank(v.weekly(spark, sf))


@query(
    "midrank_by_sector",
    "symbol, date:d, rank:6",
    f"SELECT symbol, date, {q_mid('volume', ['date', 'sector'], 3)} AS rank FROM weekly",
)
def _(spark, sf):
    return v.weekly(spark, sf).withColumn("rank", cross.midrank("volume", ["date", "sector"]))


@query(
    "peer_rank",
    "symbol, date:d, rank:6",
    """SELECT w.symbol, w.date, CASE WHEN count(p.symbol) >= 2 THEN (1 + count(*) FILTER (p.volume < w.volume) + 0.5::DOUBLE * count(*) FILTER (p.volume = w.volume))
  / (count(p.symbol) + 1) END AS rank FROM weekly w LEFT JOIN weekly p ON p.date = w.date AND p.sector = w.sector AND p.symbol <> w.symbol
GROUP BY w.symbol, w.date""",
)
def _(spark, sf):
    return v.weekly(spark, sf).withColumn("rank", cross.peer_rank("volume", ["date", "sector"]))


@query(
    "peer_median_divergence",
    "symbol, date:d, divergence:6",
    """SELECT w.symbol, w.date, CASE WHEN count(p.symbol) >= 2 THEN w.volume - median(p.volume) END AS divergence
FROM weekly w LEFT JOIN weekly p ON p.date = w.date AND p.sector = w.sector AND p.symbol <> w.symbol GROUP BY w.symbol, w.date, w.volume""",
)
def _(spark, sf):
    return cross.loo_median_divergence(v.weekly(spark, sf), "volume", ["date", "sector"], "divergence")


@query(
    "sector_mean_excess",
    "symbol, date:d, mean:6, excess:6",
    """SELECT symbol, date, m AS mean, volume - m AS excess FROM (SELECT *, CASE WHEN count(volume) OVER (PARTITION BY date, sector) >= 3
  THEN avg(volume) OVER (PARTITION BY date, sector) END AS m FROM weekly)""",
)
def _(spark, sf):
    out = v.weekly(spark, sf).withColumn("mean", cross.group_mean("volume", ["date", "sector"]))
    return out.withColumn("excess", F.col("volume") - F.col("mean"))


_H = (10, 20, 60)
_UNI = ", ".join(
    f"close / lag(close, {h}) {LAG} - 1 AS t{h}, close / max(close) OVER (PARTITION BY symbol ORDER BY k RANGE BETWEEN {h} PRECEDING AND {h} PRECEDING) - 1 AS u{h}"
    for h in _H
)
sql_view(
    "q_universe_ret",
    f"""SELECT symbol, date, close, avg(close) OVER (PARTITION BY date) AS m, {_UNI}
FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM weekly)""",
)


def _uni_rank(h):
    return f"""(SELECT CASE WHEN a.t{h} IS NOT NULL THEN (count(*) FILTER (b.u{h} < a.t{h}) + (count(*) FILTER (b.u{h} = a.t{h}) + 2) / 2.0::DOUBLE)
  / (count(b.u{h}) + 1) END FROM q_universe_ret b WHERE b.date = a.date) AS cs_mom_rank_{h}d"""


@query(
    "universe_relative",
    "symbol, date:d, cs_rs_ratio_20d:6, "
    + ", ".join(f"cs_rel_ret_vs_median_{h}d:6, cs_mom_rank_{h}d:6" for h in _H),
    f"""SELECT symbol, date, close / m - 1 AS cs_rs_ratio_20d, {', '.join(f't{h} - median(u{h}) OVER (PARTITION BY date) AS cs_rel_ret_vs_median_{h}d' for h in _H)},
  {', '.join(_uni_rank(h) for h in _H)} FROM q_universe_ret a""",
)
def _(spark, sf):
    return cross.universe_block(v.weekly(spark, sf))


@query(
    "interval_sector",
    "symbol, date:d, sector",
    """SELECT w.symbol, w.date, arg_max(struct_pack(s := u.sector), coalesce(u.valid_from, DATE '0001-01-01')).s AS sector FROM weekly w
LEFT JOIN sector_map u ON u.symbol = w.symbol AND (u.valid_from IS NULL OR w.date >= u.valid_from) AND (u.valid_to IS NULL OR w.date <= u.valid_to)
GROUP BY w.symbol, w.date""",
)
def _(spark, sf):
    return joins.interval_sector(v.weekly(spark, sf), sector_map(spark, sf))


sql_view(
    "sector_map",
    """SELECT symbol, sector, valid_from, valid_to FROM universe UNION ALL
SELECT symbol, 'moved', valid_from + 400, NULL FROM universe WHERE valid_from IS NOT NULL""",
)


def sector_map(spark, sf):
    u = v.universe(spark, sf).select("symbol", "sector", "valid_from", "valid_to")
    moved = u.where("valid_from IS NOT NULL").select(
        "symbol",
        F.lit("moved").alias("sector"),
        F.date_add("valid_from", 400).alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )
    return u.unionByName(moved)


@query(
    "static_sector",
    "symbol, date:d, sector",
    "SELECT w.symbol, w.date, u.sector FROM weekly w LEFT JOIN universe u ON u.symbol = w.symbol",
)
def _(spark, sf):
    return joins.static_sector(v.weekly(spark, sf), v.universe(spark, sf))


@query(
    "dated_sector",
    "symbol, date:d, sector",
    """SELECT w.symbol, w.date, m.sector FROM weekly w LEFT JOIN (
  SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    arg_max(p_type, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey)) AS sector
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) m ON m.symbol = w.symbol AND m.date = w.date""",
)
def _(spark, sf):
    part = v.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"), F.col("p_type").alias("sector"))
    dated = (
        v.table(spark, sf, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("date", F.trunc("l_shipdate", "week"))
    )
    return joins.dated_sector(v.weekly(spark, sf), dated, F.struct("l_orderkey", "l_linenumber", "l_partkey"))


def _rel(h):
    return f"""CASE WHEN eligible THEN x{h} END AS market_excess_return_{h}d, CASE WHEN eligible THEN y{h} END AS market_relative_strength_{h}d,
  CASE WHEN eligible THEN m{h} END AS sector_return_{h}d, CASE WHEN eligible THEN r{h} - m{h} END AS sector_excess_return_{h}d,
  {q_mid(f'r{h}', ['date'], 3)} AS cross_sectional_return_rank_{h}d, {q_mid(f'r{h}', ['date', 'sector'], 3)} AS sector_return_rank_{h}d,
  {q_mid(f'r{h}', ['date', 'sector'], 3)} AS peer_return_rank_{h}d, (SELECT CASE WHEN e.r{h} IS NOT NULL AND count(o.r{h}) >= 2 THEN e.r{h} - median(o.r{h}) END
    FROM q_rel_rows o WHERE o.date = e.date AND o.sector = e.sector AND o.symbol <> e.symbol) AS peer_median_divergence_{h}d"""


sql_view(
    "q_rel_rows",
    f"""SELECT w.symbol, w.date, s.sector, elig AS eligible, {', '.join(f'CASE WHEN elig THEN ret{h} END AS r{h}' for h in (1, 5, 20))}
FROM (SELECT b.symbol, b.date, coalesce(u.symbol IS NOT NULL AND (valid_from IS NULL OR b.date >= valid_from) AND (valid_to IS NULL OR b.date <= valid_to), false) AS elig,
    {', '.join(f'close / lag(close, {h}) OVER (PARTITION BY b.symbol ORDER BY b.date) - 1 AS ret{h}' for h in (1, 5, 20))}
  FROM weekly b LEFT JOIN universe u ON u.symbol = b.symbol) w
LEFT JOIN (SELECT w2.symbol, w2.date, u2.sector FROM weekly w2 JOIN universe u2 ON u2.symbol = w2.symbol
  AND (u2.valid_from IS NULL OR w2.date >= u2.valid_from) AND (u2.valid_to IS NULL OR w2.date <= u2.valid_to)) s ON s.symbol = w.symbol AND s.date = w.date""",
)
sql_view(
    "q_rel_mkt",
    f"""SELECT symbol, date, {', '.join(f'c / lag(c, {h}) {LAG} - m / lag(m, {h}) {LAG} AS x{h}, (c / lag(c, {h}) {LAG}) / nullif(m / lag(m, {h}) {LAG}, 0) - 1 AS y{h}' for h in (1, 5, 20))}
FROM (SELECT w.symbol, w.date, w.close AS c, k.close AS m FROM weekly w JOIN market k ON k.date = w.date)""",
)


@query(
    "relative_features",
    "symbol, date:d, eligible:b, " + ", ".join(f"{c}:6" for c in cross.relative_columns()),
    f"""SELECT symbol, date, eligible, {', '.join(_rel(h) for h in (1, 5, 20))} FROM (
  SELECT a.*, x1, x5, x20, y1, y5, y20, {', '.join(f'CASE WHEN sector IS NOT NULL AND count(r{h}) OVER g >= 3 THEN avg(r{h}) OVER g END AS m{h}' for h in (1, 5, 20))}
  FROM q_rel_rows a LEFT JOIN q_rel_mkt b ON b.symbol = a.symbol AND b.date = a.date WINDOW g AS (PARTITION BY a.date, sector)) e""",
)
def _(spark, sf):
    return cross.relative_features(v.weekly(spark, sf), v.market(spark, sf), v.universe(spark, sf))


# ---- events, sentiment -------------------------------------------------------------

sql_view(
    "arrivals",
    """SELECT *, CASE WHEN id % 50 = 0 THEN DATE '2024-01-10' ELSE CAST(local AS DATE) + CASE WHEN CAST(local AS TIME) > TIME '15:30:00' THEN 1 ELSE 0 END END AS effective_date
FROM (SELECT *, published + INTERVAL 330 MINUTE AS local FROM news)""",
)


def arrivals(spark, sf):
    rows = v.news(spark, sf).withColumn("local", events.local_time("published"))
    explicit = F.when(F.col("id") % 50 == 0, F.lit("2024-01-10").cast("date"))
    return rows.withColumn("effective_date", events.effective_day(F.col("local"), explicit, strict=True))


@query("event_effective_date", "id:i, effective_date:d", "SELECT id, effective_date FROM arrivals")
def _(spark, sf):
    return arrivals(spark, sf)


@query(
    "event_visibility",
    "symbol, category, n:i",
    "SELECT symbol, category, count(*) AS n FROM arrivals WHERE effective_date <= DATE '2024-01-15' GROUP BY 1, 2",
)
def _(spark, sf):
    return events.visible(arrivals(spark, sf), "2024-01-15").groupBy("symbol", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_features",
    "symbol, date:d, event_count_5d:i, event_today:i",
    """SELECT symbol, date, cum - coalesce(lag(cum, 5) OVER k, 0) AS event_count_5d, CASE WHEN cum > coalesce(lag(cum) OVER k, 0) THEN 1 ELSE 0 END AS event_today FROM (
  SELECT b.symbol, b.date, (SELECT count(*) FROM arrivals a WHERE a.symbol = b.symbol AND a.effective_date <= b.date
    AND a.effective_date >= (SELECT min(date) FROM newsbars c WHERE c.symbol = b.symbol) - 5) AS cum FROM newsbars b)
WINDOW k AS (PARTITION BY symbol ORDER BY date)""",
)
def _(spark, sf):
    return events.event_features(v.newsbars(spark, sf), arrivals(spark, sf))


sql_view(
    "q_days",
    """SELECT symbol, effective_date AS d, avg(score) AS m, count(*) AS n, count(*) FILTER (score > 0) AS p FROM arrivals GROUP BY 1, 2""",
)
_SENT = """SELECT b.symbol, b.date, avg(q.m) AS sent_score_5d, coalesce(sum(q.n), 0) AS sent_count_5d, sum(q.p) / CAST(nullif(sum(q.n), 0) AS DOUBLE) AS sent_pos_ratio_5d,
  max(q.m) FILTER (q.d = b.date) AS sent_recent FROM newsbars b LEFT JOIN {0} q ON q.symbol = b.symbol AND q.d BETWEEN b.date - 4 AND b.date GROUP BY 1, 2"""


@query(
    "sentiment_features",
    "symbol, date:d, sent_score_5d:6, sent_count_5d:0, sent_pos_ratio_5d:6, sent_recent:6",
    _SENT.format("q_days"),
)
def _(spark, sf):
    return events.sentiment_features(v.newsbars(spark, sf), arrivals(spark, sf))


@query(
    "tone_sentiment",
    "symbol, date:d, sent_score_5d:4, sent_count_5d:0, sent_pos_ratio_5d:6, sent_recent:4",
    _SENT.format("(SELECT symbol, date AS d, round(tone, 4) AS m, 1 AS n, CASE WHEN round(tone, 4) > 0 THEN 1 ELSE 0 END AS p FROM tone)"),
)
def _(spark, sf):
    articles = tone_articles(tone(spark, sf))
    articles = articles.withColumn("effective_date", events.effective_day(events.local_time("published_utc")))
    return events.sentiment_features(v.newsbars(spark, sf), articles)


# ---- options -----------------------------------------------------------------------

sql_view(
    "spots",
    """SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS as_of, arg_max(close, date) AS spot FROM weekly GROUP BY 1, 2""",
)


def spots(spark, sf):
    return spots_of(v.weekly(spark, sf))


def spots_of(week):
    return week.groupBy("symbol", F.trunc("date", "month").alias("as_of")).agg(F.max_by("close", "date").alias("spot"))


sql_view(
    "q_chain",
    """SELECT c.symbol, c.as_of, any_value(spot) AS spot, sum(open_interest) FILTER (side = 'put') / nullif(sum(open_interest) FILTER (side = 'call'), 0) AS pcr,
  sum(open_interest) AS total_oi,
  arg_min(struct_pack(v := implied_vol, k := strike), struct_pack(a := abs(strike - spot), b := CASE WHEN side = 'call' THEN 0 ELSE 1 END, c := l_orderkey, d := l_linenumber, e := l_partkey, f := l_suppkey, g := l_extendedprice)) AS atm
FROM chains c JOIN spots s ON s.symbol = c.symbol AND s.as_of = c.as_of WHERE implied_vol IS NOT NULL GROUP BY 1, 2""",
)


@query(
    "option_chain_metrics",
    "symbol, as_of:d, pcr:6, total_oi:2, atm_iv:6, atm_strike:2",
    "SELECT symbol, as_of, pcr, total_oi, atm.v AS atm_iv, atm.k AS atm_strike FROM q_chain",
)
def _(spark, sf):
    return events.chain_metrics(v.chains(spark, sf), spots(spark, sf))


@query(
    "option_features_asof",
    "symbol, date:d, pcr:6, atm_iv:6",
    """SELECT w.symbol, w.date, q.pcr, q.atm.v AS atm_iv FROM weekly w ASOF LEFT JOIN (SELECT *, as_of + INTERVAL 1 MONTH AS at FROM q_chain) q
  ON q.symbol = w.symbol AND w.date >= q.at""",
)
def _(spark, sf):
    m = events.chain_metrics(v.chains(spark, sf), spots(spark, sf))
    return joins.as_of(v.weekly(spark, sf), m.withColumn("available_at", F.add_months("as_of", 1)), ["pcr", "atm_iv"])


def q_phi(x):
    """Normal distribution by its power series."""
    terms = f"list_transform(range(0, 120), lambda k: pow({x}, 2 * k + 1) / (pow(2.0::DOUBLE, k + 1) * gamma(k + 1.5::DOUBLE) / sqrt(pi())))"
    inner = f"0.5::DOUBLE + exp(-0.5::DOUBLE * {x} * {x}) / sqrt(2 * pi()) * list_sum({terms})"
    return f"CASE WHEN {x} > 8 THEN 1 WHEN {x} < -8 THEN 0 ELSE {inner} END"


@query(
    "call_greeks",
    "symbol, as_of:d, delta:6, gamma:8, theta:4, vega:4, rho:4",
    f"""SELECT symbol, as_of, {q_phi('d1')} AS delta, pdf / (spot * s * sqrt(t)) AS gamma, spot * pdf * sqrt(t) AS vega, k * t * exp(-0.06::DOUBLE * t) * {q_phi('d2')} AS rho,
  (-pdf * s / (2 * sqrt(t)) - 0.06::DOUBLE * k * exp(-0.06::DOUBLE * t) * {q_phi('d2')}) / 365 AS theta FROM (
  SELECT *, d1 - s * sqrt(t) AS d2, exp(-0.5::DOUBLE * d1 * d1) / sqrt(2 * pi()) AS pdf FROM (SELECT symbol, as_of, spot, atm.v AS s, atm.k AS k, 30 / 365.0::DOUBLE AS t,
    (ln(spot / atm.k) + (0.06::DOUBLE + atm.v * atm.v / 2) * 30 / 365.0::DOUBLE) / (atm.v * sqrt(30 / 365.0::DOUBLE)) AS d1 FROM q_chain))""",
)
def _(spark, sf):
    return events.chain_metrics(v.chains(spark, sf), spots(spark, sf), days_to_expiry=30)
