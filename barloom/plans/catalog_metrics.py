"""Catalogue: quality reports, model metrics, drift, scorecards and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking
from ..operators import bootstrap, drift, joins, ledger, metrics, quality
from . import views as v
from .catalog_market import labelled
from .catalog_sources import forecasts
from .catalog_technical import LAG
from .registry import query, sql_view

# ---- quality -------------------------------------------------------------------------


def _holes(spark, sf):
    return joins.as_of(v.bars(spark, sf), v.snaps(spark, sf), ["pe_ratio", "roe"], seq="seq").withColumn(
        "r", F.col("close") / F.lag("close").over(ledger.w.ordered()) - 1
    )


sql_view("q_holes", f"SELECT symbol, date, pe_ratio, roe, close / lag(close) {LAG} - 1 AS r FROM q_asof")


@query(
    "missingness_report",
    "symbol, column, missing:i, total:i, rate:6",
    """SELECT symbol, "column", total - present AS missing, total, (total - present) / CAST(total AS DOUBLE) AS rate FROM (
  SELECT symbol, unnest(['pe_ratio', 'roe', 'r']) AS "column", total, unnest([a, b, c]) AS present FROM (
    SELECT symbol, count(*) AS total, count(pe_ratio) AS a, count(roe) AS b, count(r) AS c FROM q_holes GROUP BY ROLLUP (symbol)))""",
)
def _(spark, sf):
    return quality.missingness(_holes(spark, sf), ["pe_ratio", "roe", "r"])


@query(
    "coverage_by_symbol",
    "symbol, rows:i, date_start:d, date_end:d, target_rows:i",
    """SELECT symbol, count(*) AS rows, min(date) AS date_start, max(date) AS date_end, count(ret) AS target_rows FROM q_labels GROUP BY symbol""",
)
def _(spark, sf):
    return quality.symbol_coverage(labelled(spark, sf), "target_ret_20d")


@query(
    "coverage_by_feature",
    "feature, rows:i, n_symbols:i, n_dates:i, present:i, missing:i, coverage:6",
    """SELECT *, rows - present AS missing, present / CAST(rows AS DOUBLE) AS coverage FROM (
  SELECT unnest(['pe_ratio', 'roe', 'r']) AS feature, rows, n_symbols, n_dates, unnest([a, b, c]) AS present FROM (
    SELECT count(*) AS rows, count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates, count(pe_ratio) AS a, count(roe) AS b, count(r) AS c FROM q_holes))""",
)
def _(spark, sf):
    return quality.feature_coverage(_holes(spark, sf), ["pe_ratio", "roe", "r"])


@query(
    "pooled_union",
    "symbol, date:d, close:6, sector, extra:6",
    """SELECT symbol, date, close, NULL AS sector, volume AS extra FROM bars UNION ALL SELECT symbol, date, close, sector, NULL FROM weekly""",
)
def _(spark, sf):
    return quality.pool([v.bars(spark, sf).withColumn("extra", F.col("volume")), v.weekly(spark, sf)])


@query(
    "keep_first_last",
    "link, first_id:i, last_id:i",
    """SELECT link, arg_min(id, struct_pack(a := published, b := id)) AS first_id, arg_max(id, struct_pack(a := published, b := id)) AS last_id FROM news GROUP BY link""",
)
def _(spark, sf):
    n = v.news(spark, sf).select("link", "id", "published")
    a = quality.keep_one(n, ["link"], ["published", "id"]).select("link", F.col("id").alias("first_id"))
    b = quality.keep_one(n, ["link"], ["published", "id"], last=True).select("link", F.col("id").alias("last_id"))
    return a.join(b, "link")


@query(
    "duplicate_keys",
    "l_orderkey:i, l_linenumber:i, n:i",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return quality.duplicates(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "quarantined_symbols",
    "symbol, reason, kept:i",
    """WITH raw AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders),
bad AS (SELECT DISTINCT symbol FROM (SELECT symbol FROM raw GROUP BY symbol, date HAVING count(*) > 1))
SELECT symbol, 'duplicate dates in feature frame' AS reason, 0 AS kept FROM bad
UNION ALL SELECT symbol, NULL, count(*) FROM raw WHERE symbol NOT IN (SELECT symbol FROM bad) GROUP BY symbol""",
)
def _(spark, sf):
    raw = v.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("date").alias("date")
    )
    good, bad = quality.quarantine(raw, ["symbol", "date"])
    kept = good.groupBy("symbol").agg(F.count(F.lit(1)).alias("kept")).withColumn("reason", F.lit(None).cast("string"))
    return bad.withColumn("kept", F.lit(0).cast("bigint")).unionByName(kept)


@query("unique_panel", "symbol, n:i", "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol")
def _(spark, sf):
    return quality.require_unique(v.bars(spark, sf), ["symbol", "date"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


# ---- model metrics -------------------------------------------------------------------

_AUC = """(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
  / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0)"""


def q_auc(keys, p="p", src="preds"):
    part = f"PARTITION BY {keys} " if keys else ""
    part2 = f"PARTITION BY {keys}, {p}" if keys else f"PARTITION BY {p}"
    group = f"GROUP BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    return f"""SELECT {sel}{_AUC} AS auc, count(*) AS n FROM (SELECT *, rank() OVER ({part}ORDER BY {p})
  + (count(*) OVER ({part2}) - 1) / 2.0::DOUBLE AS rk FROM {src}) {group}"""


_BIN = "CAST(" + " + ".join(f"CASE WHEN p >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in metrics.EDGES) + " AS INTEGER)"


def q_score(keys, src="preds"):
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    tp, fp = "count(*) FILTER (p >= 0.5 AND y = 1)", "count(*) FILTER (p >= 0.5 AND y = 0)"
    fn, tn = "count(*) FILTER (p < 0.5 AND y = 1)", "count(*) FILTER (p < 0.5 AND y = 0)"
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()} AND a.{c.strip()} = c.{c.strip()}" for c in keys.split(",")) if keys else "true"
    return f"""SELECT a.*, b.auc, c.ece FROM (SELECT {k}count(*) AS n, {tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn, avg(y) AS positive_rate,
  avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, {tp} / CAST(nullif({tp} + {fp}, 0) AS DOUBLE) AS precision,
  {tp} / CAST(nullif({tp} + {fn}, 0) AS DOUBLE) AS recall, 2 * {tp} / CAST(nullif(2 * {tp} + {fp} + {fn}, 0) AS DOUBLE) AS f1,
  {fp} / CAST(nullif({tp} + {fp}, 0) AS DOUBLE) AS false_buy_pct, {fn} / CAST(nullif({tn} + {fn}, 0) AS DOUBLE) AS false_sell_pct,
  avg((p - y) * (p - y)) AS brier, stddev_samp((p - y) * (p - y)) / sqrt(count(*)) AS brier_se,
  -avg(CASE WHEN y = 1 THEN ln(greatest(p, 1e-9)) ELSE ln(1 - least(p, 1 - 1e-9)) END) AS logloss,
  avg(p) AS prob_mean, stddev_pop(p) AS prob_std, min(p) AS prob_min, max(p) AS prob_max, count(DISTINCT round(p, 12)) AS distinct_levels,
  avg(CASE WHEN abs(p - 0.5) <= 0.02 THEN 1.0::DOUBLE ELSE 0 END) AS near_002, avg(CASE WHEN abs(p - 0.5) <= 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS near_005,
  avg(CASE WHEN abs(p - 0.5) <= 0.10 THEN 1.0::DOUBLE ELSE 0 END) AS near_010, avg(CASE WHEN abs(p - 0.5) <= 0.025 THEN 1.0::DOUBLE ELSE 0 END) AS near_half_share,
  avg(CASE WHEN p <= 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS near_zero_share, avg(CASE WHEN p >= 0.95 THEN 1.0::DOUBLE ELSE 0 END) AS near_one_share
  FROM {src} {g}) a, ({q_auc(keys, src=src)}) b, (SELECT {k}sum(n * gap) / sum(n) AS ece FROM (SELECT {k}count(*) AS n, abs(avg(p) - avg(y)) AS gap
  FROM (SELECT *, {_BIN} AS bin FROM {src}) GROUP BY {k}bin) {g}) c WHERE {on}"""


SCORE = """n:i, tp:i, fp:i, fn:i, tn:i, positive_rate:6, accuracy:6, precision:6, recall:6, f1:6, false_buy_pct:6, false_sell_pct:6,
brier:6, brier_se:6, logloss:6, ece:6, prob_mean:6, prob_std:6, prob_min:6, prob_max:6, distinct_levels:i, near_002:6, near_005:6,
near_010:6, near_half_share:6, near_zero_share:6, near_one_share:6, auc:6"""


@query("scorecard_by_model", "model, " + SCORE, q_score("model"))
def _(spark, sf):
    return metrics.scorecard(v.preds(spark, sf), ["model"])


@query("scorecard_by_symbol_fold", "symbol, fold:i, " + SCORE, q_score("symbol, fold"))
def _(spark, sf):
    return metrics.scorecard(v.preds(spark, sf), ["symbol", "fold"])


@query("scorecard_overall", SCORE, q_score(""))
def _(spark, sf):
    return metrics.scorecard(v.preds(spark, sf), [])


@query(
    "scorecard_narrow",
    "scope, key, metric, value:6",
    f"""SELECT 'model' AS scope, model AS key, unnest(['auc', 'brier', 'ece', 'accuracy']) AS metric, unnest([auc, brier, ece, accuracy]) AS value
FROM ({q_score('model')}) UNION ALL SELECT 'global', 'all', unnest(['auc', 'brier', 'ece', 'accuracy']), unnest([auc, brier, ece, accuracy]) FROM ({q_score('')})""",
)
def _(spark, sf):
    names = ["auc", "brier", "ece", "accuracy"]
    p = v.preds(spark, sf)
    return metrics.narrow(metrics.scorecard(p, ["model"]), "model", "model", names).unionByName(
        metrics.narrow(metrics.scorecard(p, []), "global", None, names)
    )


@query("roc_auc", "symbol, model, auc:8", q_auc("symbol, model"))
def _(spark, sf):
    return ranking.auc(v.preds(spark, sf), ["symbol", "model"], "p", "y")


@query(
    "reliability_bins",
    "model, bin:i, count:i, predicted:6, actual:6",
    f"SELECT model, bin, count(*) AS count, avg(p) AS predicted, avg(y) AS actual FROM (SELECT *, {_BIN} AS bin FROM preds) GROUP BY model, bin",
)
def _(spark, sf):
    return metrics.reliability(v.preds(spark, sf), ["model"])


@query(
    "collapse_signature",
    "model, distinct_levels:i, near_005:6, collapse_flag:b",
    """SELECT *, distinct_levels <= 3 OR near_005 >= 0.9 AS collapse_flag FROM (SELECT model, count(DISTINCT round(p, 12)) AS distinct_levels,
  avg(CASE WHEN abs(p - 0.5) <= 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS near_005 FROM (
  SELECT model, CASE WHEN model = '5-LOW' THEN 0.5::DOUBLE + 0.02::DOUBLE * p WHEN model = '2-HIGH' THEN round(p, 0) ELSE p END AS p FROM preds) GROUP BY model)""",
)
def _(spark, sf):
    flat = (
        F.when(F.col("model") == "5-LOW", 0.5 + 0.02 * F.col("p"))
        .when(F.col("model") == "2-HIGH", F.round("p", 0))
        .otherwise(F.col("p"))
    )
    s = metrics.scorecard(v.preds(spark, sf).withColumn("p", flat), ["model"])
    return s.withColumn("collapse_flag", metrics.collapse_flag())


@query(
    "trade_metrics",
    "symbol, n_trades:i, win_rate:6, avg_return:6, profit_factor:6",
    """SELECT symbol, count(*) AS n_trades, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(ret) AS avg_return,
  sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0) AS profit_factor FROM preds GROUP BY symbol""",
)
def _(spark, sf):
    return metrics.trade_metrics(v.preds(spark, sf).withColumnRenamed("ret", "pl"), ["symbol"])


@query(
    "seed_average",
    "symbol, date:d, model, p:6, y:i",
    "SELECT symbol, date, model, avg(p) AS p, min(y) AS y FROM preds GROUP BY symbol, date, model",
)
def _(spark, sf):
    return metrics.average_seeds(v.preds(spark, sf), ["symbol", "date", "model"])


@query(
    "fold_weighted_means",
    "symbol, n:i, accuracy:6, brier:6",
    """SELECT symbol, sum(n) AS n, sum(a * n) / sum(n) AS accuracy, sum(b * n) / sum(n) AS brier FROM (SELECT symbol, fold, count(*) AS n,
  avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS a, avg((p - y) * (p - y)) AS b FROM preds GROUP BY 1, 2) GROUP BY symbol""",
)
def _(spark, sf):
    s = metrics.scorecard(v.preds(spark, sf), ["symbol", "fold"])
    return metrics.weighted_means(s, ["symbol"], ["accuracy", "brier"])




def by_customer(spark, sf):
    """Predictions with the customer as a fine-grained symbol."""
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("sym"))
    return v.preds(spark, sf).drop("symbol").join(o, "id").withColumn("symbol", F.concat(F.lit("C"), F.col("sym").cast("string")))


sql_view(
    "q_fine",
    "SELECT p.*, 'C' || CAST(o_custkey % 200 AS VARCHAR) AS fine FROM preds p JOIN orders ON id = o_orderkey",
)
sql_view("q_fine_auc", q_auc("fine", src="q_fine"))


@query(
    "cross_symbol_summary",
    "metric, mean:6, median:6, std:6, min:6, max:6, n:i",
    """SELECT 'auc' AS metric, avg(auc) AS mean, median(auc) AS median, stddev_pop(auc) AS std, min(auc) AS min, max(auc) AS max, count(auc) AS n FROM q_fine_auc
UNION ALL SELECT 'brier', avg(b), median(b), stddev_pop(b), min(b), max(b), count(b) FROM (SELECT fine, avg((p - y) * (p - y)) AS b FROM q_fine GROUP BY fine)""",
)
def _(spark, sf):
    return metrics.summarize(metrics.scorecard(by_customer(spark, sf), ["symbol"]), ["auc", "brier"])


@query(
    "true_and_upper_median",
    "symbol, true_median:6, upper_median:6",
    """SELECT symbol, median(ret) AS true_median, list_sort(list(ret))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper_median FROM preds GROUP BY symbol""",
)
def _(spark, sf):
    return metrics.both_medians(v.preds(spark, sf), ["symbol"], "ret")


@query(
    "exact_quantiles",
    "model, q05:6, q50:6, q95:6",
    "SELECT model, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.5) AS q50, quantile_cont(ret, 0.95) AS q95 FROM preds GROUP BY model",
)
def _(spark, sf):
    return ranking.quantiles(v.preds(spark, sf), ["model"], "ret", {"q05": 0.05, "q50": 0.5, "q95": 0.95})


sql_view(
    "q_bench",
    """SELECT a.fine AS symbol, a.auc, b.acc - greatest(b.up, 1 - b.up) AS edge, b.cum AS cum_return, b.hold AS buy_hold_return, b.pf AS profit_factor, b.n AS n_trades, b.lv <= 3 AS collapse_flag,
  b.bad AS ok, b.meth AS method FROM q_fine_auc a JOIN (SELECT fine, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(y) AS up,
    sum(ret) FILTER (p >= 0.5) AS cum, sum(ret) AS hold, sum(ret) FILTER (ret > 0 AND p >= 0.5) / -sum(ret) FILTER (ret < 0 AND p >= 0.5) AS pf, count(*) FILTER (p >= 0.98) AS n, count(DISTINCT round(p, 12)) AS lv,
    count(*) FILTER (p < 0.01) < 3 AS bad, CASE WHEN count(*) < 60 THEN 'uncalibrated' ELSE 'platt' END AS meth FROM q_fine GROUP BY fine) b ON a.fine = b.fine""",
)


def bench_table(spark, sf):
    p = by_customer(spark, sf)
    s = metrics.scorecard(p, ["symbol"])
    long = F.col("p") >= 0.5
    extra = p.groupBy("symbol").agg(
        F.sum(F.when(long, F.col("ret"))).alias("cum_return"),
        F.sum("ret").alias("buy_hold_return"),
        F.try_divide(
            F.sum(F.when(long & (F.col("ret") > 0), F.col("ret"))), -F.sum(F.when(long & (F.col("ret") < 0), F.col("ret")))
        ).alias("profit_factor"),
        F.count_if(F.col("p") >= 0.98).alias("n_trades"),
        (F.count_if(F.col("p") < 0.01) < 3).alias("ok"),
        F.when(F.count(F.lit(1)) < 60, "uncalibrated").otherwise("platt").alias("method"),
    )
    return s.join(extra, "symbol").withColumns(
        {
            "edge": F.col("accuracy") - F.greatest("positive_rate", 1 - F.col("positive_rate")),
            "always_up_return": F.col("buy_hold_return"),
            "collapse_flag": F.col("distinct_levels") <= 3,
        }
    )


@query(
    "benchmark_counts",
    """symbols:i, auc_gt_050:i, auc_gt_055:i, auc_le_050:i, beats_best_baseline:i, worse_than_best_baseline:i, beats_buy_hold:i,
    profit_factor_ge_1:i, collapsed:i, few_trades_lt_5:i, negative_cum_return:i, weak_auc:i, useful_auc:i""",
    """SELECT count(*) AS symbols, count(*) FILTER (auc > 0.5) AS auc_gt_050, count(*) FILTER (auc > 0.55) AS auc_gt_055, count(*) FILTER (auc <= 0.5) AS auc_le_050,
  count(*) FILTER (edge > 0) AS beats_best_baseline, count(*) FILTER (edge <= 0) AS worse_than_best_baseline, count(*) FILTER (cum_return > buy_hold_return) AS beats_buy_hold,
  count(*) FILTER (profit_factor >= 1) AS profit_factor_ge_1, count(*) FILTER (collapse_flag) AS collapsed, count(*) FILTER (n_trades < 5) AS few_trades_lt_5,
  count(*) FILTER (cum_return < 0) AS negative_cum_return, count(*) FILTER (auc > 0.5 AND auc < 0.55) AS weak_auc, count(*) FILTER (auc >= 0.55) AS useful_auc FROM q_bench""",
)
def _(spark, sf):
    return metrics.benchmark_counts(bench_table(spark, sf))


@query(
    "data_quality_issues",
    "symbol, issue",
    """SELECT symbol, 'unavailable' AS issue FROM q_bench WHERE NOT ok UNION ALL SELECT symbol, 'uncalibrated' FROM q_bench WHERE ok AND method = 'uncalibrated'
UNION ALL SELECT symbol, 'probability_collapse' FROM q_bench WHERE ok AND collapse_flag UNION ALL SELECT symbol, 'buy_hold_baseline_missing' FROM q_bench WHERE ok AND buy_hold_return IS NULL""",
)
def _(spark, sf):
    return metrics.data_quality_issues(bench_table(spark, sf))


_REGIME = {1: "bull", 0: "sideways", -1: "bear"}
sql_view(
    "q_regimed",
    """SELECT p.*, CASE WHEN regime_trend = 1 THEN '1:bull' WHEN regime_trend = 0 THEN '0:sideways' WHEN regime_trend = -1 THEN '-1:bear' ELSE 'unknown' END AS bucket
FROM preds p LEFT JOIN q_trend t ON t.date = p.date""",
)


def regimed(spark, sf):
    from ..operators import market

    return v.preds(spark, sf).join(market.trend_regime(v.market(spark, sf)).drop("close"), "date", "left")


@query(
    "regime_buckets",
    "bucket, n:i, roc_auc:6, up_rate:6, prob_mean:6, prob_std:6",
    f"""SELECT a.bucket, a.n, b.auc AS roc_auc, up_rate, prob_mean, prob_std FROM (SELECT bucket, count(*) AS n, avg(y) AS up_rate, avg(p) AS prob_mean, stddev_pop(p) AS prob_std
FROM q_regimed GROUP BY bucket) a JOIN ({q_auc('bucket', src='q_regimed')}) b ON a.bucket = b.bucket""",
)
def _(spark, sf):
    return metrics.regime_buckets(regimed(spark, sf), "regime_trend", _REGIME)


@query(
    "regime_joined_predictions",
    "id:i, regime_trend:0",
    "SELECT id, regime_trend FROM preds p LEFT JOIN q_trend t ON t.date = p.date WHERE regime_trend IS NOT NULL",
)
def _(spark, sf):
    return regimed(spark, sf).where(F.col("regime_trend").isNotNull())


sql_view(
    "q_deltas",
    f"""SELECT a.symbol, a.fold, a.auc AS candidate_auc, b.auc AS reference_auc, a.auc - b.auc AS delta
FROM ({q_auc('symbol, fold', 'q')}) a JOIN ({q_auc('symbol, fold')}) b ON a.symbol = b.symbol AND a.fold = b.fold""",
)


@query("auc_deltas", "symbol, fold:i, candidate_auc:6, reference_auc:6, delta:6", "SELECT * FROM q_deltas")
def _(spark, sf):
    return metrics.auc_deltas(v.preds(spark, sf), ["symbol", "fold"], "q", "p")


@query(
    "win_loss_ties",
    "wins:i, losses:i, ties:i, n_symbols:i",
    """SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, count(*) AS n_symbols
FROM (SELECT symbol, median(delta) AS d FROM q_deltas GROUP BY symbol)""",
)
def _(spark, sf):
    return metrics.win_loss(metrics.auc_deltas(v.preds(spark, sf), ["symbol", "fold"], "q", "p"))


@query(
    "fold_seed_robustness",
    "fold_win_ratio:6, fold_robust:b, seed_stable:b",
    f"""SELECT w AS fold_win_ratio, w >= 0.6 AS fold_robust, s AS seed_stable FROM (SELECT avg(CASE WHEN a.auc - b.auc > 0 THEN 1.0::DOUBLE ELSE 0 END) AS w
  FROM ({q_auc('fold', 'q')}) a JOIN ({q_auc('fold')}) b ON a.fold = b.fold),
  (SELECT count(*) >= 2 AND count(DISTINCT a.auc - b.auc > 0) = 1 AS s FROM ({q_auc('seed', 'q')}) a JOIN ({q_auc('seed')}) b ON a.seed = b.seed)""",
)
def _(spark, sf):
    p = v.preds(spark, sf)
    return metrics.robustness(metrics.auc_deltas(p, ["fold"], "q", "p"), metrics.auc_deltas(p, ["seed"], "q", "p"))


sql_view("q_units", "SELECT date, avg(ret) AS ret FROM preds GROUP BY date")
_DRAWN = " + ".join(f"CASE WHEN u > CAST({x!r} AS DOUBLE) THEN 1 ELSE 0 END" for x in bootstrap.POISSON)


@query(
    "bootstrap_interval",
    "mean:6, ci_lower:6, ci_upper:6, se:6",
    f"""SELECT (SELECT avg(ret) FROM q_units) AS mean, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper, stddev_samp(m) AS se FROM (
  SELECT b, sum(w * ret) / sum(w) AS m FROM (SELECT b, ret, {_DRAWN} AS w FROM (
    SELECT b, ret, CAST(CAST('0x' || substr(md5('42:' || b || ':' || CAST(date AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
    FROM q_units, range(1, 1001) r(b) WHERE ret IS NOT NULL)) GROUP BY b)""",
)
def _(spark, sf):
    units = v.preds(spark, sf).groupBy("date").agg(F.avg("ret").alias("ret"))
    return bootstrap.mean_interval(units, "ret", "date")


@query(
    "matched_sample",
    "symbol, date:d, p:6, cand_a:6, cand_b:6",
    """SELECT r.symbol, r.date, r.p, a.p AS cand_a, b.p AS cand_b FROM (SELECT symbol, date, avg(p) AS p FROM preds WHERE model = '1-URGENT' GROUP BY 1, 2) r
JOIN (SELECT symbol, date, avg(p) AS p FROM preds WHERE model = '2-HIGH' GROUP BY 1, 2) a ON a.symbol = r.symbol AND a.date = r.date
JOIN (SELECT symbol, date, avg(p) AS p FROM preds WHERE model = '5-LOW' GROUP BY 1, 2) b ON b.symbol = r.symbol AND b.date = r.date""",
)
def _(spark, sf):
    p = v.preds(spark, sf).withColumnRenamed("p", "prob")
    ref = p.where("model = '1-URGENT'").groupBy("symbol", "date").agg(F.avg("prob").alias("p"))
    return joins.matched_sample(
        ref, {"cand_a": p.where("model = '2-HIGH'"), "cand_b": p.where("model = '5-LOW'")}
    )


sql_view("q_resid", "SELECT model, ret AS y, (p - 0.5) * 0.2 AS pred, 0.05::DOUBLE AS sigma, ret - (p - 0.5) * 0.2 AS e, p FROM preds")


def residuals(spark, sf):
    return v.preds(spark, sf).select(
        "model", "p", F.col("ret").alias("y"), ((F.col("p") - 0.5) * 0.2).alias("pred"), F.lit(0.05).alias("sigma")
    )


@query(
    "residual_risk",
    "model, n:i, rmse:6, mae:6, bias:6, corr:6, mad:6",
    """SELECT model, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, -avg(e) AS bias, corr(y, pred) AS corr, mad(e) AS mad FROM q_resid GROUP BY model""",
)
def _(spark, sf):
    return metrics.residual_risk(residuals(spark, sf), ["model"], "y", "pred")


@query(
    "prediction_band",
    "model, q_lower:6, q_upper:6",
    "SELECT model, quantile_cont(pred - 1.96 * sigma, 0.05) AS q_lower, quantile_cont(pred + 1.96 * sigma, 0.95) AS q_upper FROM q_resid GROUP BY model",
)
def _(spark, sf):
    return metrics.prediction_band(residuals(spark, sf), ["model"], "pred", "sigma")


@query(
    "entropy_interaction",
    "n:i, corr:6, interpretation",
    """SELECT n, c AS corr, CASE WHEN abs(c) > 0.3 THEN 'entropy_reduces_regret' WHEN abs(c) > 0.15 THEN 'moderate_signal' ELSE 'no_signal' END AS interpretation
FROM (SELECT count(*) AS n, corr(-(p * ln(p) + (1 - p) * ln(1 - p)), abs(e)) AS c FROM q_resid WHERE p > 0 AND p < 1)""",
)
def _(spark, sf):
    return metrics.entropy_interaction(residuals(spark, sf).withColumn("error", F.col("y") - F.col("pred")))


@query(
    "accuracy_vs_constant",
    "model, n:i, accuracy:6, always_up:6, always_down:6, best_baseline:6, edge:6, effective_windows:i",
    """SELECT *, greatest(always_up, always_down) AS best_baseline, accuracy - greatest(always_up, always_down) AS edge, ceil(n / 20.0) AS effective_windows FROM (
  SELECT model, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg(y) AS always_up, 1 - avg(y) AS always_down FROM preds GROUP BY model)""",
)
def _(spark, sf):
    return metrics.accuracy_vs_constant(v.preds(spark, sf), ["model"])


@query(
    "position_counts",
    "model, direction_mean:6, n_positions:i, n_flat:i, all_long_pct:6",
    """SELECT model, avg(p) AS direction_mean, count(*) FILTER (p >= 0.5) AS n_positions, count(*) FILTER (p < 0.5) AS n_flat,
  avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS all_long_pct FROM preds GROUP BY model""",
)
def _(spark, sf):
    return metrics.position_counts(v.preds(spark, sf), ["model"])


@query(
    "train_medians",
    "fold:i, column, median:6",
    """SELECT fold, unnest(['ret', 'p', 'hollow']) AS "column", unnest([median(ret), median(p), 0.0::DOUBLE]) AS median FROM preds WHERE seed = 0 GROUP BY fold""",
)
def _(spark, sf):
    train = v.preds(spark, sf).where("seed = 0").withColumn("hollow", F.lit(None).cast("double"))
    return metrics.train_medians(train, ["fold"], ["ret", "p", "hollow"])


@query(
    "median_impute",
    "id:i, fold:i, x:6",
    """SELECT id, p.fold, coalesce(CASE WHEN id % 5 <> 0 THEN ret END, m) AS x FROM preds p JOIN (
  SELECT fold, median(CASE WHEN id % 5 <> 0 THEN ret END) AS m FROM preds WHERE seed = 0 GROUP BY fold) t ON t.fold = p.fold""",
)
def _(spark, sf):
    rows = v.preds(spark, sf).withColumn("x", F.when(F.col("id") % 5 != 0, F.col("ret"))).select("id", "fold", "seed", "x")
    med = metrics.train_medians(rows.where("seed = 0"), ["fold"], ["x"])
    return metrics.impute(rows, med, ["fold"], ["x"])


_BEST = {"price": False, "pe": False, "roe": True, "de": False, "opm": True}


@query(
    "compare_best",
    "metric, symbol",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CASE WHEN count({m}) >= 2 THEN arg_{'max' if up else 'min'}(symbol, struct_pack(a := {m}, b := {'-' if up else ''}CAST(substr(symbol, 2) AS BIGINT))) FILTER ({m} IS NOT NULL) END AS symbol FROM funda"
        for m, up in _BEST.items()
    ),
)
def _(spark, sf):
    f = v.funda(spark, sf).withColumn("seq", F.substring("symbol", 2, 12).cast("bigint"))
    return metrics.best_by_metric(f, _BEST, "seq")


# ---- drift ---------------------------------------------------------------------------

sql_view("q_ref", "SELECT * FROM preds WHERE date < DATE '1998-01-01'")
sql_view("q_cur", "SELECT * FROM preds WHERE date >= DATE '1998-01-01'")


def _psi_sql(feature, x):
    cond = " + ".join(f"CASE WHEN {x} >= lo + {i} * ((hi - lo) / 10) THEN 1 ELSE 0 END" for i in range(1, 10))
    return f"""SELECT '{feature}' AS feature, sum((c - r) * ln(c / r)) AS psi FROM (SELECT greatest(count(*) FILTER (s = 0) / CAST(sum(count(*) FILTER (s = 0)) OVER () AS DOUBLE), 1e-6) AS r,
  greatest(count(*) FILTER (s = 1) / CAST(sum(count(*) FILTER (s = 1)) OVER () AS DOUBLE), 1e-6) AS c FROM (SELECT s, {cond} AS b FROM (
    SELECT 0 AS s, {x} FROM q_ref UNION ALL SELECT 1, {x} FROM q_cur), (SELECT CASE WHEN max({x}) - min({x}) < 1e-6 THEN min({x}) - 1 ELSE min({x}) END AS lo,
    CASE WHEN max({x}) - min({x}) < 1e-6 THEN max({x}) + 1 ELSE max({x}) END AS hi FROM q_ref)) GROUP BY b)"""


sql_view("q_psi", " UNION ALL ".join(_psi_sql(x, x) for x in ("p", "ret", "q")))


def split_preds(spark, sf):
    p = v.preds(spark, sf)
    return p.where("date < DATE '1998-01-01'"), p.where("date >= DATE '1998-01-01'")


@query("psi_drift", "feature, psi:6, alarm:b", "SELECT feature, psi, psi > 0.25 AS alarm FROM q_psi")
def _(spark, sf):
    return drift.psi(*split_preds(spark, sf), ["p", "ret", "q"])


@query(
    "monitoring_report",
    """max_psi:6, prediction_psi:6, reference_brier:6, current_brier:6, delta_brier:6, age_days:i, freshness, mode, alarms:a""",
    """SELECT *, b2 - b1 AS delta_brier, b1 AS reference_brier, b2 AS current_brier, CASE WHEN age_days <= 7 THEN 'fresh' ELSE 'stale' END AS freshness,
  CASE WHEN age_days > 7 THEN 'stale' WHEN max_psi > 0.25 OR prediction_psi > 0.25 OR b2 - b1 > 0.05 THEN 'degraded' ELSE 'fresh' END AS mode,
  list_filter([CASE WHEN age_days > 7 THEN 'data_stale' END, CASE WHEN max_psi > 0.25 THEN 'feature_drift' END, CASE WHEN prediction_psi > 0.25 THEN 'prediction_drift' END,
    CASE WHEN b2 - b1 > 0.05 THEN 'calibration_drift' END], lambda x: x IS NOT NULL) AS alarms FROM (
  SELECT (SELECT max(psi) FROM q_psi WHERE feature <> 'p') AS max_psi, (SELECT psi FROM q_psi WHERE feature = 'p') AS prediction_psi, (SELECT avg((p - y) * (p - y)) FROM q_ref) AS b1,
    (SELECT avg((p - y) * (p - y)) FROM q_cur) AS b2, (SELECT DATE '2001-12-31' - max(date) FROM q_cur) AS age_days)""",
)
def _(spark, sf):
    ref, cur = split_preds(spark, sf)
    sq = F.avg(F.pow(F.col("p") - F.col("y"), 2))
    from ..functions.tables import one_row

    brier = one_row(ref.agg(sq.alias("reference_brier")), cur.agg(sq.alias("current_brier")))
    return drift.monitoring_report(
        drift.psi(ref, cur, ["ret", "q"]),
        drift.psi(ref, cur, ["p"]),
        brier,
        cur.agg(F.max("date").alias("last_date")),
        "2001-12-31",
    )


@query(
    "source_status",
    "series_id, rows:i, data_end:d, age_days:i, status",
    """SELECT series_id, count(close) AS rows, max(date) AS data_end, DATE '2001-08-05' - max(date) AS age_days,
  CASE WHEN DATE '2001-08-05' - max(date) <= 7 THEN 'fresh' ELSE 'stale' END AS status FROM (SELECT * FROM series UNION ALL SELECT 'mkt', date, close FROM market) GROUP BY series_id""",
)
def _(spark, sf):
    return drift.source_status(_sources(spark, sf), "2001-08-05")


def _sources(spark, sf):
    return v.series(spark, sf).unionByName(v.market(spark, sf).withColumn("series_id", F.lit("mkt")))


@query(
    "system_status",
    "market_sources_stale:b, calibration_drift:b, forecast_degraded:b, status",
    """SELECT bool_or(DATE '2001-08-05' - m > 7) AS market_sources_stale, false AS calibration_drift, false AS forecast_degraded,
  CASE WHEN bool_or(DATE '2001-08-05' - m > 7) THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT series_id, max(date) AS m FROM (SELECT * FROM series UNION ALL SELECT 'mkt', date, close FROM market) GROUP BY series_id)""",
)
def _(spark, sf):
    ref, cur = split_preds(spark, sf)
    live = metrics.scorecard(cur, ["symbol"]).select("symbol", "n", "brier", "ece")
    stored = metrics.scorecard(ref, ["symbol"]).select("symbol", F.col("brier").alias("ref_brier"), F.col("ece").alias("ref_ece"))
    return drift.system_status(
        drift.source_status(_sources(spark, sf), "2001-08-05"), "fresh", drift.calibration_status(live, stored)
    )


# ---- forward scoring -----------------------------------------------------------------

sql_view(
    "q_outcome",
    f"""SELECT f.*, b.close AS bar_close, b.exit_close, b.exit_date, coalesce(entry_at, b.close) AS entry, b.exit_close / coalesce(entry_at, b.close) - 1 AS r
FROM (SELECT prediction_id, symbol, as_of, probability, CASE WHEN CAST(prediction_id AS BIGINT) % 3 = 0 THEN close / 100 END AS entry_at FROM forecasts WHERE probability IS NOT NULL) f
ASOF LEFT JOIN (SELECT symbol, date, close, lead(close, 20) {LAG} AS exit_close, lead(date, 20) {LAG} AS exit_date FROM bars WHERE day(date) NOT IN (6, 7)) b
  ON b.symbol = f.symbol AND b.date >= CAST(f.as_of AS DATE)""",
)


def outcomes(spark, sf):
    f = forecasts(spark, sf).where("probability IS NOT NULL").withColumn(
        "close", F.when(F.col("prediction_id").cast("bigint") % 3 == 0, F.col("close") / 100)
    )
    # Bars with holes, so that a prediction may have to wait for the next one.
    bars = v.bars(spark, sf).where(~F.dayofmonth("date").isin(6, 7))
    return joins.forward_outcome(f.drop("scored"), bars, 20)


@query(
    "realised_outcomes",
    "prediction_id, exit_date:d, realised_return:4, label_up:b, scored:b",
    "SELECT prediction_id, exit_date, round(r, 6) AS realised_return, CASE WHEN r IS NOT NULL THEN r > 0 END AS label_up, r IS NOT NULL AS scored FROM q_outcome",
)
def _(spark, sf):
    return outcomes(spark, sf)


@query(
    "forward_scorecard",
    """symbol, n_logged:i, n_scored:i, n_waiting:i, accuracy:4, brier:4, up_rate:4, best_baseline_accuracy:4, edge:4, hit_rate_up:4, is_sufficient:b""",
    """SELECT symbol, n_logged, n_scored, n_logged - n_scored AS n_waiting, acc AS accuracy, brier, up AS up_rate, greatest(up, 1 - up) AS best_baseline_accuracy,
  acc - greatest(up, 1 - up) AS edge, hr AS hit_rate_up, n_scored >= 5 AS is_sufficient FROM (SELECT symbol, count(*) AS n_logged, count(r) AS n_scored,
    avg(CASE WHEN (probability >= 0.5) = (r > 0) THEN 1.0::DOUBLE ELSE 0 END) FILTER (r IS NOT NULL) AS acc, avg(power(probability - CASE WHEN r > 0 THEN 1 ELSE 0 END, 2)) FILTER (r IS NOT NULL) AS brier,
    avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (r IS NOT NULL) AS up, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (r IS NOT NULL AND probability >= 0.5) AS hr FROM q_outcome GROUP BY ROLLUP (symbol))""",
)
def _(spark, sf):
    return drift.forward_scorecard(outcomes(spark, sf))


@query(
    "calibration_drift_report",
    "symbol, n_recent:i, brier:4, ece:4, delta_brier:4, delta_ece:4, status, is_alarm:b",
    f"""SELECT coalesce(l.symbol, r.symbol) AS symbol, coalesce(l.n, 0) AS n_recent, l.brier, l.ece, CASE WHEN r.symbol IS NOT NULL THEN l.brier - r.brier END AS delta_brier,
  CASE WHEN r.symbol IS NOT NULL THEN l.ece - r.ece END AS delta_ece, CASE WHEN coalesce(l.n, 0) = 0 THEN 'no_scored_predictions' WHEN r.symbol IS NULL THEN 'no_reference'
  WHEN l.n < 5 THEN 'insufficient_sample' WHEN l.brier - r.brier > 0.05 THEN 'drift_detected' ELSE 'ok' END AS status,
  coalesce(l.n >= 5 AND l.brier - r.brier > 0.05, false) AS is_alarm FROM ({q_score('symbol', 'q_live')}) l FULL JOIN ({q_score('symbol', 'q_old')}) r ON l.symbol = r.symbol""",
)
def _(spark, sf):
    p = by_customer(spark, sf)
    live = metrics.scorecard(p.where("date >= DATE '1996-01-01'"), ["symbol"]).select("symbol", "n", "brier", "ece")
    old = metrics.scorecard(p.where("date < DATE '1996-01-01'"), ["symbol"]).select(
        "symbol", F.col("brier").alias("ref_brier"), F.col("ece").alias("ref_ece")
    )
    return drift.calibration_status(live, old)


sql_view("q_live", "SELECT * EXCLUDE (symbol, fine), fine AS symbol FROM q_fine WHERE date >= DATE '1996-01-01'")
sql_view("q_old", "SELECT * EXCLUDE (symbol, fine), fine AS symbol FROM q_fine WHERE date < DATE '1996-01-01'")


# ---- ledger --------------------------------------------------------------------------

H, CAP = 20, 100000.0
_RT = "2 * (20 + 0.0001::DOUBLE * close + 0.001::DOUBLE * close) / close"
sql_view(
    "q_signals",
    """SELECT symbol, date, arg_min(dir, id) AS direction, avg(p) AS p FROM (SELECT *, CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.3 THEN -1 ELSE 0 END AS dir FROM preds)
WHERE dir <> 0 GROUP BY symbol, date""",
)
sql_view(
    "q_book",
    f"""SELECT *, {CAP / H} * ({_RT}) AS cost, x / close - 1 AS ret, direction * {CAP / H} * (x / close - 1) - {CAP / H} * ({_RT}) AS pl FROM (
  SELECT b.symbol, b.date, b.close, s.direction, lead(b.close, {H}) OVER k AS x, lead(b.date, {H}) OVER k AS xd, row_number() OVER k AS rn
  FROM bars b LEFT JOIN q_signals s ON s.symbol = b.symbol AND s.date = b.date WINDOW k AS (PARTITION BY b.symbol ORDER BY b.date))""",
)


def signals(spark, sf):
    p = F.col("p")
    raw = v.preds(spark, sf).withColumn("direction", F.when(p >= 0.6, 1).when(p <= 0.3, -1).otherwise(0))
    return ledger.first_signals(raw, ["symbol"], ["id"])


def the_book(spark, sf):
    return ledger.book(v.bars(spark, sf), signals(spark, sf), H, CAP)


@query("signal_admission", "symbol, date:d, direction:0", "SELECT symbol, date, direction FROM q_signals")
def _(spark, sf):
    return signals(spark, sf)


@query(
    "trade_costs",
    "symbol, date:d, side:8, round:8",
    f"SELECT symbol, date, ({_RT}) / 2 AS side, {_RT} AS round FROM bars",
)
def _(spark, sf):
    return v.bars(spark, sf).select("symbol", "date", ledger.side_cost("close").alias("side"), ledger.round_trip("close").alias("round"))


@query(
    "ledger_trades",
    "symbol, entry_date:d, exit_date:d, direction:0, entry:6, exit:6, notional:2, cost:6, ret:6, pl:4",
    f"""SELECT symbol, date AS entry_date, xd AS exit_date, direction, close AS entry, x AS exit, {CAP / H} AS notional, cost, ret, pl
FROM q_book WHERE direction IS NOT NULL AND x IS NOT NULL""",
)
def _(spark, sf):
    return ledger.trades(the_book(spark, sf))


sql_view(
    "q_equity",
    f"""SELECT t.symbol, t.date, {CAP} - coalesce(sum(o.direction * {CAP / H} + o.cost), 0) + coalesce(sum(CASE WHEN o.rn <= t.rn - {H} THEN o.direction * {CAP / H} / o.close * o.x
  ELSE o.direction * {CAP / H} / o.close * t.close END), 0) AS equity, count(o.rn) FILTER (o.rn > t.rn - {H}) AS concurrent
FROM q_book t LEFT JOIN (SELECT * FROM q_book WHERE direction IS NOT NULL AND x IS NOT NULL) o ON o.symbol = t.symbol AND o.rn <= t.rn GROUP BY t.symbol, t.date""",
)


@query("ledger_equity", "symbol, date:d, equity:2, concurrent:i", "SELECT * FROM q_equity")
def _(spark, sf):
    return ledger.equity(the_book(spark, sf), H, CAP)


@query(
    "leverage_guard",
    "symbol, max_concurrent:i, no_leverage_ok:b",
    f"SELECT symbol, max(concurrent) AS max_concurrent, max(concurrent) <= {H} AS no_leverage_ok FROM q_equity GROUP BY symbol",
)
def _(spark, sf):
    curve = ledger.require_no_leverage(ledger.equity(the_book(spark, sf), H, CAP), CAP)
    return ledger.leverage_check(curve, H, CAP)


def q_curve(src, e="equity"):
    return f"""SELECT symbol, n AS n_days, l / f - 1 AS cum_return, dd AS max_dd, m AS avg_daily_return, m / s * sqrt(252) AS sharpe, m / nullif(d, 0) * sqrt(252) AS sortino,
  power(l / f, 252.0::DOUBLE / (n - 1)) - 1 AS annualized_return, s * sqrt(252) AS annualized_volatility, (power(l / f, 252.0::DOUBLE / (n - 1)) - 1) / abs(dd) AS calmar FROM (
  SELECT symbol, count(*) AS n, arg_min({e}, date) AS f, arg_max({e}, date) AS l, min({e} / peak - 1) AS dd, avg(r) AS m, stddev_pop(r) AS s, stddev_pop(r) FILTER (r < 0) AS d
  FROM (SELECT symbol, date, {e}, {e} / lag({e}) {LAG} - 1 AS r, max({e}) {LAG} AS peak FROM {src}) GROUP BY symbol)"""


CURVE = """symbol, n_days:i, cum_return:6, max_dd:6, avg_daily_return:8, sharpe:4, sortino:4, annualized_return:6, annualized_volatility:6, calmar:4"""


@query("equity_metrics", CURVE, q_curve("q_equity"))
def _(spark, sf):
    return ledger.equity_metrics(ledger.equity(the_book(spark, sf), H, CAP))


@query(
    "buy_and_hold",
    CURVE + ", accuracy:6",
    f"""SELECT c.*, a.accuracy FROM ({q_curve('bars', 'close')}) c JOIN (SELECT symbol, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret <= 0 THEN 0 END) AS accuracy FROM q_labels GROUP BY symbol) a ON a.symbol = c.symbol""",
)
def _(spark, sf):
    return ledger.buy_and_hold(v.bars(spark, sf), H, CAP)


def strategy_signals(spark, sf):
    p = metrics.average_seeds(v.preds(spark, sf), ["symbol", "date"])
    labels = labelled(spark, sf).select(
        "symbol", "date", F.col("target_ret_20d").alias("ret"), F.col("target_up_20d").alias("up")
    )
    return p.drop("y").join(labels, ["symbol", "date"]).select(
        "symbol", "date", "p", F.col("up").alias("y"), "ret", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("direction")
    )


@query(
    "strategy_metrics",
    """symbol, n_days:i, n_trades:i, win_rate:6, avg_return:4, profit_factor:6, max_concurrent:i, no_leverage_ok:b, trade_accuracy:6, accuracy:6, precision:6,
    recall:6, calibration_brier:6, roc_auc:6, cum_return:6, max_dd:6""",
    f"""WITH sg AS (SELECT p.symbol, p.date, p.p, CAST(l.label_binary AS DOUBLE) AS y, l.ret, CASE WHEN p.p >= 0.5 THEN 1 ELSE 0 END AS direction FROM (SELECT symbol, date, avg(p) AS p FROM preds GROUP BY 1, 2) p
  JOIN q_labels l ON l.symbol = p.symbol AND l.date = p.date),
b AS (SELECT b.symbol, b.date, b.close, nullif(s.direction, 0) AS direction, lead(b.close, {H}) OVER k AS x, row_number() OVER k AS rn FROM bars b
  JOIN (SELECT symbol, min(date) AS d0 FROM sg GROUP BY symbol) z ON z.symbol = b.symbol AND b.date >= z.d0
  LEFT JOIN sg s ON s.symbol = b.symbol AND s.date = b.date WINDOW k AS (PARTITION BY b.symbol ORDER BY b.date)),
o AS (SELECT *, {CAP / H} * ({_RT}) AS cost, direction * {CAP / H} * (x / close - 1) - {CAP / H} * ({_RT}) AS pl FROM b WHERE direction IS NOT NULL AND x IS NOT NULL),
eq AS (SELECT t.symbol, t.date, {CAP} - coalesce(sum(o.direction * {CAP / H} + o.cost), 0) + coalesce(sum(CASE WHEN o.rn <= t.rn - {H} THEN o.direction * {CAP / H} / o.close * o.x
  ELSE o.direction * {CAP / H} / o.close * t.close END), 0) AS equity, count(o.rn) FILTER (o.rn > t.rn - {H}) AS concurrent FROM b t LEFT JOIN o ON o.symbol = t.symbol AND o.rn <= t.rn GROUP BY t.symbol, t.date),
sgy AS (SELECT * FROM sg WHERE y IS NOT NULL)
SELECT c.*, tr.n_trades, tr.win_rate, tr.avg_return, tr.profit_factor, mc AS max_concurrent, mc <= {H} AS no_leverage_ok, cl.accuracy, cl.precision, cl.recall, cl.calibration_brier, u.auc AS roc_auc, ta.trade_accuracy
FROM ({q_curve('eq')}) c JOIN (SELECT symbol, max(concurrent) AS mc FROM eq GROUP BY symbol) g ON g.symbol = c.symbol
JOIN (SELECT symbol, count(*) AS n_trades, avg(CASE WHEN pl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(pl) AS avg_return, sum(pl) FILTER (pl > 0) / -sum(pl) FILTER (pl < 0) AS profit_factor FROM o GROUP BY symbol) tr ON tr.symbol = c.symbol
JOIN (SELECT symbol, avg(CASE WHEN direction = y THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) FILTER (direction = 1 AND y = 1) / CAST(count(*) FILTER (direction = 1) AS DOUBLE) AS precision,
  count(*) FILTER (direction = 1 AND y = 1) / CAST(count(*) FILTER (y = 1) AS DOUBLE) AS recall, avg((p - y) * (p - y)) AS calibration_brier FROM sgy GROUP BY symbol) cl ON cl.symbol = c.symbol
JOIN ({q_auc('symbol', src='sgy')}) u ON u.symbol = c.symbol
JOIN (SELECT symbol, avg(CASE WHEN ret * direction > 0 THEN 1.0::DOUBLE ELSE 0 END) AS trade_accuracy FROM sg WHERE direction <> 0 AND ret IS NOT NULL GROUP BY symbol) ta ON ta.symbol = c.symbol""",
)
def _(spark, sf):
    return ledger.strategy_metrics(v.bars(spark, sf), strategy_signals(spark, sf), H, CAP)
