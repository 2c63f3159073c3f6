"""Model and trade metrics as narrow aggregations.

Predictions are first counted per ``(keys, probability)``: every classification,
calibration and ranking metric follows from those counts, so raw rows are shuffled at
most once, already combined, and no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.tables import one_row
from ..functions.windows import correlation
from . import quality

EDGES = [i * 0.1 for i in range(1, 10)]


def calibration_bin(p: Column) -> Column:
    """Index of ten equal bins, lower edge closed, the last bin closed on both sides."""
    out = F.lit(0)
    for edge in EDGES:
        out = out + F.when(p >= edge, 1).otherwise(0)
    return out


def levels(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Rows and positives per key and distinct probability (clipped to [0, 1])."""
    prob = F.least(F.greatest(F.col(p).cast("double"), F.lit(0.0)), F.lit(1.0))
    return (
        df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(y).isNotNull())
        .groupBy(*keys, prob.alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(y) == 1).alias("_pos"))
    )


def _weighted(x: Column) -> Column:
    return F.try_divide(F.sum(F.col("_n") * x), F.sum("_n"))


def share(cond: Column) -> Column:
    return _weighted(F.when(cond, 1.0).otherwise(0.0))


def scorecard(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """All binary metrics per key: discrimination, classification, calibration, spread."""
    lv = levels(df, keys, p, y)
    prob, n, pos = F.col("_p"), F.col("_n"), F.col("_pos")
    neg = n - pos
    long = prob >= 0.5
    tp = F.sum(F.when(long, pos).otherwise(0))
    fp = F.sum(F.when(long, neg).otherwise(0))
    fn = F.sum(F.when(long, 0).otherwise(pos))
    tn = F.sum(F.when(long, 0).otherwise(neg))
    clipped = F.least(F.greatest(prob, F.lit(1e-9)), F.lit(1.0 - 1e-9))
    # One pass keeps bin and rank bucket apart; both are bounded per key.
    per_bin = lv.withColumn("_bin", calibration_bin(prob)).groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_bn"),
        F.sum(n * prob).alias("_bp"),
        F.sum("_pos").alias("_by"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        F.sum(pos * (prob - 1) * (prob - 1) + neg * prob * prob).alias("_sq"),
        F.sum(
            pos * F.pow(prob - 1, 4) + neg * F.pow(prob, 4)
        ).alias("_sq2"),
        F.sum(-pos * F.log(clipped) - neg * F.log(1 - clipped)).alias("_ll"),
        F.sum(n * prob * prob).alias("_pp"),
        F.min(prob).alias("_min"),
        F.max(prob).alias("_max"),
        F.count_distinct(F.round(prob, 12)).alias("_lv"),
        *[
            F.sum(F.when(F.abs(prob - 0.5) <= d, n).otherwise(0)).alias(f"_near{i}")
            for i, d in enumerate((0.02, 0.05, 0.10, 0.025))
        ],
        F.sum(F.when(prob <= 0.05, n).otherwise(0)).alias("_zero"),
        F.sum(F.when(prob >= 0.95, n).otherwise(0)).alias("_one"),
    )
    total = F.sum("_bn")

    def of(num: Column, den: Column) -> Column:
        return F.try_divide(num.cast("double"), den.cast("double"))

    s = {c: F.sum(c) for c in ("tp", "fp", "fn", "tn")}
    brier = of(F.sum("_sq"), total)
    # Sample deviation of the row losses from their first two moments.
    spread = (F.sum("_sq2") - F.sum("_sq") * F.sum("_sq") / total) / F.nullif(total - 1, F.lit(0))
    mean = of(F.sum("_bp"), total)
    out = per_bin.groupBy(*keys).agg(
        total.alias("n"),
        *[v.alias(k) for k, v in s.items()],
        of(s["tp"] + s["fn"], total).alias("positive_rate"),
        of(s["tp"] + s["tn"], total).alias("accuracy"),
        of(s["tp"], s["tp"] + s["fp"]).alias("precision"),
        of(s["tp"], s["tp"] + s["fn"]).alias("recall"),
        of(2 * s["tp"], F.nullif(2 * s["tp"] + s["fp"] + s["fn"], F.lit(0))).alias("f1"),
        of(s["fp"], s["tp"] + s["fp"]).alias("false_buy_pct"),
        of(s["fn"], s["tn"] + s["fn"]).alias("false_sell_pct"),
        brier.alias("brier"),
        F.sqrt(F.greatest(spread, F.lit(0.0)) / total).alias("brier_se"),
        of(F.sum("_ll"), total).alias("logloss"),
        of(F.sum(F.abs(F.col("_bp") - F.col("_by"))), total).alias("ece"),
        mean.alias("prob_mean"),
        F.sqrt(F.greatest(of(F.sum("_pp"), total) - mean * mean, F.lit(0.0))).alias("prob_std"),
        F.min("_min").alias("prob_min"),
        F.max("_max").alias("prob_max"),
        F.sum("_lv").alias("distinct_levels"),
        of(F.sum("_near0"), total).alias("near_002"),
        of(F.sum("_near1"), total).alias("near_005"),
        of(F.sum("_near2"), total).alias("near_010"),
        of(F.sum("_near3"), total).alias("near_half_share"),
        of(F.sum("_zero"), total).alias("near_zero_share"),
        of(F.sum("_one"), total).alias("near_one_share"),
    )
    area = auc_of_levels(lv, keys)
    return out.join(area, keys, "left") if keys else one_row(out, area)


def auc_of_levels(lv: DataFrame, keys: list[str]) -> DataFrame:
    """AUC from level counts: ranks inside buckets of the score, then across buckets."""
    return ranking.auc_of_counts(lv.withColumn("_neg", F.col("_n") - F.col("_pos")), keys, "_p", "_pos", "_neg").drop("n_pos", "n_neg")


def reliability(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    b = calibration_bin(F.col(p))
    return (
        df.where(F.col(p).isNotNull())
        .groupBy(*keys, b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"), F.avg(p).alias("predicted"), F.avg(y).alias("actual"))
        .withColumns({"bin_lo": F.col("bin") * 0.1, "bin_hi": (F.col("bin") + 1) * 0.1})
    )


def narrow(scores: DataFrame, scope: str, key: str | None, names: list[str]) -> DataFrame:
    """Scorecard rows as ``(scope, key, metric, value)``."""
    label = F.col(key).cast("string") if key else F.lit("all")
    wide = scores.select(
        F.lit(scope).alias("scope"), label.alias("key"), *[F.col(m).cast("double").alias(m) for m in names]
    )
    return wide.unpivot(["scope", "key"], names, "metric", "value")


def collapse_flag(levels_col: str = "distinct_levels", near: str = "near_005") -> Column:
    return (F.col(levels_col) <= 3) | F.coalesce(F.col(near) >= 0.9, F.lit(False))


def trade_metrics(trades: DataFrame, keys: list[str], pl: str = "pl") -> DataFrame:
    x = F.col(pl)
    gain = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))
    loss = -F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0))
    factor = F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf")))
    return trades.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.avg(x).alias("avg_return"),
        factor.alias("profit_factor"),
    )


def average_seeds(oof: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    return oof.groupBy(*keys).agg(F.avg(p).alias(p), F.min(y).alias(y))


def weighted_means(scores: DataFrame, keys: list[str], names: list[str], weight: str = "n") -> DataFrame:
    """Row-count-weighted mean of metrics over folds, ignoring NULL metrics."""
    return scores.groupBy(*keys).agg(
        F.sum(weight).alias("n"),
        *[
            F.try_divide(
                F.sum(F.col(m) * F.col(weight)), F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))
            ).alias(m)
            for m in names
        ],
    )


def summarize(scores: DataFrame, names: list[str]) -> DataFrame:
    """Mean, median, spread and range over symbols for each metric, finite values only."""
    wide = scores.select(*[F.col(m).cast("double").alias(m) for m in names])
    long = wide.unpivot([], names, "metric", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    )
    stats = long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("n"),
    )
    return stats.join(ranking.median(long, ["metric"], "value"), "metric")


def both_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """True median and the upper-middle convention side by side."""
    total = F.col("total")
    out = ranking.order_stats(
        df,
        keys,
        value,
        {"_lo": F.floor((total + 1) / 2), "_hi": F.floor(total / 2) + 1},
    )
    return out.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("true_median"), F.col("_hi").alias("upper_median"))


def benchmark_counts(symbols: DataFrame) -> DataFrame:
    """How many symbols pass each check. Expects auc, edge, cum_return, buy_hold_return,
    always_up_return, profit_factor, n_trades and the collapse inputs."""
    c = F.col
    checks = {
        "auc_gt_050": c("auc") > 0.5,
        "auc_gt_055": c("auc") > 0.55,
        "auc_le_050": c("auc") <= 0.5,
        "beats_best_baseline": c("edge") > 0,
        "worse_than_best_baseline": c("edge") <= 0,
        "beats_buy_hold": c("cum_return") > c("buy_hold_return"),
        "beats_always_up": c("cum_return") > c("always_up_return"),
        "profit_factor_ge_1": c("profit_factor") >= 1,
        "collapsed": c("collapse_flag"),
        "few_trades_lt_5": F.coalesce(c("n_trades"), F.lit(0)) < 5,
        "negative_cum_return": c("cum_return") < 0,
        "weak_auc": (c("auc") > 0.5) & (c("auc") < 0.55),
        "useful_auc": c("auc") >= 0.55,
    }
    return symbols.agg(
        F.count(F.lit(1)).alias("symbols"), *[F.count_if(cond).alias(k) for k, cond in checks.items()]
    )


def data_quality_issues(symbols: DataFrame) -> DataFrame:
    """``(symbol, issue)`` rows: unavailable, uncalibrated, collapsed, missing baseline."""
    ok = F.col("ok")
    rules = [
        ("unavailable", ~ok),
        ("uncalibrated", ok & (F.col("method") == "uncalibrated")),
        ("probability_collapse", ok & F.col("collapse_flag")),
        ("buy_hold_baseline_missing", ok & F.col("buy_hold_return").isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    return symbols.select("symbol", F.explode(found).alias("issue"))


def regime_buckets(preds: DataFrame, regime: str, names: dict[int, str], keys: list[str] | None = None) -> DataFrame:
    """Discrimination per regime level, ``unknown`` included; thin buckets keep only n."""
    keys = keys or []
    level = F.col(regime)
    label = F.lit("unknown")
    for value, name in names.items():
        label = F.when(level == value, f"{value}:{name}").otherwise(label)
    out = scorecard(preds.withColumn("bucket", label), [*keys, "bucket"])
    thin = F.col("n") < 5
    return out.select(
        *keys,
        "bucket",
        "n",
        *[
            F.when(~thin, F.col(a)).alias(b)
            for a, b in (
                ("auc", "roc_auc"),
                ("positive_rate", "up_rate"),
                ("prob_mean", "prob_mean"),
                ("prob_std", "prob_std"),
            )
        ],
    )


def auc_deltas(df: DataFrame, keys: list[str], candidate: str, reference: str, y: str = "y") -> DataFrame:
    """AUC of a candidate minus that of the reference on the same rows, per key."""
    seen = df.where(F.col(candidate).isNotNull() & F.col(reference).isNotNull())
    a = auc_of_levels(levels(seen, keys, candidate, y), keys).withColumnRenamed("auc", "candidate_auc")
    b = auc_of_levels(levels(seen, keys, reference, y), keys).withColumnRenamed("auc", "reference_auc")
    out = a.join(b, keys)
    return out.withColumn("delta", F.col("candidate_auc") - F.col("reference_auc"))


def win_loss(symbol_deltas: DataFrame, delta: str = "delta") -> DataFrame:
    """Symbols won, lost and tied by the sign of their median delta."""
    med = ranking.median(symbol_deltas, ["symbol"], delta, "d")
    return med.agg(
        F.count_if(F.col("d") > 0).alias("wins"),
        F.count_if(F.col("d") < 0).alias("losses"),
        F.count_if(F.col("d") == 0).alias("ties"),
        F.count(F.lit(1)).alias("n_symbols"),
    )


def robustness(fold_deltas: DataFrame, seed_deltas: DataFrame) -> DataFrame:
    """Share of folds won (at least 0.6) and one sign over at least two seeds."""
    won = F.try_divide(F.count_if(F.col("delta") > 0).cast("double"), F.count("delta"))
    folds = fold_deltas.agg(won.alias("fold_win_ratio"), F.coalesce(won >= 0.6, F.lit(False)).alias("fold_robust"))
    up = F.count_if(F.col("delta") > 0)
    seeds = seed_deltas.agg(
        ((F.count("delta") >= 2) & ((up == 0) | (up == F.count("delta")))).alias("seed_stable")
    )
    return one_row(folds, seeds)


def residual_risk(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """RMSE, MAE, bias, correlation and median absolute deviation of residuals."""
    rows = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).withColumn("_e", F.col(y) - F.col(pred))
    few = F.count(F.lit(1)) < 5
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(~few, F.sqrt(F.avg(F.col("_e") * F.col("_e")))).alias("rmse"),
        F.when(~few, F.avg(F.abs("_e"))).alias("mae"),
        F.when(~few, -F.avg("_e")).alias("bias"),
        F.when(~few, correlation(y, pred)).alias("corr"),
    )
    mid = ranking.median(rows, keys, "_e", "_mid")
    off = rows.join(mid, keys).withColumn("_off", F.abs(F.col("_e") - F.col("_mid")))
    mad = ranking.median(off, keys, "_off", "_mad")
    return base.join(mad, keys).withColumn("mad", F.when(F.col("n") >= 5, F.col("_mad"))).drop("_mad")


def prediction_band(df: DataFrame, keys: list[str], pred: str, sigma: str) -> DataFrame:
    """5th percentile of the lower and 95th of the upper 1.96-sigma bound."""
    rows = df.withColumns(
        {"_l": F.col(pred) - 1.96 * F.col(sigma), "_u": F.col(pred) + 1.96 * F.col(sigma)}
    )
    low = ranking.quantiles(rows, keys, "_l", {"q_lower": 0.05}).drop("total")
    high = ranking.quantiles(rows, keys, "_u", {"q_upper": 0.95}).drop("total")
    return low.join(high, keys)


def binary_entropy(p: Column) -> Column:
    return -(p * F.log(F.greatest(p, F.lit(1e-12))) + (1 - p) * F.log(F.greatest(1 - p, F.lit(1e-12))))


def entropy_interaction(df: DataFrame, p: str = "p", error: str = "error") -> DataFrame:
    x = F.col(p)
    rows = df.where((x > 0) & (x < 1) & F.col(error).isNotNull()).select(
        binary_entropy(x).alias("h"), F.abs(error).alias("e")
    )
    flat = (F.stddev_pop("h") < 1e-10) | (F.stddev_pop("e") < 1e-10)
    n = F.count(F.lit(1))
    corr = F.when(n < 30, None).when(flat, 0.0).otherwise(correlation("h", "e"))
    out = rows.agg(n.alias("n"), corr.alias("corr"), flat.alias("_flat"))
    size = F.abs("corr")
    label = (
        F.when(F.col("n") < 30, "insufficient_data")
        .when(F.col("_flat"), "zero_variance")
        .when(size > 0.3, "entropy_reduces_regret")
        .when(size > 0.15, "moderate_signal")
        .otherwise("no_signal")
    )
    return out.withColumn("interpretation", label).drop("_flat")


def accuracy_vs_constant(df: DataFrame, keys: list[str], horizon: int = 20, p: str = "p", y: str = "y") -> DataFrame:
    up = F.avg((F.col(y) >= 0.5).cast("double"))
    acc = F.avg(((F.col(p) >= 0.5) == (F.col(y) >= 0.5)).cast("double"))
    out = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), acc.alias("accuracy"), up.alias("always_up"), (1 - up).alias("always_down")
    )
    best = F.greatest("always_up", "always_down")
    return out.withColumns(
        {
            "best_baseline": best,
            "edge": F.col("accuracy") - best,
            "effective_windows": F.ceil(F.col("n") / horizon),
        }
    )


def position_counts(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    long = F.col(p) >= 0.5
    return df.groupBy(*keys).agg(
        F.avg(p).alias("direction_mean"),
        F.count_if(long).alias("n_positions"),
        F.count_if(~long).alias("n_flat"),
        F.avg(long.cast("double")).alias("all_long_pct"),
    )


def train_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Median per column and fold of the training rows, 0 where a column is empty."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, "column", "value"
    )
    med = ranking.median(long, [*keys, "column"], "value")
    wanted = df.select(*keys).distinct().withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns])))
    return wanted.join(med, [*keys, "column"], "left").withColumn(
        "median", F.coalesce("median", F.lit(0.0))
    )


def impute(df: DataFrame, medians: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fill train and test rows with the medians of their fold's training rows."""
    wide = medians.groupBy(*keys).pivot("column", columns).agg(F.max("median"))
    wide = wide.withColumnsRenamed({c: f"_m_{c}" for c in columns})
    out = df.join(wide, keys)
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def best_by_metric(df: DataFrame, higher: dict[str, bool], order: str) -> DataFrame:
    """Best symbol per metric, first in input order on ties, NULL under two values."""
    names = list(higher)
    long = df.select("symbol", order, *[F.col(m).cast("double").alias(m) for m in names]).unpivot(
        ["symbol", order], names, "metric", "value"
    )
    direction = F.lit(1.0)
    for m in names:
        direction = F.when(F.col("metric") == m, 1.0 if higher[m] else -1.0).otherwise(direction)
    known = long.where(F.col("value").isNotNull())
    best = known.groupBy("metric").agg(
        F.max_by("symbol", F.struct(direction * F.col("value"), -F.col(order))).alias("symbol"),
        F.count(F.lit(1)).alias("n"),
    )
    return best.select("metric", F.when(F.col("n") >= 2, F.col("symbol")).alias("symbol"))
