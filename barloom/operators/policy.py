"""Decision policies over probabilities: signals, ensembles, selective and conformal rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from . import metrics

# Default thresholds of the signal policy.
BUY, SELL, FLOOR, BEAR_BUY = 0.6, 0.4, 0.08, 0.62
MIN_AUC = 0.55

# Selective rules (name, kind, threshold).
RULES = [
    ("always_accept", "always", None),
    ("margin_005", "margin", 0.05),
    ("margin_010", "margin", 0.10),
    ("margin_015", "margin", 0.15),
    ("disagreement_005", "disagreement", 0.05),
    ("disagreement_010", "disagreement", 0.10),
    ("candidate_a_entropy", "entropy", 0.65),
    ("candidate_b_disagreement", "disagreement", 0.05),
    ("entropy_065", "entropy", 0.65),
    ("conformal_90", "conformal", None),
]


def decide(
    df: DataFrame,
    prob: str = "p",
    thresholds: DataFrame | None = None,
    trend: str | None = None,
    risk: str | None = None,
    buy: float = BUY,
    sell: float = SELL,
    floor: float = FLOOR,
    allow_short: bool = False,
) -> DataFrame:
    """BUY / HOLD / SELL per row. ``thresholds`` is ``(symbol, buy)`` for symbols with
    their own buy level; a bear or risk-off regime lifts the level to 0.62."""
    if not (0 <= sell < buy <= 1 and 0 <= floor <= 1):
        raise ValueError("thresholds must satisfy 0 <= sell < buy <= 1")
    out = df
    tb = F.lit(float(buy))
    if thresholds is not None:
        own = thresholds.select("symbol", F.col("buy").alias("_buy"))
        out = out.join(own, "symbol", "left")
        tb = F.coalesce("_buy", F.lit(float(buy)))
    bear = F.lit(False)
    for c in (trend, risk):
        if c:
            bear = bear | F.coalesce(F.col(c) == -1, F.lit(False))
    p = F.col(prob)
    level = F.when(bear, F.greatest(tb, F.lit(BEAR_BUY))).otherwise(tb)
    out = out.withColumns({"confidence": F.abs(p - 0.5) * 2.0, "effective_buy": level})
    conf, level = F.col("confidence"), F.col("effective_buy")
    signal = F.when(conf < floor, "HOLD").when(p >= level, "BUY").when(p <= sell, "SELL").otherwise("HOLD")
    out = out.withColumn("signal", F.when(p.isNotNull(), signal))
    short = -1 if allow_short else 0
    s = F.col("signal")
    reason = (
        F.when(s == "BUY", F.format_string("P(up)=%.3f >= BUY threshold %.3f", p, level))
        .when(s == "SELL", F.format_string("P(up)=%.3f <= SELL threshold %.3f", p, F.lit(float(sell))))
        .otherwise(F.format_string("P(up)=%.3f inside HOLD band (%.3f < p < %.3f)", p, F.lit(float(sell)), level))
    )
    return out.withColumns(
        {"direction": F.when(s == "BUY", 1).when(s == "SELL", short).otherwise(0), "reason": reason}
    ).drop("_buy")


def quality_gate(decisions: DataFrame, auc: DataFrame, base_rate: DataFrame, minimum: float = MIN_AUC) -> DataFrame:
    """Without discrimination a symbol holds, at the base rate of its newest rows."""
    out = decisions.join(auc.select("symbol", F.col("auc").alias("_auc")), "symbol", "left")
    out = out.join(base_rate.select("symbol", F.col("base_rate").alias("_base")), "symbol", "left")
    weak = F.coalesce(F.col("_auc") < minimum, F.lit(False))
    base = F.coalesce("_base", F.lit(0.5))
    return out.withColumns(
        {
            "p": F.when(weak, base).otherwise(F.col("p")),
            "signal": F.when(weak, "HOLD").otherwise(F.col("signal")),
            "direction": F.when(weak, 0).otherwise(F.col("direction")),
            "confidence": F.when(weak, F.abs(base - 0.5) * 2).otherwise(F.col("confidence")),
            "gated": weak,
        }
    ).drop("_auc", "_base")


def ensemble(oof: DataFrame, keys: list[str], prob: str = "p", weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean over the models present per row, with the spread between them.

    ``oof`` is long by ``model``; weights are renormalised over present models.
    """
    weight = F.lit(1.0)
    if weights is not None:
        if min(weights.values()) <= 0:
            raise ValueError("weights must be strictly positive")
        weight = F.lit(None).cast("double")
        for name, value in weights.items():
            weight = F.when(F.col("model") == name, float(value)).otherwise(weight)
    p = F.col(prob)
    w = F.when(p.isNotNull(), weight)
    mean = F.try_divide(F.sum(w * p), F.sum(w))
    return oof.groupBy(*keys).agg(
        F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("prob"),
        F.avg(p).alias("_mean"),
        F.stddev_pop(p).alias("disagreement"),
        F.count(p).alias("n_models"),
    ).drop("_mean")


def blend(pooled: DataFrame, own: DataFrame, keys: list[str], weights=(0.3, 0.5, 0.7)) -> DataFrame:
    """Weighted blends where both models have a row; one output row per weight."""
    both = pooled.select(*keys, F.col("p").alias("_pool")).join(own.select(*keys, F.col("p").alias("_own"), "y"), keys)
    return both.withColumn("weight", F.explode(F.array(*[F.lit(float(x)) for x in weights]))).select(
        *keys,
        "weight",
        "y",
        (F.col("weight") * F.col("_pool") + (1 - F.col("weight")) * F.col("_own")).alias("p"),
    )


def uncertainty(df: DataFrame, models: list[str]) -> DataFrame:
    """Mean, population spread, margin and entropy over model columns, NULLs skipped."""
    arr = F.array_compact(F.array(*[F.col(m).cast("double") for m in models]))
    out = df.withColumn("_a", arr).withColumn("_n", F.size("_a"))
    total = F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + x)
    out = out.withColumn("probability", F.try_divide(total, F.col("_n").cast("double")))
    m = F.col("probability")
    square = F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    p = F.least(F.greatest(m, F.lit(0.0)), F.lit(1.0))
    return out.withColumns(
        {
            "disagreement": F.sqrt(F.try_divide(square, F.col("_n").cast("double"))),
            "margin": F.abs(p - 0.5),
            "entropy": metrics.binary_entropy(p),
        }
    ).drop("_a", "_n")


def _conservative_rank(n: Column, alpha: float) -> Column:
    """1-based rank of the "higher" quantile at min(1, ceil((n+1)(1-alpha))/n)."""
    q = F.least(F.lit(1.0), F.ceil((n + 1) * (1.0 - alpha)) / n)
    return F.ceil(q * (n - 1)) + 1


def class_quantiles(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y", alpha: float = 0.10) -> DataFrame:
    """Nonconformity quantile of each class per key (columns q0, q1)."""
    prob = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    scored = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(y).cast("int").alias("_y"), F.when(F.col(y) == 1, 1.0 - prob).otherwise(prob).alias("_s")
    )
    stats = ranking.order_stats(scored, [*keys, "_y"], "_s", {"q": _conservative_rank(F.col("total"), alpha)})
    return stats.groupBy(*keys).agg(
        F.max(F.when(F.col("_y") == 0, F.col("q"))).alias("q0"), F.max(F.when(F.col("_y") == 1, F.col("q"))).alias("q1")
    )


def earlier_fold_quantiles(rows: DataFrame, folds: list[int], p: str = "p", y: str = "y", alpha: float = 0.10) -> DataFrame:
    """Class quantiles for each fold from the rows of earlier folds only.

    Rows are counted per fold, class and probability first; only those counts are
    repeated for the later folds.
    """
    lists = F.array(*[F.lit(f) for f in folds])
    counted = (
        rows.where(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy("fold", F.col(y).cast("int").alias("_y"), F.col(p).alias("_p"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    s = F.when(F.col("_y") == 1, 1.0 - F.col("_p")).otherwise(F.col("_p"))
    later = counted.withColumn("_f", F.explode(F.filter(lists, lambda f: f > F.col("fold")))).select(
        F.col("_f").alias("fold"), "_y", s.alias("_s"), "cnt"
    )
    counts = later.groupBy("fold", "_y", "_s").agg(F.sum("cnt").alias("cnt"))
    ranked = ranking.ranks_of_counts(counts, ["fold", "_y"], "_s")
    r = _conservative_rank(F.col("total"), alpha)
    hit = F.max(F.when((r > F.col("below")) & (r <= F.col("below") + F.col("cnt")), F.col("_s")))
    per = ranked.groupBy("fold", "_y").agg(hit.alias("q"))
    return per.groupBy("fold").agg(
        F.max(F.when(F.col("_y") == 0, F.col("q"))).alias("q0"), F.max(F.when(F.col("_y") == 1, F.col("q"))).alias("q1")
    )


def selective(df: DataFrame, quantiles: DataFrame | None = None, key: str = "fold", prob: str = "p") -> DataFrame:
    """Every rule applied to every row: accepted or not, and the decision.

    The ten rules are a fixed array on each row, not a join. ``df`` carries margin,
    disagreement and entropy; ``quantiles`` adds the conformal sets per ``key``.
    """
    out = df
    if quantiles is not None:
        out = out.join(quantiles, key, "left")
    else:
        out = out.withColumns({"q0": F.lit(None).cast("double"), "q1": F.lit(None).cast("double")})
    p = F.least(F.greatest(F.col(prob), F.lit(0.0)), F.lit(1.0))
    in0, in1 = p <= F.col("q0"), (1.0 - p) <= F.col("q1")
    known = F.col("q0").isNotNull() & F.col("q1").isNotNull()
    single = F.coalesce(known & (in0 != in1), F.lit(False))
    side = F.when(p >= 0.5, 1).otherwise(0)
    gates = {
        "always": lambda t: F.lit(True),
        "margin": lambda t: F.col("margin") >= t,
        "disagreement": lambda t: F.col("disagreement") <= t,
        "entropy": lambda t: F.col("entropy") <= t,
        "conformal": lambda t: single,
    }
    items = []
    for name, kind, limit in RULES:
        ok = F.coalesce(gates[kind](limit), F.lit(False)) & p.isNotNull()
        choice = F.when(in1, 1).otherwise(0) if kind == "conformal" else side
        items.append(
            F.struct(
                F.lit(name).alias("policy"), ok.alias("accepted"), F.when(ok, choice).otherwise(-1).alias("decision")
            )
        )
    return out.withColumn("_r", F.explode(F.array(*items))).select("*", "_r.*").drop("_r", "q0", "q1")


def selective_metrics(rows: DataFrame, keys: list[str], prob: str = "p", y: str = "y", ret: str | None = None) -> DataFrame:
    """Coverage, risk and calibration of accepted rows per key."""
    base = rows.where(F.col(prob).isNotNull() & F.col(y).isNotNull())
    n, a = F.count(F.lit(1)), F.count_if("accepted")
    aggs = [
        n.alias("n"), a.alias("n_accepted"), (n - a).alias("n_abstained"),
        F.try_divide(a.cast("double"), n).alias("coverage"),
        (1 - F.try_divide(a.cast("double"), n)).alias("abstention_rate"),
    ]
    if ret:
        signed = F.when(F.col("accepted"), F.when(F.col(prob) >= 0.5, 1.0).otherwise(-1.0) * F.col(ret))
        aggs += [
            F.avg(signed).alias("mean_signed_return"),
            F.avg((signed > 0).cast("double")).alias("win_rate_return"),
        ]
    cover = base.groupBy(*keys).agg(*aggs)
    s = metrics.scorecard(base.where("accepted"), keys, prob, y)
    s = s.select(
        *keys, "accuracy", (1 - F.col("accuracy")).alias("selective_risk"), F.col("auc").alias("roc_auc"), "brier", "ece", "positive_rate"
    )
    return cover.join(s, keys, "left")


def conformal_band(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y", alpha: float = 0.10, minimum: int = 30) -> DataFrame:
    """Half width of the split-conformal band per key, withheld on small samples."""
    scores = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("_s", F.abs(F.col(p) - F.col(y)))
    n = F.col("total")
    k = F.greatest(F.least(F.ceil((n + 1) * (1.0 - alpha)), n), F.lit(1))
    out = ranking.order_stats(scores, keys, "_s", {"_w": k})
    width = F.when(F.col("total") >= minimum, F.col("_w"))
    return out.select(
        *keys,
        F.col("total").alias("n_calibration"),
        width.alias("half_width"),
        (width >= 0.5).alias("is_wide"),
        F.when(F.col("total") >= minimum, "ok").otherwise("insufficient_sample").alias("status"),
    )


def apply_band(df: DataFrame, band: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    out = df.join(band, keys, "left")
    q = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    h = F.col("half_width")
    return out.withColumns(
        {
            "lower": F.round(F.greatest(q - h, F.lit(0.0)), 4),
            "upper": F.round(F.least(q + h, F.lit(1.0)), 4),
        }
    )


def band_coverage(holdout: DataFrame, band: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Share of holdout labels inside their band; needs ten rows and a band."""
    out = holdout.where(F.col(p).isNotNull() & F.col(y).isNotNull()).join(band, keys)
    inside = F.avg((F.abs(F.col(p) - F.col(y)) <= F.col("half_width")).cast("double"))
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 10, F.round(inside, 4)).alias("coverage")
    )


def null_controls(rows: DataFrame, coverage: DataFrame, key: str, unit: str, prob: str = "p", y: str = "y", seed: int = 17) -> DataFrame:
    """Accept-all, accept-none and random acceptance at the candidate's own coverage.

    Random acceptance is a hash of key and ``unit`` (what identifies a row within its key)
    below the coverage share: no global shuffle, rows of equal values are drawn apart, and
    a rerun gives the same rows.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col(unit).cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    base = rows.join(coverage.select(key, F.col("coverage").alias("_c")), key)
    items = [
        F.struct(F.lit("always_accept").alias("control"), F.lit(True).alias("accepted")),
        F.struct(F.lit("always_abstain").alias("control"), F.lit(False).alias("accepted")),
        F.struct(F.lit("random_accept").alias("control"), (F.col("_u") < F.col("_c")).alias("accepted")),
    ]
    out = base.withColumn("_u", u).withColumn("_k", F.explode(F.array(*items)))
    return selective_metrics(out.select(*rows.columns, "_k.*"), [key, "control"], prob, y)


def prior_controls(train: DataFrame, test: DataFrame, key: str, y: str = "y") -> DataFrame:
    """Brier and accuracy of constant forecasts: training prior, always up, always down."""
    prior = train.groupBy(key).agg(F.avg(y).alias("_prior"))
    out = test.join(prior, key)
    items = F.array(
        F.struct(F.lit("train_prior").alias("control"), F.col("_prior").alias("p")),
        F.struct(F.lit("always_up").alias("control"), F.lit(1.0).alias("p")),
        F.struct(F.lit("always_down").alias("control"), F.lit(0.0).alias("p")),
    )
    flat = out.select(key, y, F.explode(items).alias("_k")).select(key, y, "_k.*")
    return flat.groupBy(key, "control").agg(
        F.avg(((F.col("p") >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"),
        F.avg(F.pow(F.col("p") - F.col(y), 2)).alias("brier"),
    )


GRID = [round(0.50 + 0.02 * i, 2) for i in range(12)]


def best_thresholds(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y", bear: str | None = None, minimum: int = 50) -> DataFrame:
    """Buy level with the best long accuracy among grid points with enough longs.

    Rows are folded to one count per key and grid step; longs at a level are a running
    sum from the top, so the grid is never multiplied with the rows.
    """
    prob = F.col(p)
    lifted = F.when(F.abs(prob - 0.5) * 2.0 >= FLOOR, prob)
    if bear:
        lifted = F.when(~F.coalesce(F.col(bear), F.lit(False)) | (prob >= BEAR_BUY), lifted)
    slot = F.lit(-1)
    for i, level in enumerate(GRID):
        slot = F.when(lifted >= level, i).otherwise(slot)
    counted = (
        rows.where(prob.isNotNull())
        .groupBy(*keys, slot.alias("_i"))
        .agg(F.count(F.lit(1)).alias("_n"), F.count(y).alias("_l"), F.count_if(F.col(y) >= 0.5).alias("_u"))
        .where("_i >= 0")
    )
    # One row per key and grid step: at most twelve.
    full = (
        counted.groupBy(*keys)
        .agg(F.collect_list(F.struct("_i", "_n", "_l", "_u")).alias("_c"))
        .withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))))
    )

    def total(field: str) -> Column:
        return F.aggregate(
            F.filter("_c", lambda s: s["_i"] >= F.col("_g")), F.lit(0).cast("bigint"), lambda acc, s: acc + s[field]
        )

    level = F.element_at(F.array(*[F.lit(g) for g in GRID]), F.col("_g") + 1)
    points = full.select(
        *keys, level.alias("buy"), total("_n").alias("n_long"), F.try_divide(total("_u").cast("double"), total("_l")).alias("accuracy")
    ).withColumn("accuracy", F.round("accuracy", 4))
    ok = points.where((F.col("n_long") >= minimum) & F.col("accuracy").isNotNull())
    return ok.groupBy(*keys).agg(
        F.max_by(F.struct("buy", "n_long", "accuracy"), F.struct("accuracy", "n_long", -F.col("buy"))).alias("_b")
    ).select(*keys, "_b.*")


# ---- verdict rules -------------------------------------------------------------------


def pooled_verdict(summary: DataFrame) -> DataFrame:
    """Adopt, keep or insufficient, from median_delta, wins, n_symbols, fold_robust, seed_stable."""
    d, rate = F.col("median_delta"), F.try_divide(F.col("wins").cast("double"), F.col("n_symbols"))
    verdict = (
        F.when(d.isNull() | (F.col("n_symbols") == 0), "EVIDENCE STILL INSUFFICIENT")
        .when((d > 0.02) & (rate >= 0.7) & F.col("fold_robust") & F.col("seed_stable"), "IMPLEMENT POOLED V2")
        .when((d <= 0) | (rate < 0.5), "KEEP FROZEN V1")
        .otherwise("EVIDENCE STILL INSUFFICIENT")
    )
    return summary.withColumn("verdict", verdict)


def selective_verdict(policies: DataFrame, seeds: DataFrame) -> DataFrame:
    """Research verdict per policy against always accepting.

    ``policies``: policy, coverage, accuracy, selective_risk over all rows. ``seeds``:
    the same per seed; a policy is robust if every seed covers 0.2 and is no riskier.
    """
    base = policies.where("policy = 'always_accept'").agg(
        F.max("accuracy").alias("a"), F.max("selective_risk").alias("r")
    )
    best_a, best_r = base.select("a").scalar(), base.select("r").scalar()
    robust = seeds.groupBy("policy").agg(
        F.bool_and(
            F.coalesce((F.col("coverage") >= 0.2) & (F.col("selective_risk") <= best_r), F.lit(False))
        ).alias("seed_robust")
    )
    out = policies.where("policy <> 'always_accept'").join(robust, "policy", "left")
    out = out.withColumns(
        {
            "accuracy_uplift": F.coalesce(F.col("accuracy") - best_a, F.lit(0.0)),
            "risk_reduction": F.coalesce(best_r - F.col("selective_risk"), F.lit(0.0)),
        }
    )
    good = (
        (F.coalesce("coverage", F.lit(0.0)) >= 0.30)
        & (F.col("accuracy_uplift") >= 0.02)
        & (F.col("risk_reduction") >= 0.02)
        & F.coalesce("seed_robust", F.lit(False))
    )
    return out.withColumn("verdict", F.when(good, "PROMISING_RESEARCH_ONLY").otherwise("NOT_SUPPORTED"))


def return_risk_verdict(models: DataFrame, symbols: DataFrame, folds: DataFrame, null_rmse: DataFrame, entropy: DataFrame) -> DataFrame:
    """Verdict on return models from RMSE tables; each input holds one row per unit."""
    from ..functions.tables import one_row

    row = one_row(
        models.agg(F.min("rmse").alias("best")),
        symbols.agg(F.avg((F.coalesce("rmse", F.lit(1.0)) < 0.05).cast("double")).alias("good")),
        folds.agg(F.try_divide(F.stddev_pop("rmse"), F.greatest(F.avg("rmse"), F.lit(1e-10))).alias("cv")),
        null_rmse.agg(F.max("rmse").alias("null_rmse")),
        entropy.select("interpretation"),
    )
    steady = (F.col("good") >= 0.3) & (F.col("cv") < 2.0)
    verdict = (
        F.when(F.col("best").isNull(), "REJECTED")
        .when(F.col("best") >= F.col("null_rmse") * 0.9, "REJECTED")
        .when(steady & F.col("interpretation").isin("entropy_reduces_regret", "moderate_signal"), "PROMISING")
        .when(steady, "EVIDENCE STILL INSUFFICIENT")
        .when(F.col("good") < 0.1, "REJECTED")
        .otherwise("EVIDENCE STILL INSUFFICIENT")
    )
    return row.withColumn("verdict", verdict)
