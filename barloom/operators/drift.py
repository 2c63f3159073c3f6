"""Drift, freshness and operating status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import one_row

# Alarm limits.
PSI_LIMIT = 0.25
BRIER_LIMIT = 0.05
MAX_AGE_DAYS = 7
MIN_RECENT = 5


def psi(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Population stability index of every column in one job.

    Both tables are unpivoted and folded to bin counts before the shuffle; only the
    per-column range of the reference (one row per column) is joined back.
    """
    eps = 1e-6

    def long(df: DataFrame, side: int) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        return (
            wide.unpivot([], columns, "feature", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value"))
            .withColumn("side", F.lit(side))
        )

    ref, cur = long(reference, 0), long(current, 1)
    limits = ref.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("hi") - F.col("lo") < eps
    limits = limits.select(
        "feature",
        F.when(flat, F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"),
    )
    step = (F.col("hi") - F.col("lo")) / bins
    slot = F.lit(0)
    for i in range(1, bins):
        slot = slot + F.when(F.col("value") >= F.col("lo") + i * step, 1).otherwise(0)
    counted = (
        ref.unionByName(cur)
        .join(limits, "feature")
        .groupBy("feature", slot.alias("bin"))
        .agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    )
    # A bin empty on both sides contributes nothing, so absent rows are harmless.
    totals = counted.groupBy("feature").agg(F.sum("r").alias("_rt"), F.sum("c").alias("_ct"))
    rf = F.greatest(F.try_divide(F.col("r").cast("double"), F.col("_rt")), F.lit(eps))
    cf = F.greatest(F.try_divide(F.col("c").cast("double"), F.col("_ct")), F.lit(eps))
    return (
        counted.join(totals, "feature")
        .groupBy("feature")
        .agg(
            F.when((F.max("_rt") > 0) & (F.max("_ct") > 0), F.sum((cf - rf) * F.log(cf / rf))).alias("psi")
        )
        .withColumn("alarm", F.coalesce(F.col("psi") > PSI_LIMIT, F.lit(False)))
    )


def freshness(last: Column, now, max_days: int = MAX_AGE_DAYS) -> tuple[Column, Column]:
    """(age in days, fresh or stale); an unknown date is stale."""
    age = F.datediff(F.lit(now).cast("date"), last)
    return age, F.when(age <= max_days, "fresh").otherwise("stale")


def monitoring_report(
    features: DataFrame, prediction_psi: DataFrame, brier: DataFrame, last_date: DataFrame, now
) -> DataFrame:
    """One row: alarms and operating mode. Inputs are per-feature PSI, one PSI row of the
    predictions, one row ``(reference_brier, current_brier)`` and one row ``(last_date)``."""
    f = features.agg(F.max("psi").alias("max_psi"), F.bool_or("alarm").alias("feature_drift"))
    p = prediction_psi.agg(F.max("psi").alias("prediction_psi"), F.bool_or("alarm").alias("prediction_drift"))
    b = brier.withColumn("delta_brier", F.col("current_brier") - F.col("reference_brier"))
    b = b.withColumn("calibration_drift", F.col("delta_brier") > BRIER_LIMIT)
    age, status = freshness(F.col("last_date"), now)
    d = last_date.select("last_date", age.alias("age_days"), status.alias("freshness"))
    out = one_row(f, p, b, d)
    stale = F.col("freshness") != "fresh"
    alarm = F.col("feature_drift") | F.col("prediction_drift") | F.col("calibration_drift")
    alarms = F.array_compact(
        F.array(
            F.when(stale, "data_stale"),
            F.when(F.col("feature_drift"), "feature_drift"),
            F.when(F.col("prediction_drift"), "prediction_drift"),
            F.when(F.col("calibration_drift"), "calibration_drift"),
        )
    )
    return out.withColumns(
        {"mode": F.when(stale, "stale").when(alarm, "degraded").otherwise("fresh"), "alarms": alarms}
    )


def calibration_status(live: DataFrame, reference: DataFrame) -> DataFrame:
    """Status ladder of live against stored calibration, per symbol.

    ``live``: symbol, n, brier, ece of scored predictions. ``reference``: symbol,
    ref_brier, ref_ece.
    """
    out = live.join(reference.withColumn("_has", F.lit(True)), "symbol", "full")
    n = F.coalesce("n", F.lit(0))
    delta = F.col("brier") - F.col("ref_brier")
    status = (
        F.when(n == 0, "no_scored_predictions")
        .when(F.col("_has").isNull(), "no_reference")
        .when(F.col("ref_brier").isNull(), "reference_unusable")
        .when(n < MIN_RECENT, "insufficient_sample")
        .when(delta > BRIER_LIMIT, "drift_detected")
        .otherwise("ok")
    )
    compared = F.col("_has").isNotNull() & (n > 0)
    return out.select(
        "symbol",
        n.alias("n_recent"),
        F.round("brier", 4).alias("brier"),
        F.round("ece", 4).alias("ece"),
        F.when(compared, F.round(delta, 4)).alias("delta_brier"),
        F.when(compared & F.col("ref_brier").isNotNull(), F.round(F.col("ece") - F.col("ref_ece"), 4)).alias("delta_ece"),
        status.alias("status"),
        (status == "drift_detected").alias("is_alarm"),
    )


def source_status(series: DataFrame, now) -> DataFrame:
    """Rows, last day and freshness per source."""
    per = series.groupBy("series_id").agg(F.count("close").alias("rows"), F.max("date").alias("data_end"))
    age, status = freshness(F.col("data_end"), now)
    return per.withColumns({"age_days": age, "status": status})


def system_status(sources: DataFrame, last_mode: str | None, calibration_alarm: DataFrame) -> DataFrame:
    stale = sources.agg(F.bool_or(F.col("status") != "fresh").alias("market_sources_stale"))
    cal = calibration_alarm.agg(F.coalesce(F.bool_or("is_alarm"), F.lit(False)).alias("calibration_drift"))
    worse = F.lit(last_mode is not None and last_mode != "fresh")
    out = one_row(stale, cal).withColumn("forecast_degraded", worse)
    bad = F.col("market_sources_stale") | F.col("forecast_degraded") | F.col("calibration_drift")
    return out.withColumn("status", F.when(bad, "degraded").otherwise("ok"))


def forward_scorecard(scored: DataFrame, minimum: int = 5) -> DataFrame:
    """Realised quality of logged predictions, overall (NULL symbol) and per symbol."""
    p, up, r = F.col("probability"), F.col("label_up"), F.col("realised_return")
    done = F.col("scored")
    hit = ((p >= 0.5) == up).cast("double")
    rate = F.avg(F.when(done, up.cast("double")))
    acc = F.avg(F.when(done, hit))
    best = F.greatest(rate, 1 - rate)
    return scored.rollup("symbol").agg(
        F.count(F.lit(1)).alias("n_logged"),
        F.count_if(done).alias("n_scored"),
        F.count_if(~done).alias("n_waiting"),
        F.round(acc, 4).alias("accuracy"),
        F.round(F.avg(F.when(done, F.pow(p - up.cast("double"), 2))), 4).alias("brier"),
        F.round(rate, 4).alias("up_rate"),
        F.round(best, 4).alias("best_baseline_accuracy"),
        F.round(acc - best, 4).alias("edge"),
        F.round(F.avg(F.when(done, r)), 4).alias("mean_return"),
        F.round(F.avg(F.when(done & (p >= 0.5), hit)), 4).alias("hit_rate_up"),
        (F.count_if(done) >= minimum).alias("is_sufficient"),
    )
