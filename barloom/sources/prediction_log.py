"""Append-only prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "prediction_id string, symbol string, as_of string, horizon int, probability double, "
    "signal string, direction int, close double, data_fingerprint string, scored boolean"
)


def read_log(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Logged predictions; unreadable lines are skipped."""
    rows = spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("symbol") == symbol.upper()) if symbol else rows


def usable(candidates: DataFrame) -> DataFrame:
    p = F.col("probability")
    return candidates.where(F.coalesce(F.col("is_available"), F.lit(False)) & p.isNotNull() & ~F.isnan(p))


def classify_appends(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Status per candidate: skipped, duplicate or recorded.

    The first of several equal candidates (lowest ``prediction_id``) is recorded. The
    identity is ``(symbol, as_of, data_fingerprint)``.
    """
    key = ["symbol", "as_of", "data_fingerprint"]
    p = F.col("probability")
    good = F.coalesce(F.col("is_available"), F.lit(False)) & p.isNotNull() & ~F.isnan(p)
    known = log.select(*key).distinct().withColumn("_known", F.lit(True))
    rank = F.row_number().over(Window.partitionBy(*key, "_good").orderBy("prediction_id"))
    return (
        candidates.withColumn("_good", good)
        .join(known, key, "left")
        .withColumn("_rank", rank)
        .withColumn(
            "status",
            F.when(~F.col("_good"), "skipped")
            .when(F.coalesce("_known", F.lit(False)) | (F.col("_rank") > 1), "duplicate")
            .otherwise("recorded"),
        )
        .drop("_good", "_known", "_rank")
    )


def new_records(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Rows to append: usable, one per identity, absent from the log.

    Identities are reduced with ``min_by`` (combined before the shuffle) instead of a
    window, so a fingerprint repeated a billion times is one row per task.
    """
    key = ["symbol", "as_of", "data_fingerprint"]
    rest = [c for c in candidates.columns if c not in key]
    first = (
        usable(candidates)
        .groupBy(*key)
        .agg(F.min_by(F.struct(*rest), "prediction_id").alias("_r"))
        .select(*key, "_r.*")
    )
    return first.join(log.select(*key).distinct(), key, "left_anti")


def append(candidates: DataFrame, path: str) -> None:
    spark = candidates.sparkSession
    new_records(candidates, read_log(spark, path)).select(
        *[f.split()[0] for f in LOG_SCHEMA.split(", ")]
    ).write.mode("append").json(path)
