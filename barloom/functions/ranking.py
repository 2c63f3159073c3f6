"""Exact order statistics for groups of any size.

One group may hold a third of the table, so nothing here sorts a whole group in one
task. Rows are first counted per distinct value, the values are cut into buckets, each
bucket is scanned on its own, and only the bucket totals meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 256
STRIDE = 16


def bucketed(counted: DataFrame, keys: list[str], value: str, splits: int = SPLITS) -> DataFrame:
    """Add ``_b``, the bucket of each value, from splitters that the values of all keys give; rows of unknown keys go.

    Splitters are quantiles of the values from a bounded, mergeable sketch, one short array for the whole
    table, so that no row moves to its key: a few keys that hold most rows spread over all tasks, and no
    bucket of a key has more than about one part in ``splits`` of all rows. Buckets follow the values'
    order; what is computed from them is exact whatever the splitters are. A value is looked up among
    every sixteenth splitter first.
    """
    for k in keys:
        counted = counted.where(F.col(k).isNotNull())
    points = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    cuts = counted.agg(F.percentile_approx(value, points, 2000).alias("_cuts"))
    joined = counted.withColumn("_cuts", cuts.scalar())
    coarse = F.filter("_cuts", lambda c, i: i % STRIDE == STRIDE - 1)
    held = joined.withColumn("_c", F.size(F.filter(coarse, lambda c: c < F.col(value))))
    rest = F.slice("_cuts", F.col("_c") * STRIDE + 1, F.lit(STRIDE))
    return held.withColumn("_b", F.col("_c") * STRIDE + F.size(F.filter(rest, lambda c: c < F.col(value)))).drop("_cuts", "_c")


def auc_of_counts(counted: DataFrame, keys: list[str], value: str, up: str, down: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc) from numbers of both classes at each distinct value; NULL when one class is missing."""
    cut = bucketed(counted, keys, value)
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(down).over(inside), F.lit(0))
    per_bucket = (
        cut.withColumn("_u", F.col(up) * (below + 0.5 * F.col(down)))
        .groupBy(*keys, "_b")
        .agg(F.sum("_u").alias("_u"), F.sum(up).alias("_up"), F.sum(down).alias("_down"))
    )
    # At most SPLITS rows per key remain here.
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_down").over(across), F.lit(0))
    return (
        per_bucket.withColumn("_u", F.col("_u") + F.col("_up") * earlier)
        .groupBy(*keys)
        .agg(
            F.sum("_up").alias("n_pos"),
            F.sum("_down").alias("n_neg"),
            F.try_divide(F.sum("_u"), (F.sum("_up") * F.sum("_down")).cast("double")).alias("auc"),
        )
    )


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """ROC-AUC per key with average-rank ties, NULL when one class is missing."""
    counted = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, score)
        .agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    )
    return auc_of_counts(counted, keys, score, "_p", "_n")


def with_ranks(df: DataFrame, keys: list[str], value: str, bucket: Column | None = None, splits: int = SPLITS) -> DataFrame:
    """Distinct values per key with ``cnt``, ``below`` (rows strictly below) and ``total``.

    Buckets default to approximate quantile cuts (a bounded, mergeable sketch); the
    counts stay exact whatever the cuts are.
    """
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    )
    return ranks_of_counts(counted, keys, value, bucket, splits)


def ranks_of_counts(counted: DataFrame, keys: list[str], value: str, bucket: Column | None = None, splits: int = SPLITS) -> DataFrame:
    """As ``with_ranks`` for values already counted in ``cnt``."""
    tagged = bucketed(counted, keys, value, splits) if bucket is None else counted.withColumn("_b", bucket)
    totals = tagged.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_in"))
    across = Window.partitionBy(*keys).orderBy("_b")
    totals = totals.select(
        *keys,
        "_b",
        F.coalesce(
            F.sum("_in").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_in").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(totals, [*keys, "_b"])
        .withColumn(
            "below", F.col("_before") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))
        )
        .drop("_b", "_before")
    )


def order_stats(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], bucket: Column | None = None
) -> DataFrame:
    """Exact k-th smallest values per key; ``ranks`` maps names to 1-based rank columns
    that may use ``total``. A rank outside ``1..total`` yields NULL."""
    ranked = with_ranks(df, keys, value, bucket)
    picks = [
        F.max(
            F.when((r > F.col("below")) & (r <= F.col("below") + F.col("cnt")), F.col(value))
        ).alias(name)
        for name, r in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("total").alias("total"), *picks)


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bucket: Column | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key."""
    ranks = {}
    for name, q in probs.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        ranks[f"_lo_{name}"] = F.floor(at) + 1
        ranks[f"_hi_{name}"] = F.ceil(at) + 1
    out = order_stats(df, keys, value, ranks, bucket)
    final = [
        (
            F.col(f"_lo_{n}")
            + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
            * (
                (F.col("total") - 1) * F.lit(float(q))
                - F.floor((F.col("total") - 1) * F.lit(float(q)))
            )
        ).alias(n)
        for n, q in probs.items()
    ]
    return out.select(*keys, "total", *final)


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}).drop("total")
