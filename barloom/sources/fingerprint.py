"""Content fingerprints that need no global order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_digest(columns: list[str]):
    """SHA-256 of one row; names are part of it and NULL differs from empty."""
    parts = []
    for c in sorted(columns):
        text = F.col(c).cast("string")
        parts.append(
            F.concat(F.lit(f"{c}="), F.when(text.isNull(), F.lit("\u0000")).otherwise(F.concat(F.lit("'"), text)))
        )
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def fingerprint(df: DataFrame, name: str, columns: list[str], group: str, leaf: list[str]) -> DataFrame:
    """One digest per ``group``: rows are hashed, digests sorted inside small leaves
    (for example a symbol's month), and leaf digests combined again.

    ``leaf`` must bound the rows of a leaf; the calendar does that for a panel.
    """
    leaves = (
        df.withColumn("_d", row_digest(columns))
        .groupBy(group, *leaf)
        .agg(F.array_sort(F.collect_list("_d")).alias("_d"))
        .withColumn("_d", F.sha2(F.concat_ws("", "_d"), 256))
    )
    tops = leaves.groupBy(group).agg(F.array_sort(F.collect_list("_d")).alias("_d"))
    return tops.select(
        group,
        F.sha2(
            F.concat(F.lit(f"{name}|"), F.col(group).cast("string"), F.lit("|"), F.concat_ws("", "_d")),
            256,
        ).alias("digest"),
    )


def compose(name: str, parts: DataFrame, key: str, bits: int = 8) -> DataFrame:
    """Digest over sorted ``key:digest`` pairs; an absent part differs from an empty one.

    Parts meet in leaves chosen by the leading hex digits of their digest.
    """
    pair = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("digest"))
    leaves = (
        parts.withColumn("_leaf", F.substring("digest", 1, max(1, bits // 4)))
        .groupBy("_leaf")
        .agg(F.array_sort(F.collect_list(pair)).alias("_p"), F.count(F.lit(1)).alias("n"))
        .select("_leaf", "n", F.sha2(F.concat_ws(",", "_p"), 256).alias("_d"))
    )
    return leaves.agg(
        F.sha2(
            F.concat(
                F.lit(f"{name}|"),
                F.concat_ws(
                    "", F.transform(F.array_sort(F.collect_list(F.struct("_leaf", "_d"))), lambda s: s["_d"])
                ),
            ),
            256,
        ).alias("digest"),
        F.sum("n").alias("parts"),
    )
