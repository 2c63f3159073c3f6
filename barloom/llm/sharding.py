"""Sharding by weighted rendezvous hashing of stable keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import spread
from barloom.session import materialize


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard with the highest score -weight / ln(u), u drawn from the md5 of key and shard.

    A record's scores depend on nothing but its key, so a further shard takes records only into
    itself and a shard's share follows its weight. Ties go to the lower shard. A null key counts as
    the empty string. Weights have to be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(i: int, w: float) -> Column:
        digits = F.substring(F.md5(F.concat(text, F.lit(f":{i}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(w)) / F.log(u)).alias("s"), F.lit(-i).alias("i"))

    best = F.array_max(F.array(*[score(i, w) for i, w in enumerate(weights)]))
    return (-best["i"]).cast("int")


def assign(
    docs: DataFrame,
    weights: Sequence[float],
    grown: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    per_task: int = 200_000,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot) of every row.

    ``grown`` gives the weights after the change of shards. Slots are gapless within a shard and
    follow a hash of the key: rows are numbered in parts of that order and the parts' counts give
    each part's first slot, so no task holds a shard. Null text: size ``overhead``, checksum 0. Repeated identifiers share a shard
    and get slots of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col)
    slim = docs.select(
        key.cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":slot"))), 1, 8).alias("place"),
    )
    slim = materialize(slim, "shards")
    parts = spread(slim.count(), per_task * len(weights), 8)
    slim = slim.withColumn("part", F.shiftright(F.conv("place", 16, 10).cast("long") * parts, 32))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = slim.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", first.alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place", "doc_id", "text_crc32", "size"))
    return slim.withColumn("slot", within).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("first") + F.col("slot") - 1).alias("slot")
    )
