"""Helpers of the document operators: input columns, shipping of the package, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only identifier and text, so that other columns never clash; an unknown text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the identifier's text modulo a number; an unknown identifier has none and counts as -1."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % modulus, F.lit(-1))


def ship() -> None:
    """Give the workers of the active session this package, wherever the driver was started."""
    sc = SparkSession.active().sparkContext
    if getattr(sc, "_barloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="barloom-ship-"), "barloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(top, "barloom")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    sc._barloom_shipped = True


def give_back() -> None:
    """Give a worker's freed memory back to the system: Spark keeps idle workers beside those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spread(rows: int, per_task: int, least: int = 1) -> int:
    """Parts for so many rows, each part of a bounded size."""
    return max(least, -(-rows // per_task))


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is its smallest node.

    Alternating large and small stars: hubs are reduced to a minimum before the shuffle, every
    round is a written table, and rounds end when the edges no longer change.
    """
    state = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    before = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), label)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        )
        state = materialize(small.distinct(), label)
        now = state.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if before == now:
            break
        before = now
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
