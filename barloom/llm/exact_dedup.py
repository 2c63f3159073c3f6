"""Exact deduplication by a stateful stream over content digests.

Arrivals (digest, identifier, content locator) are a log of files that a stream reads. Its state
holds one entry for each digest, without watermark or expiry, in RocksDB on the workers' disks and
in the checkpoint folder: the smallest identifier with its locator, and the number of arrivals.
Arrivals are combined before they reach the state, so a digest of a third of all rows is one row a
task. Digests that were hit more than once have their full normalised bytes grouped and compared; a
digest that stands for more than one text is then decided by the bytes instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.session import materialize, shared_folder

BLANKS = r"[\x20\x09-\x0D]+"
# Many small stores: no space is allocated ahead, and a commit writes its changes, not a whole store.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
HIT_BROADCAST = 200_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, locator, seat) of every row: the file that holds it and a number of its own."""
    return docs.select(
        digest(normalised(F.col(text_col))).alias("digest"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.input_file_name().alias("locator"),
        F.monotonically_increasing_id().alias("seat"),
    )


@contextmanager
def rocksdb(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(spark: SparkSession, log: str, schema: StructType, state: str, files_per_batch: int = 1000) -> None:
    """Bring the state folder up to date with all files of the log; a later call goes on with new files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
    # Known identifiers come before unknown ones.
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "seat", "locator")
    kept = stream.groupBy("digest").agg(F.min(key).alias("keeper"), F.count("*").alias("arrived"))
    job = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
    job.trigger(availableNow=True).start().awaitTermination()


def entries(spark: SparkSession, state: str) -> DataFrame:
    """The state: (digest, keep_id, keep_seat, locator, group_size)."""
    held = spark.read.format("statestore").load(state)
    value = held.schema["value"].dataType.fieldNames()
    keeper, arrived = F.col(f"value.`{value[0]}`"), F.col(f"value.`{value[1]}`")
    return held.select(
        "key.digest",
        keeper["doc_id"].alias("keep_id"),
        keeper["seat"].alias("keep_seat"),
        keeper["locator"].alias("locator"),
        arrived.cast("long").alias("group_size"),
    )


def _texts(docs: DataFrame, digests: DataFrame, few: bool, digest, id_col: str, text_col: str) -> DataFrame:
    """(digest, doc_id, text) of the rows whose digest is listed."""
    text = normalised(F.col(text_col))
    rows = docs.select(digest(text).alias("digest"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.join(F.broadcast(digests) if few else digests, "digest", "left_semi")


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 1000,
    broadcast_up_to: int = HIT_BROADCAST,
) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every row.

    Rows with equal normalised texts are a group and the smallest identifier stays; null texts equal
    empty ones, an unknown identifier stays only in a group without any other. Of rows that repeat an
    identifier and text one is kept. An empty table gives no rows. List of hit digests: broadcast up
    to ``broadcast_up_to`` entries, else joined by a shuffle.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    log = arrivals(docs, digest, id_col, text_col)
    log.write.parquet(f"{folder}/log")
    came = spark.read.schema(log.schema).parquet(f"{folder}/log")
    if came.isEmpty():
        return came.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    with rocksdb(spark):
        ingest(spark, f"{folder}/log", log.schema, f"{folder}/state", files_per_batch)
        state = materialize(entries(spark, f"{folder}/state"), "state")
    hits = state.where("group_size > 1").select("digest")
    few = hits.count() <= broadcast_up_to
    # Grouped by the text itself: copies are combined before the shuffle, and equal keys are compared byte by byte.
    seen = _texts(docs, hits, few, digest, id_col, text_col).groupBy("text").agg(F.first("digest").alias("digest"))
    clashing = materialize(seen.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "clashing")
    settled = came.join(state.drop("locator"), "digest").withColumn("kept", F.col("seat") == F.col("keep_seat"))
    settled = settled.select("doc_id", "digest", "keep_id", "group_size", "kept")
    if clashing.isEmpty():
        return settled
    rows = _texts(docs, clashing, False, digest, id_col, text_col)
    by_text = rows.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    turn = F.row_number().over(Window.partitionBy("text", "doc_id").orderBy("digest"))
    rows = rows.withColumn("turn", turn).join(by_text, "text")
    rows = rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1))
    return settled.join(clashing, "digest", "left_anti").unionByName(rows.select("doc_id", "digest", "keep_id", "group_size", "kept"))
