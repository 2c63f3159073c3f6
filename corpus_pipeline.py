"""A training corpus from ``documents``: language, quality, exact and near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return
the columns of ``documents``. Stages write nothing but their operators' intermediate tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import cotraining, exact_dedup, jaccard, language, packing
from barloom.llm.common import remainder
from barloom.session import materialize

# Below even odds, so that a clean document in doubt stays.
ACCEPT = 0.3
# Parts of texts a packing worker remembers; the stages before it have left their memory behind.
REMEMBERED = 200_000


def _small_batches(spark: SparkSession) -> None:
    """Whole texts pass through Python in batches and into files in row groups of a few megabytes, so that a
    writing task and its Python worker hold little at once; state stores share a bound beside idle workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("parquet.block.size", str(8 << 20))
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, without an n-gram of a known language, or far from every known language go.

    Far is a score under the language's cutoff, which all held-out labelled rows set; the profiles come from all others.
    """
    _small_batches(spark)
    unseen = remainder("doc_id", 4) == 2
    profiles = language.learn(docs.where(~unseen), per_language=None)
    least = language.cutoffs(spark, profiles, docs.where(unseen))
    cutoff = F.coalesce(F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("_judged.lang")], F.lit(0.0)) if least else F.lit(0.0)
    judged = docs.withColumn("_judged", language.identify(spark, profiles, F.col("text")))
    known = (F.col("_judged.lang") != language.UNKNOWN) & (F.col("_judged.score") > 0) & (F.col("_judged.score") >= cutoff)
    return judged.where(known).select(docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that co-trained text and metadata views together hold for bad ones go."""
    _small_batches(spark)
    model = cotraining.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = docs.withColumn("_quality", cotraining.quality(spark, model, docs))
    return judged.where(F.col("_quality.score") >= ACCEPT).select(docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the smallest doc_id stays, once."""
    _small_batches(spark)
    decided = materialize(exact_dedup.deduplicate(docs), "decisions")
    kept = decided.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    own = exact_dedup.sha256(exact_dedup.normalised(F.col("text")))
    rows = docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (own == F.col("_digest")), "left_semi")
    if decided.where("not kept and doc_id <=> keep_id").isEmpty():
        return rows
    # Whole rows are repeated: one of each stays.
    turn = F.row_number().over(Window.partitionBy("doc_id", own).orderBy("doc_id"))
    return rows.withColumn("_turn", turn).where("_turn = 1").select(docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash fingerprints or minima of 5-word shingles bring together and whose Jaccard similarity is
    at least 0.8, the smallest doc_id stays; rows of one doc_id stay together."""
    _small_batches(spark)
    groups = jaccard.near_duplicates(docs)
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their place in the training sequences."""
    _small_batches(spark)
    return packing.packed_spans(docs, remembered=REMEMBERED)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_exact),
    ("simhash_near_dedup", drop_near),
    ("best_fit_packing", pack_sequences),
]

# A fitted classifier and a tokenizer stand in the way of SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
