"""Further document queries: fingerprints, deduplication, language model, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.llm import cotraining, exact_dedup, merkle, packing, pitman_yor, simhash
from barloom.llm.common import remainder, table
from barloom.llm.registry import query


@query("op2_merkle_fingerprint")
def op2(spark, sf_dir):
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept
FROM d WINDOW w AS (PARTITION BY t)
"""


@query("op5_exact_dedup", EXACT_SQL)
def op5(spark, sf_dir):
    done = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op6_simhash")
def op6(spark, sf_dir):
    done = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_pitman_yor")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score(docs, remainder("doc_id", 7) == 2)


@query("op10_packing")
def op10(spark, sf_dir):
    return packing.packed_spans(table(spark, sf_dir, "documents"))


@query("op7_cotraining_quality")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = cotraining.train(docs, table(spark, sf_dir, "labels"))
    done = docs.select("doc_id", cotraining.quality(spark, model, docs).alias("q"))
    return done.select("doc_id", "q.score", "q.text_score", "q.page_score", (F.col("q.score") >= 0.5).alias("accepted"))
