"""Queries of the document operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.llm import byte_bpe, language, queries_codes, queries_more, sharding, token_counts  # noqa: F401
from barloom.llm.common import pair, remainder, table
from barloom.llm.registry import query


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    profiles = language.learn(docs.where(~held_out))
    judged = docs.select("doc_id", held_out.alias("held_out"), language.identify(spark, profiles, F.col("text")).alias("j"))
    return judged.select("doc_id", "held_out", F.col("j.lang").alias("lang_pred"), F.col("j.score").alias("score"))


SHARDS = 40
SHARD_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), c AS (
  SELECT doc_id, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST(('0x' || p) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc_table
), s AS (
  SELECT doc_id, i, (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
    / 4503599627370496.0 AS u
  FROM d, range(41) r(i)
), a AS (
  SELECT doc_id, CAST(first(i ORDER BY u DESC, i) FILTER (i < 40) AS INTEGER) AS shard, CAST(first(i ORDER BY u DESC, i) AS INTEGER) AS grown_shard
  FROM s GROUP BY doc_id
), r AS (
  SELECT c.*, a.shard, a.grown_shard FROM c JOIN a USING (doc_id)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':slot'), 1, 8), doc_id) - 1 AS BIGINT) AS slot
FROM r
"""


@query("op3_sharding", SHARD_SQL)
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sharding.assign(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    docs = pair(table(spark, sf_dir, "documents"))
    ids = docs.select("doc_id", byte_bpe.encoded(F.col("text")).alias("ids"))
    done = ids.select("doc_id", "ids", byte_bpe.decoded(F.col("ids")).alias("bytes"))
    return done.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op8_token_counts")
def op8(spark, sf_dir):
    docs = pair(table(spark, sf_dir, "documents"))
    done = docs.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_counts.token_count(F.col("text")).alias("n_tokens")
    )
    return done.withColumn("over_limit", F.col("n_tokens") > 2048)
