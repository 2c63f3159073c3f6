"""Document queries: tokenizer alignment, vector codes, toxicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.llm import alignment, toxicity, vector_codes
from barloom.llm.common import remainder, table
from barloom.llm.registry import query


@query("op11_token_alignment")
def op11(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    """The same rounds as common table expressions; numbers are doubles that hold the integers exactly."""
    out = ["""k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS q FROM k, range(4) t(part)
), c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q AS c FROM p QUALIFY entry < 256
)"""]
    for i in range(5):
        out.append(f"""a{i} AS (
  SELECT vec_id, part, any_value(label) AS label, any_value(q) AS q, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT p.*, entry, list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) AS d FROM p JOIN c{i} USING (part)
  ) GROUP BY vec_id, part
)""")
        if i < 4:
            out.append(f"""c{i + 1} AS (
  SELECT part, entry, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY pos) AS m FROM (
      SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM (
        SELECT part, entry, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{i}
      ) GROUP BY part, entry, pos
    ) GROUP BY part, entry
  ) USING (part, entry)
)""")
    return "WITH " + ",\n".join(out) + """,
e AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a4 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256
FROM e"""


@query("op12_vector_codes", _codes_sql())
def op12(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_toxicity")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    model = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
