"""Document fingerprints: a Merkle tree over a text's paragraphs and sections.

A paragraph is a line with its end; its digest covers its bytes. A section is a run of paragraphs
and ends after a paragraph whose digest says so, so that an edit moves no later border. A section's
digest covers its paragraphs' digests, the root covers the sections'. Equal roots mean equal texts;
where roots differ, the differing sections and paragraphs locate the edit, and the paragraphs' own
spans (sentences, or stretches of at most ``SPAN`` characters) measure how much two trees share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 48
PARAGRAPH = r"(?<=\n)"
# A span ends after a stop, at a line's end, or at its greatest length.
SPANS = rf"(?s)[^.!?,;|\n]{{0,{SPAN - 1}}}+(?:.|\z)"
# A digest that starts with 0 or 1 ends its section.
SECTION = r"(?<=\b[01][0-9a-f]{63}) "
MOST_BUCKETS = 1 << 15


def _span_list(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(SPANS), F.lit(0))
    full = F.filter(found, lambda s: s != "")
    high = F.lit(-64).cast("long")
    return F.transform(full, lambda s: F.xxhash64(s).bitwiseAND(high).bitwiseOR(F.char_length(s).cast("long")))


def tree(text: Column) -> Column:
    """Struct (root, sections, paragraphs) of hexadecimal digests; null counts as empty."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: p != "")
    paragraphs = F.transform(lines, lambda p: F.sha2(p, 256))
    sections = F.transform(F.split(F.array_join(paragraphs, " "), SECTION), lambda s: F.sha2(s, 256))
    return F.struct(
        F.sha2(F.array_join(sections, " "), 256).alias("root"), sections.alias("sections"), paragraphs.alias("paragraphs")
    )


def spans(text: Column) -> Column:
    """Distinct spans of a text as numbers, a hash above six bits of length; null counts as empty."""
    return F.array_distinct(_span_list(F.coalesce(text, F.lit(""))))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of the two trees' characters under equal spans, 0 to 1; equal roots give 1."""

    def weight(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda acc, s: acc + s.bitwiseAND(F.lit(63).cast("long")))

    both, total = weight(F.array_intersect(a, b)), weight(a) + weight(b)
    return F.when(same, 1.0).otherwise(F.coalesce(F.try_divide(both * 2.0, total), F.lit(0.0)))


def differing(a: Column, b: Column) -> Column:
    """Digests of the branches of tree ``a`` that tree ``b`` lacks: (sections, paragraphs)."""
    return F.struct(
        F.array_except(a["sections"], b["sections"]).alias("sections"),
        F.array_except(a["paragraphs"], b["paragraphs"]).alias("paragraphs"),
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 1000) -> DataFrame:
    """(doc_id, text, next_text) by ascending identifier; the last row is followed by the first.

    Rows are dealt into ranges of identifiers whose borders are identifiers that occur. A border's
    rows also close the range before, so each range finds all its successors by itself, with one
    shuffle of the texts. Unknown identifiers come first, ties follow the text. Null texts are empty.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("_key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.min("_key").alias("low")).first()
    buckets = min(MOST_BUCKETS, max(1, size["n"] // per_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx("_key", shares, 10 * buckets).alias("c")).first()["c"] if shares and size["n"] else []
    cuts = sorted(set(cuts or []) - {size["low"]})
    bounds = F.lit([size["low"] if size["low"] is not None else 0, *cuts])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    bucket = F.lit(0)
    if steps:
        bucket = F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step) <= F.col("_key")), at + step).otherwise(at),
        )
    rows = rows.withColumn("_b", bucket)
    border = F.get(bounds, F.col("_b")) == F.col("_key")
    before = F.when(F.col("_b") > 0, F.col("_b") - 1).otherwise(len(cuts))
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("after"))
    copy = F.struct(before.alias("b"), F.lit(1).alias("after"))
    rows = rows.withColumn("_to", F.explode(F.when(border, F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("_to.b").orderBy("_to.after", "_key", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).where("_to.after = 0")
    return rows.select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """A text whose last quarter of code points gives way to as many first ones of the following text."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and likeness to that and to the next text.

    A text's only row is its own successor. An empty text has the fingerprint of no sections and
    likeness 1 to an empty text, 0 to any other. An empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("own"),
        tree(F.col("edited")).alias("other"),
        (F.col("text") == F.col("next_text")).alias("repeats"),
        spans(F.col("text")).alias("own_spans"),
        spans(F.col("edited")).alias("other_spans"),
        spans(F.col("next_text")).alias("next_spans"),
    )
    own, other = F.col("own"), F.col("other")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        own["root"].alias("fingerprint"),
        other["root"].alias("edited_fingerprint"),
        likeness(F.col("own_spans"), F.col("other_spans"), own["root"] == other["root"]).alias("near_edited"),
        likeness(F.col("own_spans"), F.col("next_spans"), F.col("repeats")).alias("near_next"),
        F.size(own["sections"]).alias("n_sections"),
        F.size(own["paragraphs"]).alias("n_paragraphs"),
        F.size(differing(own, other)["sections"]).alias("differing_sections"),
        F.size(differing(own, other)["paragraphs"]).alias("differing_paragraphs"),
    )
