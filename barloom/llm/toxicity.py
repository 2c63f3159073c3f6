"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, holding the words that cost most bytes
there, and one on toxic text, holding beside them what toxic text has more often: words and beginnings
of words. A text is cut into windows; the bytes a window takes with the ordinary dictionary less those
with the toxic one are its distance. The threshold of a window's distance that tells the classes apart
best, and a logistic curve over a text's distances, are calibrated on labelled rows that no dictionary
has seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ship
from barloom.llm.cotraining import fit_logistic
from barloom.session import materialize

LABELLED = 4_000
WINDOW = 96
ORDINARY_BYTES = 1 << 14
TOXIC_BYTES = 1 << 12
LEAST = 4
BEGINNINGS = (5, 6, 7, 8, 9, 10, 12)
EVIDENCE = 30.0
TIMES = 4
MOST_CUT = 8
SPACE = rb"[\x20\x09-\x0D]+"
_SPACE = re.compile(SPACE)


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole lower-cased text in parts of at least ``size`` bytes that end at a blank, or at twice the size without one."""
    data = _SPACE.sub(b" ", (text or "").lower().encode()).strip(b" ")
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + size, at + 2 * size)
        end = end + 1 if end >= 0 else min(len(data), at + 2 * size)
        out.append(b" " + data[at:end])
        at = end
    return out


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Compressor of small windows whose frames hold nothing but the data."""
    own = zstandard.ZstdCompressionDict(dictionary or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=15, chain_log=15, search_log=4, min_match=6, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=own)


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    return compressor(ordinary).compress, compressor(toxic).compress


class Classifier:
    """Dictionaries, the threshold of a window's distance, and the weights of a text's features."""

    def __init__(self, ordinary: bytes, toxic: bytes, cut: int, line: np.ndarray, size: int = WINDOW):
        self.ordinary, self.toxic, self.cut, self.line, self.size = ordinary, toxic, cut, line, size

    def distances(self, text: str | None) -> list[int]:
        ordinary, toxic = _compressors(self.ordinary, self.toxic)
        return [len(ordinary(w)) - len(toxic(w)) for w in windows(text, self.size)]

    def score(self, text: str | None) -> float:
        """Probability of a toxic text."""
        z = float(np.dot(self.line, (*features(self.distances(text), self.cut), 1.0)))
        return 1 / (1 + np.exp(-min(max(z, -35.0), 35.0)))


def features(distances: list[int], cut: int) -> tuple[float, float, float]:
    """Mean of the three largest distances, share of windows at the threshold, and such windows up to three."""
    if not distances:
        return 0.0, 0.0, 0.0
    hits = sum(d >= cut for d in distances)
    return sum(sorted(distances)[-3:]) / 3, hits / len(distances), min(hits, 3) / 3


def segments(text: str) -> set[str]:
    """A text's different lower-cased words and their beginnings."""
    words = set(text.lower().split())
    return words.union(*({w[:n] for w in words if len(w) > n} for n in BEGINNINGS))


def _counted(sample: DataFrame) -> DataFrame:
    """(word, whole, a, b): toxic and ordinary documents of the sample with each segment, and whether it is a word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, part in batch.groupby("y"):
                n = Counter(s for t in part["text"] for s in segments(t))
                yield pd.DataFrame({"y": int(y), "word": list(n.keys()), "n": list(n.values())})

    side = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).cast("double")
    found = sample.select("y", "text").mapInPandas(count, "y int, word string, n long").groupBy("word").agg(side(1).alias("a"), side(0).alias("b"))
    return found.where(F.octet_length("word").between(LEAST, WINDOW))


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """Of rows of a class that share their least three-word shingle, as near copies mostly do, one row."""
    w = F.filter(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    cut = sample.select("y", "doc_id", "text", w.alias("w"))
    shingles = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"), F.slice("w", 3, F.size("w")).alias("c"))
    least = cut.select("y", "doc_id", "text", F.array_min(F.transform(shingles, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))).alias("least"))
    return least.groupBy("y", "least").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("y", "r.*")


def _packed(words: list[str], most: int) -> bytes:
    """The first words that fit ``most`` bytes, the very first last, where a match is cheapest."""
    kept: list[bytes] = []
    size = 1
    for w in words:
        size += len(w.encode()) + 1
        if size > most:
            break
        kept.append(w.encode())
    return b" " + b" ".join(reversed(kept)) + b" " if kept else b""


def _evidence(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Log likelihood ratio of ``a`` of ``n`` against ``b`` of ``m`` having one common rate."""

    def part(k: Column, all_: Column, rate: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (all_ * rate))).otherwise(0.0)

    rate = (a + b) / (n + m)
    return 2 * (part(a, n, rate) + part(n - a, n, 1 - rate) + part(b, m, rate) + part(m - b, m, 1 - rate))


def dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """Ordinary and toxic dictionary of a bounded sample (doc_id, text, y).

    Ordinary: the words of ordinary text by the bytes they cost. Toxic: the segments that at least
    ``TIMES`` as large a share of toxic documents holds, by the evidence for it, none of them a
    beginning of another; they stand before the ordinary dictionary, so that common words cost alike.
    """
    rows = materialize(_one_of_copies(sample), "toxicity-sample")
    sizes = {r["y"]: float(r["n"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    m, n = sizes.get(0, 0.0), sizes.get(1, 0.0)
    counts = materialize(_counted(rows), "toxicity-segments")
    cost = F.col("b") * (F.octet_length("word") - 2)
    # As many as fit the dictionaries at most come to the driver.
    common = counts.where("b > 1").orderBy(cost.desc(), "word").select("word").limit(ORDINARY_BYTES // LEAST)
    ordinary = _packed([r["word"] for r in common.collect()], ORDINARY_BYTES)
    if not n or not m:
        return ordinary, ordinary
    more = counts.where((F.col("a") > 3) & (F.col("a") * m > TIMES * F.col("b") * n))
    more = more.withColumn("e", F.round(_evidence(F.col("a"), F.lit(n), F.col("b"), F.lit(m)), 6)).where(F.col("e") > EVIDENCE)
    chosen: list[str] = []
    for r in more.orderBy(F.desc("e"), F.desc(F.length("word")), "word").limit(TOXIC_BYTES).collect():
        if not any(r["word"].startswith(c) or c.startswith(r["word"]) for c in chosen):
            chosen.append(r["word"])
    return ordinary, _packed(chosen, TOXIC_BYTES) + ordinary


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text",
) -> Classifier:
    """Fit on about ``labelled`` labelled rows of each class, chosen by a hash of the identifier.

    Repeated labels of a row count as their smallest; labels that are null or not 0 or 1 and rows
    without text teach nothing. A fifth of the rows only calibrates. Without rows of both classes
    every text scores the share of toxic rows, 0 without any. Other columns are not read.
    """
    ship()
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # Only labels of rows that can be learned from count.
    own = materialize(known.join(rows.select("doc_id").distinct(), "doc_id"), "toxicity-labels")
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(sizes.values()), sizes.get(1, 0)
    if not 0 < k < n:
        rate = k / n if n else 0.0
        return Classifier(b"", b"", 1, np.array([0.0, 0.0, 0.0, np.log(max(rate, 1e-15) / max(1 - rate, 1e-15))]))
    kept = {c: min(1.0, labelled / sizes[c]) for c in (0, 1)}
    share = F.when(F.col("y") == 1, F.lit(kept[1])).otherwise(kept[0])
    chosen = own.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < share * (1 << 30))
    # About twice ``labelled`` pairs of numbers.
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 0
    sample = materialize(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", aside.alias("aside")), "toxicity-rows")
    model = Classifier(*dictionaries(sample.where("not aside")), 1, np.zeros(4))
    held = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"far": [held.value.distances(t) for t in b["text"]], "y": b["y"].to_numpy()})

    far = sample.where("aside").select("text", "y").mapInPandas(measure, "far array<int>, y int").collect()
    y = np.array([r["y"] for r in far], float)
    best = -np.inf
    for cut in range(1, MOST_CUT + 1) if len(y) else ():
        x = np.array([features(r["far"], cut) for r in far])
        line = fit_logistic(x, y)
        z = x @ line[:-1] + line[-1]
        fits = float((y * z - np.logaddexp(0, z)).sum())
        if fits > best:
            best, model.cut, model.line = fits, cut, line
    if not len(y):
        model.line = np.array([0.0, 0.0, 0.0, np.log(k / (n - k))])
    # The classes' shares in the sample give way to those of all labelled rows.
    model.line[-1] += np.log(kept[0] / kept[1]) if len(y) else 0.0
    return model


def toxicity(spark, model: Classifier, text: Column) -> Column:
    """Probability (0 to 1) that a whole text is toxic; null, empty and blank texts have no window and score as distance zero."""
    ship()
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([held.value.score(t) for t in b], dtype="float64")

    return run(text.cast("string"))
