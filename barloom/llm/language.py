"""Language identification by rank-order profiles of n-grams.

A language's profile holds its most frequent n-grams in order of frequency. A document's own most
frequent n-grams are compared with every profile: each n-gram costs the difference of its two ranks
("out of place"), an n-gram missing from the profile costs the profile's size, and the language
with the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.ranking import order_stats
from barloom.llm.common import give_back, ship
from barloom.session import materialize

SIZES = (1, 2, 3)
TOP = 300
UNKNOWN = "und"
# Characters whose n-grams are counted at once.
STEP = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Keys of the n-grams of the lower-cased words; runs of other characters are one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    s = np.where(letter, points, 32).astype(np.uint64)
    s = np.concatenate(([np.uint64(32)], s, [np.uint64(32)]))
    blank = s == 32
    keep = np.ones(len(s), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    s, blank = s[keep], blank[keep]
    out = []
    for n in sizes:
        if len(s) < n:
            continue
        key = np.full(len(s) - n + 1, n, np.uint64)
        inside = np.ones(len(key), bool)
        for i in range(n):
            key = key * _STEP + s[i : len(s) - n + 1 + i]
            if n == 1 or 0 < i < n - 1:
                inside &= ~blank[i : len(s) - n + 1 + i]
        out.append(key[inside])
    return np.concatenate(out)


def ranked(text: str, sizes: tuple[int, ...] = SIZES, top: int = TOP) -> np.ndarray:
    """Signed keys of the most frequent n-grams, most frequent first; ties by key."""
    keys, counts = np.unique(grams(text, sizes).view(np.int64), return_counts=True)
    if len(keys) > top:
        cut = np.partition(counts, len(counts) - top)[len(counts) - top]
        held = counts >= cut
        keys, counts = keys[held], counts[held]
    return keys[np.lexsort((keys, -counts))][:top]


class Profiles:
    """Profiles of all languages as one table of ranks."""

    def __init__(self, by_language: dict[str, list[int]], sizes: tuple[int, ...] = SIZES, top: int = TOP):
        self.sizes, self.top = sizes, top
        self.languages = sorted(by_language)
        self.keys = np.unique(np.array([k for v in by_language.values() for k in v], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), top, np.int64)
        for j, name in enumerate(self.languages):
            own = np.array(by_language[name], np.int64)
            self.ranks[np.searchsorted(self.keys, own), j] = np.arange(len(own))

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 for equal profiles, 0 where no n-gram is shared; ties go to the first name."""
        own = ranked(text, self.sizes, self.top) if text else np.empty(0, np.int64)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = np.where(self.keys[at] == own, at, len(self.keys))
        ranks = self.ranks[at]
        off = np.where(ranks == self.top, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.languages[best], float(1 - off[best] / (len(own) * self.top))


def learn(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    key_col: str = "doc_id",
    sizes: tuple[int, ...] = SIZES,
    top: int = TOP,
    per_language: int | None = 4000,
) -> Profiles:
    """Profiles of the labelled rows.

    Of each language about ``per_language`` rows (the fit's documented bound) are read, chosen by a
    hash of the identifier, or all without such a number; n-grams are counted on the workers and only ``top`` keys per language
    come back. Rows without text or language teach nothing; an empty table gives no profiles.
    """
    ship()
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key")
    ).where("lang is not null and text is not null")
    sizes_of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(sizes_of) > 1000:
        raise ValueError(f"{len(sizes_of)} languages; at most 1000 profiles are kept")
    if not sizes_of:
        return Profiles({}, sizes, top)
    chosen = rows
    if per_language is not None:
        share = F.create_map(*[F.lit(x) for k, n in sizes_of.items() for x in (k, min(1.0, per_language / n))])
        chosen = rows.where(F.pmod(F.xxhash64("key", F.lit("profile")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                cut = np.cumsum(part["text"].str.len().to_numpy(np.int64)) // STEP
                found = [held.pop(lang)] if lang in held else []
                for _, texts in part["text"].groupby(cut, sort=False):
                    found.append(np.unique(np.concatenate([grams(t, sizes) for t in texts]).view(np.int64), return_counts=True))
                keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
                held[lang] = keys[starts], np.add.reduceat(n, starts) if len(starts) else n
            if sum(len(k) for k, _ in held.values()) > 1_000_000:
                yield from (pd.DataFrame({"lang": k, "gram": g, "n": n}) for k, (g, n) in held.items())
                held = {}
        yield from (pd.DataFrame({"lang": k, "gram": g, "n": n}) for k, (g, n) in held.items())
        give_back()

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("part", F.pmod("gram", F.lit(64)))
    order = [F.desc("n"), F.asc("gram")]
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = counted.withColumn("r", first).where(F.col("r") <= top).withColumn("r", last).where(F.col("r") <= top)
    found: dict[str, list[int]] = {k: [] for k in sizes_of}
    for r in sorted(best.select("lang", "gram", "r").collect(), key=lambda r: r["r"]):
        found[r["lang"]].append(r["gram"])
    return Profiles({k: v for k, v in found.items() if v}, sizes, top)


def identify(spark: SparkSession, profiles: Profiles, text: Column) -> Column:
    """Struct (lang, score) of a whole text; null and texts without a letter are ``und`` with score 0."""
    ship()
    held = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([held.value.judge(t) for t in b], columns=["lang", "score"])
        give_back()

    return judge(text)


def cutoffs(
    spark: SparkSession,
    profiles: Profiles,
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    key_col: str = "doc_id",
    per_language: int | None = None,
) -> dict[str, float]:
    """By language, half the score that 95 % of labelled rows found to be in it reach.

    ``docs`` are rows the profiles have not seen; all labelled ones are judged, or about ``per_language``
    of each label, chosen by a hash of the identifier. Half of it leaves room for clean texts shorter or
    odder than these. A language without such rows has no cutoff.
    """
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key")
    ).where("lang is not null and text is not null")
    if per_language is not None:
        sizes_of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if not sizes_of:
            return {}
        share = F.create_map(*[F.lit(x) for k, n in sizes_of.items() for x in (k, min(1.0, per_language / n))])
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit("cutoff")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    judged = rows.select("lang", identify(spark, profiles, F.col("text")).alias("j")).where("lang = j.lang")
    scores = materialize(judged.select("lang", F.col("j.score").alias("score")), "scores")
    return {r["lang"]: r["q"] / 2 for r in order_stats(scores, ["lang"], "score", {"q": F.ceil(F.col("total") * 0.05)}).collect()}
