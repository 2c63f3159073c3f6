"""Quality classifier by co-training of a text view and a page-metadata view.

Both views are count models over hashed features: trigrams of the text's bytes and of their kinds, and
the page's source, language and length. They are fitted on a bounded sample of labelled rows. In each round either view
labels all other documents where its calibrated probability is confident, and those pseudo-labels
join the other view's counts. At last both views are calibrated on sample rows that no fit has seen
and a logistic combination of the two scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import give_back, ship
from barloom.session import materialize

SIZE = 1 << 16
HALF = SIZE >> 1
LABELLED = 20_000
FEW = 50
DRAWN = 4.0
REPEATS = 32
META = ("source", "lang", "n_chars")


def _shapes() -> np.ndarray:
    """Bytes by kind: letters small and large, digits and blanks are one each, other signs stay."""
    out = np.arange(256, dtype=np.uint32)
    out[128:] = out[97:123] = 97
    out[65:91] = 65
    out[48:58] = 48
    out[[9, 11, 12, 13]] = 32
    return out


SHAPES = _shapes()


class Trigrams:
    """Distinct hashed byte trigrams of texts, below ``HALF``; above it, trigrams of the bytes' kinds, and
    some features for how often trigrams repeat at the text's length."""

    def __init__(self):
        self.seen = np.zeros(SIZE, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        b = np.frombuffer((text or "").encode(), np.uint8)
        if len(b) < 3:
            return np.empty(0, np.int64)
        keys = []
        for x in (b.astype(np.uint32), SHAPES[b]):
            keys.append(((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(17))
        self.seen[keys[0]] = True
        self.seen[keys[1] + HALF] = True
        out = np.flatnonzero(self.seen)
        self.seen[keys[0]] = False
        self.seen[keys[1] + HALF] = False
        repeats = int(2 * np.log2(len(b) / len(out)))
        first = zlib.crc32(f"{len(b).bit_length()}:{repeats}".encode())
        return np.concatenate((out, HALF + (first + np.arange(REPEATS) * 2654435761) % HALF))


def meta_features(source, lang, n_chars) -> list[int]:
    """Hashed page features; the length counts by powers of two, and unknown is a value of its own."""
    length = "?" if n_chars is None or n_chars != n_chars else int(n_chars).bit_length()
    return [zlib.crc32(f"{k}={v}".encode()) % HALF for k, v in (("source", source), ("lang", lang), ("length", length))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, toward: float = 0.0) -> np.ndarray:
    """Weights of the columns of ``x``, drawn ``toward`` a value, and a constant, by Newton's method until they stand still."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    middle = np.full(len(w), toward)
    middle[-1] = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty * (w - middle))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class View:
    """Log count ratios of hashed features, and the calibration of their mean."""

    def __init__(self, counts: np.ndarray):
        bad, good, n_bad, n_good = counts[:SIZE], counts[SIZE : 2 * SIZE], counts[-2], counts[-1]
        # Drawn to the classes' shares, so that a feature without evidence says nothing.
        share = (np.array([n_bad, n_good]) + 1) / (n_bad + n_good + 2)
        self.weights = np.log((good + DRAWN * share[1]) / (bad + DRAWN * share[0]) * share[0] / share[1])
        seen = good + bad
        self.center = [float((seen[k] * self.weights[k]).sum() / max(seen[k].sum(), 1.0)) for k in (slice(HALF), slice(HALF, None))]
        self.line = np.array([1.0, 0.0])

    def raw(self, features) -> float:
        """Mean ratio of the lower and of the upper features; the fewer, the nearer to that of all rows."""
        at = np.asarray(features, np.int64)
        low = at[at < HALF]
        high = at[at >= HALF]
        pairs = zip((low, high), self.center, strict=True)
        return float(sum((self.weights[x].sum() + FEW * c) / (len(x) + FEW) for x, c in pairs))

    def calibrate(self, scores: np.ndarray, y: np.ndarray) -> None:
        self.line = fit_logistic(scores[:, None], y)

    def logit(self, score):
        return np.clip(self.line[0] * score + self.line[1], -35, 35)


class Classifier:
    def __init__(self, text: View, meta: View, weights: np.ndarray):
        self.text, self.meta, self.weights = text, meta, weights

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata probabilities of raw scores."""
        a, b = self.text.logit(text), self.meta.logit(meta)
        both = np.clip(np.column_stack((a, b, np.ones(len(a)))) @ self.weights, -35, 35)
        return tuple(1 / (1 + np.exp(-z)) for z in (both, a, b))


def _raw(batch: pd.DataFrame, text: View, meta: View, trigrams: Trigrams):
    """Features and raw scores of both views for each row."""
    t = [trigrams(x) for x in batch["text"]]
    m = [meta_features(*r) for r in batch[["source", "lang", "n_chars"]].itertuples(index=False)]
    return t, m, np.array([text.raw(x) for x in t]), np.array([meta.raw(x) for x in m])


def _counts(rows: DataFrame, make) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of the two views' counts; ``make`` yields (features, label) for each view of a batch."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 2 * SIZE + 2))
        trigrams = Trigrams()
        for b in batches:
            for view, features, label in make(b, trigrams):
                total[view, label * SIZE + np.asarray(features, np.int64)] += 1
                total[view, 2 * SIZE + label] += 1
        view, at = np.nonzero(total)
        yield pd.DataFrame({"view": view, "at": at, "n": total[view, at]})

    found = rows.mapInPandas(count, "view int, at int, n double").groupBy("view", "at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, 2 * SIZE + 2))
    out[found["view"], found["at"]] = found["n"]
    return out[0], out[1]


def _inputs(docs: DataFrame, id_col: str, text_col: str, meta: tuple[str, str, str]) -> DataFrame:
    names = ("source", "lang", "n_chars")
    kinds = ("string", "string", "double")
    own = [F.col(c).cast(k).alias(n) if c in docs.columns else F.lit(None).cast(k).alias(n) for c, n, k in zip(meta, names, kinds, strict=True)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    rounds: int = 2,
    confident: float = 0.98,
    labelled: int = LABELLED,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta: tuple[str, str, str] = META,
) -> Classifier:
    """Fit on about ``labelled`` labelled rows, chosen by a hash of the identifier, and on all other rows' pseudo-labels.

    Repeated labels of a row count as their smallest; labels that are null or not 0 or 1 are none.
    Without labels of both classes all documents score alike. A fifth of the sample only calibrates.
    """
    ship()
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)")
    n = known.count()
    share = F.lit(int(min(1.0, labelled / max(n, 1)) * (1 << 30)))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share
    sample = known.where(chosen).groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = _inputs(docs, id_col, text_col, meta)
    # At most about ``labelled`` pairs of numbers.
    own = materialize(rows.join(F.broadcast(sample), "doc_id").withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 0), "labelled")

    def taught(b: pd.DataFrame, trigrams: Trigrams):
        for text, source, lang, n_chars, y in b[["text", "source", "lang", "n_chars", "y"]].itertuples(index=False):
            yield 0, trigrams(text), y
            yield 1, meta_features(source, lang, n_chars), y

    first = _counts(own.where("not aside"), taught)
    aside = own.where("aside").select("text", "source", "lang", "n_chars", "y")

    def calibrated(counts) -> tuple[View, View, np.ndarray, np.ndarray, np.ndarray]:
        views = View(counts[0]), View(counts[1])
        held = spark.sparkContext.broadcast(views)

        def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trigrams = Trigrams()
            for b in batches:
                _, _, t, m = _raw(b, *held.value, trigrams)
                yield pd.DataFrame({"t": t, "m": m, "y": b["y"]})

        got = aside.mapInPandas(raw, "t double, m double, y int").toPandas()
        t, m, y = (got[c].to_numpy(np.float64) for c in ("t", "m", "y"))
        views[0].calibrate(t, y)
        views[1].calibrate(m, y)
        return *views, t, m, y

    text, page, t, m, y = calibrated(first)
    others = rows.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((text, page))

        def exchanged(b: pd.DataFrame, trigrams: Trigrams, held=held):
            views = held.value
            t, m, raw_t, raw_m = _raw(b, *views, trigrams)
            edge = np.log(confident / (1 - confident))
            for i, z in enumerate(views[0].logit(raw_t)):
                if abs(z) >= edge and len(t[i]):
                    yield 1, m[i], int(z > 0)
            for i, z in enumerate(views[1].logit(raw_m)):
                if abs(z) >= edge and len(t[i]):
                    yield 0, t[i], int(z > 0)

        more = _counts(others, exchanged)
        text, page, t, m, y = calibrated([a + b for a, b in zip(first, more, strict=True)])
    # Views that know nothing of each other add up, so that is what few rows are drawn to.
    weights = fit_logistic(np.column_stack((text.logit(t), page.logit(m))), y, 20.0, 1.0) if len(y) else np.zeros(3)
    return Classifier(text, page, weights)


def quality(spark, model: Classifier, docs: DataFrame, text_col: str = "text", meta: tuple[str, str, str] = META) -> Column:
    """Struct (score, text_score, page_score) of a row's whole text and metadata; unknown metadata is a value."""
    ship()
    held = spark.sparkContext.broadcast(model)
    kinds = ("string", "string", "double")
    inputs = [F.col(c).cast(k) if c in docs.columns else F.lit(None).cast(k) for c, k in zip(meta, kinds, strict=True)]

    @F.pandas_udf("score double, text_score double, page_score double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        trigrams = Trigrams()
        for columns in batches:
            b = pd.DataFrame(dict(zip(("text", "source", "lang", "n_chars"), columns, strict=True)))
            _, _, t, m = _raw(b, held.value.text, held.value.meta, trigrams)
            yield pd.DataFrame(dict(zip(("score", "text_score", "page_score"), held.value.scores(t, m), strict=True)))
        give_back()

    return run(F.col(text_col).cast("string"), *inputs)
