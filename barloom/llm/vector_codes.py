"""Product quantisation of vectors with nearest entries found by Orchard's search.

Vectors become integers and are cut into equal parts; every part position has a codebook that
starts from the vectors of the smallest identifiers and is refined by rounds of assignment and
integer means. The nearest entry of a part is searched over neighbour lists: each entry keeps all
others sorted by distance, the search reads the list of the best entry so far, jumps to the list of an
entry that is nearer, marks what it has visited, and ends where the list passes twice the present
distance, beyond which nothing can be nearer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ship
from barloom.session import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
AT_ONCE = 8
FEW_LABELS = 100_000


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of rows whose vector and components are all known and finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & finite)


def integers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); beyond 2**27 in size squared distances would not fit 64 bits and the vector is refused."""
    out = np.floor(v * float(scale))
    if out.size and np.abs(out).max() >= 1 << 27:
        raise ValueError(f"components have to be below {(1 << 27) // scale} in size")
    return out.astype(np.int64)


class Orchard:
    """Exact nearest entries, ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = self.apart(entries[:, None, :], entries[None, :, :])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.near = np.take_along_axis(apart, self.order, axis=1)
        self.sums = entries.sum(axis=1)
        self.by_sum = np.argsort(self.sums, kind="stable")

    @staticmethod
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        off = a - b
        return np.einsum("...i,...i->...", off, off)

    def start(self, q: np.ndarray) -> np.ndarray:
        """An entry with a near sum of components, as a first guess."""
        sums = self.sums[self.by_sum]
        at = np.clip(np.searchsorted(sums, q.sum(axis=1)), 0, len(sums) - 1)
        return self.by_sum[at]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each row."""
        n, k = len(q), len(self.entries)
        at = self.start(q)
        d = self.apart(q, self.entries[at])
        visited = np.zeros((n, k), bool)
        visited[np.arange(n), at] = True
        place = np.zeros(n, np.int64)
        active = np.arange(n)
        while True:
            # A list ends at its last entry or where it passes twice the present distance.
            a, p = at[active], place[active]
            on = p < k
            on[on] = self.near[a[on], p[on]] <= 4 * d[active[on]]
            active = active[on]
            if not len(active):
                return at, d
            a = at[active]
            span = place[active][:, None] + np.arange(AT_ONCE)
            inside = span < k
            seen = self.order[a[:, None], np.minimum(span, k - 1)]
            fresh = inside & ~visited[active[:, None], seen]
            row, col = np.nonzero(fresh)
            visited[active[row], seen[row, col]] = True
            place[active] += AT_ONCE
            if not len(row):
                continue
            who, entry = active[row], seen[row, col]
            far = self.apart(q[who], self.entries[entry])
            better = (far < d[who]) | ((far == d[who]) & (entry < at[who]))
            if better.any():
                who, entry, far = who[better], entry[better], far[better]
                order = np.lexsort((entry, far, who))
                who, entry, far = who[order], entry[order], far[order]
                first = np.flatnonzero(np.diff(who, prepend=-1))
                who = who[first]
                at[who], d[who], place[who] = entry[first], far[first], 0


def _matrix(b: pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    flat = b.column("v").flatten().to_numpy()
    if len(flat) != len(b) * width or (b.column("v").value_lengths().to_numpy() != width).any():
        raise ValueError(f"vectors have to have {width} components each")
    return integers(flat.reshape(len(b), width), scale)


def _first(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """Codebooks (part, entry, position) from the rows with the smallest identifiers; unknown ones come last, equal ones by vector."""
    found = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    if not found:
        return np.zeros((parts, 0, 0), np.int64)
    if len({len(r["v"]) for r in found}) > 1 or len(found[0]["v"]) % parts:
        raise ValueError(f"vectors have to have equal lengths, a multiple of {parts}")
    v = integers(np.array([r["v"] for r in found], np.float64), scale)
    return np.stack(np.split(v, parts, axis=1))


def _refined(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    parts, entries, width = books.shape
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(x) for x in held.value]
        total = np.zeros((parts * entries, width + 1), np.int64)
        for b in batches:
            v = _matrix(b, parts * width, scale)
            for k, q in enumerate(np.split(v, parts, axis=1)):
                cell = k * entries + searches[k].nearest(q)[0]
                np.add.at(total[:, :width], cell, q)
                np.add.at(total[:, width], cell, 1)
        used = np.flatnonzero(total[:, width])
        cells = (used[:, None] * (width + 1) + np.arange(width + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[used].ravel())], names=["cell", "total"])

    # One row for each cell of the codebooks: their size bounds what comes back.
    sums = rows.select("v").mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = np.zeros((parts * entries, width + 1), object)
    for r in sums.collect():
        found[r["cell"] // (width + 1), r["cell"] % (width + 1)] = int(r["total"])
    out = books.reshape(parts * entries, width).copy()
    for i in np.flatnonzero(found[:, width] > 0):
        out[i] = [int(x) // int(found[i, width]) for x in found[i, :width]]
    return out.reshape(parts, entries, width)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (part, entry, position) of all ``kept`` rows; fewer rows than entries make as many entries, no rows none."""
    ship()
    books = _first(rows, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = _refined(rows, books, scale)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of ``kept`` rows: two hex digits a part and the summed squared distances."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code of two hex digits tells 256 entries apart")
    ship()
    held = rows.sparkSession.sparkContext.broadcast(books)
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(x) for x in held.value] if held.value.size else []
        for b in batches:
            v = _matrix(b, parts * width, scale)
            code, error = np.zeros((len(b), parts), np.uint8), np.zeros(len(b), np.int64)
            for k, q in enumerate(np.split(v, parts, axis=1)):
                code[:, k], d = searches[k].nearest(q)
                error += d
            text = code.tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
            )

    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a whole vector.

    Rows whose vector is null or holds a null or non-finite component are dropped. Repeated rows and
    identifiers count each; a null identifier is kept and starts no codebook while others are left;
    null labels are one label. Vectors of unequal lengths, of a length that the parts do not divide
    or of components that overflow are an error. An empty table gives no rows.
    """
    rows = kept(vectors, id_col, vector_col, label_col)
    books = train(rows, parts, entries, rounds, scale)
    coded = materialize(encode(rows, books, scale), "vector-codes")
    sums = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
