"""Packing documents into as few sequences as possible.

Documents become pieces of at most one sequence. Only the number of pieces of each length decides
a plan, so the plan is made from that histogram (never more entries than a sequence has tokens):
Martello and Toth's dominance criterion permanently fixes small sets of lengths that no other
filling can beat, and best fit in decreasing order packs what is left. The plan maps the pieces'
ranks within their length to sequences; ranks and look-ups run on the workers.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import give_back, pair, ship, spread
from barloom.llm.word_bpe import REMEMBERED, default_path, flat_words, words
from barloom.session import materialize

CAPACITY = 4096
END = 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every whole text, ``end`` appended.

    Only documents over the capacity are cut; ``ids`` are packed little-endian unsigned 32-bit
    integers. Null and empty texts are the end alone; repeated rows are documents of their own.
    """
    path = path or default_path()
    ship()
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                b = batch.iloc[at : at + 256]
                rows = []
                for doc, ids in zip(b["doc_id"], words(path, True).ids(b["text"]), strict=True):
                    ids += tail
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((doc, k, start // 4, len(part) // 4, part))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return pair(docs).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids binary")


STEP_BYTES = 1 << 20


def spans(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ``pieces`` with the checksum of their identifiers instead of these.

    Identifiers stay on the worker; only numbers leave it. Texts are encoded about a megabyte at a time,
    and a worker remembers up to ``remembered`` of their parts.
    """
    path = path or default_path()
    ship()
    tail = np.array([end], "<u4")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, docs_of = batch["text"].tolist(), batch["doc_id"].tolist()
            step = np.cumsum([len(t) for t in texts]) // STEP_BYTES
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
            for at, to in zip(edges, edges[1:]):
                ids, ends = flat_words(path, remembered).flat(texts[at:to])
                rows = []
                first = 0
                for doc, last in zip(docs_of[at:to], ends.tolist(), strict=True):
                    total = last - first + 1
                    for k, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        crc = zlib.crc32(ids[first + start : min(first + start + length, last)])
                        if start + length == total:
                            crc = zlib.crc32(tail, crc)
                        rows.append((doc, k, start, length, crc))
                    first = last
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
        give_back()

    return pair(docs).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _dominating(left: np.ndarray, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``w`` that dominates every set holding it, or None."""
    room = capacity - w
    left = left.copy()
    left[w] -= 1
    sizes = np.flatnonzero(left[: room + 1])
    if not len(sizes):
        return (w,)
    k = int(sizes[-1])
    if k == room:
        return (w, k)
    small: list[int] = []
    for s in sizes[:3]:
        small += [int(s)] * min(3, int(left[s]))
    small = small[:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return (w, k)
    if len(small) == 3 and sum(small) <= room:
        return None
    # At most two others fit. The largest lower member of a pair decides whether (k, b) covers all pairs.
    twice = sizes[left[sizes] > 1]
    lower = [int(x) for x in twice[2 * twice <= room][-1:]]
    tops = np.searchsorted(sizes, room - sizes, side="right") - 1
    apart = sizes[(tops >= 0) & (sizes[tops] > sizes)]
    lower += [int(x) for x in apart[-1:]]
    if not lower:
        return (w, k)
    rest = left.copy()
    rest[k] -= 1
    second = np.flatnonzero(rest[: room - k + 1])
    if len(second) and int(second[-1]) >= max(lower):
        return (w, k, int(second[-1]))
    best = max(int(sizes[t]) + int(s) for s, t in zip(sizes, tops, strict=True) if t >= 0 and (sizes[t] != s or left[s] > 1)) if len(sizes) else 0
    return (w, k) if best <= k else None


def reduce(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed sets with their numbers, and the histogram that remains."""
    left = np.zeros(capacity + 1, np.int64)
    for w, n in histogram.items():
        left[w] = n
    fixed: list[tuple[tuple[int, ...], int]] = []
    moved = True
    while moved:
        moved = False
        for w in range(capacity, 0, -1):
            while left[w]:
                found = _dominating(left, w, capacity)
                if found is None:
                    break
                need = Counter(found)
                times = min(int(left[x]) // n for x, n in need.items())
                for x, n in need.items():
                    left[x] -= times * n
                fixed.append((found, times))
                moved = True
    return fixed, {int(w): int(left[w]) for w in np.flatnonzero(left)}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing order; equal bins and equal lengths are moved together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if not bins.get(room):
                bisect.insort(rooms, room)
                bins[room] = []
            bins[room].append((pattern, n))

    for w in sorted(histogram, reverse=True):
        n = histogram[w]
        while n:
            at = bisect.bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                put(capacity - each * w, (w,) * each, n // each)
                put(capacity - n % each * w, (w,) * (n % each), int(n % each > 0))
                break
            room = rooms[at]
            pattern, held = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            each = room // w
            full = min(held, n // each)
            n -= full * each
            held -= full
            if held and n < each:
                put(room - n * w, pattern + (w,) * n, int(n > 0))
                held -= int(n > 0)
                n = 0
            put(room - each * w, pattern + (w,) * each, full)
            put(room, pattern, held)
    return [x for part in bins.values() for x in part]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sets of lengths and how many sequences hold each."""
    if histogram and (min(histogram) < 1 or max(histogram) > capacity):
        raise ValueError("lengths have to be from 1 to the capacity")
    fixed, rest = reduce(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks: first rank, first sequence, offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    rank: Counter = Counter()
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for w in pattern:
            runs.setdefault(w, []).append((rank[w], sequence, offset))
            rank[w] += n
            offset += w
        sequence += n
    return {w: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for w, r in runs.items()}


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = 200_000) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (doc_id, piece, length and any other columns).

    The table should be cheap to read twice (a written one). Pieces of one length are interchangeable;
    they are ranked in hashed parts, so a length that most pieces share is ranked by many tasks.
    """
    ship()
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = spread(sum(counts.values()), per_task, 8)
    held = items.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    split = items.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    first = F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    offsets = split.groupBy("length", "_part").agg(F.count("*").alias("_n")).select("length", "_part", first.alias("_first"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece"))
    ranked = split.withColumn("_within", within).join(offsets, ["length", "_part"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in batches:
            w, r = lengths.to_numpy(), ranks.to_numpy()
            sequence, offset = np.empty(len(w), np.int64), np.empty(len(w), np.int64)
            order = np.argsort(w, kind="stable")
            edges = np.flatnonzero(np.diff(w[order], prepend=-1))
            for at in np.split(order, edges[1:]) if len(order) else []:
                firsts, base, start = held.value[int(w[at[0]])]
                run = np.searchsorted(firsts, r[at], side="right") - 1
                sequence[at] = base[run] + r[at] - firsts[run]
                offset[at] = start[run]
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    done = ranked.withColumn("_to", place("length", F.col("_first") + F.col("_within") - 1))
    return done.select(*items.columns, F.col("_to.sequence_id").alias("sequence_id"), F.col("_to.offset").alias("offset"))


def packed_spans(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(materialize(spans(docs, capacity, end, path, remembered), "pieces"), capacity)
