"""Near-duplicates by 64-bit SimHash, found through an inverted index over byte positions.

Two fingerprints that differ in at most three bits share at least five of their eight bytes at
equal positions. Of the two halves of four positions one then has three shared bytes, so a posting
list per triple of positions within a half (eight lists a fingerprint) holds every such pair. In a
list, the shared positional bytes of a pair are tallied, pairs under the guaranteed minimum go, and
the rest are verified bit by bit. Lists beyond a size are refined by two further positions, and
lists of fingerprints that share five bytes even then are linked through their neighbours at one
and two bits, which costs each fingerprint a constant number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected, pair, ship
from barloom.session import materialize

BITS = 3
SHARED = 8 - BITS
LIMIT = 2048
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of the lower-cased word shingles in order; no words give none, fewer than ``width`` one."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[: len(found) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)),
        np.uint64,
        len(found) - width + 1,
    )


def voted(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of shingles' hashes; none give 0."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of the lower-cased word shingles; no words give 0, fewer than ``width`` one shingle."""
    return voted(shingle_hashes(text, width, seed))


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """Fingerprint of whole texts as a signed long."""
    ship()

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.array([simhash(t, width, seed) for t in b], np.uint64).view(np.int64))

    return run(text)


def _byte(i: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _key(number: int, positions: tuple[int, ...], above: Column | None = None) -> Column:
    key = F.lit(number).cast("long") if above is None else above * 16 + F.lit(number)
    for i in positions:
        key = key * 256 + _byte(i)
    return key


def _rest(triple: tuple[int, ...]) -> list[tuple[int, ...]]:
    return list(combinations([i for i in range(8) if i not in triple], 2))


def compare(keys: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs within runs of equal keys, reduced to each position's smallest reachable one."""
    n = len(keys)
    low = np.arange(n)
    left, right = [], []
    d = 1
    while d < n and (same := keys[d:] == keys[:-d]).any():
        i = np.flatnonzero(same)
        differing = fps[i] ^ fps[i + d]
        tally = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        i, differing = i[tally >= 8 - bits], differing[tally >= 8 - bits]
        i = i[np.bitwise_count(differing) <= bits]
        left.append(i)
        right.append(i + d)
        d += 1
    if not left:
        return low[:0], low[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    while len(i):
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            break
    moved = np.flatnonzero(low != np.arange(n))
    return moved, low[moved]


def _links(entries: DataFrame, limit: int, label: str) -> DataFrame:
    """Rows (a, b, null) of links and (fp, null, key) of lists over the limit; written."""
    ship()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        over: int | None = None

        def frame(a, b, key):
            return pd.DataFrame({"a": pd.Series(a, dtype="Int64"), "b": pd.Series(b, dtype="Int64"), "key": pd.Series(key, dtype="Int64")})

        def linked(k, f):
            i, j = compare(k, f)
            s = f.view(np.int64)
            return frame(s[i], s[j], [None] * len(i))

        for batch in batches:
            k, f = batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64).view(np.uint64)
            if over is not None:
                end = int(np.searchsorted(k, over, side="right"))
                if end:
                    yield frame(f[:end].view(np.int64), [None] * end, k[:end])
                k, f = k[end:], f[end:]
                if not len(k):
                    continue
                over = None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            sizes = np.diff(np.append(starts, len(keys)))
            last = int(starts[-1])
            big = np.repeat(sizes > limit, sizes)
            if big.any():
                at = np.flatnonzero(big)
                yield frame(fps[at].view(np.int64), [None] * len(at), keys[at])
            use = ~big
            if sizes[-1] > limit:
                over = int(keys[-1])
                yield linked(keys[use], fps[use])
                keys, fps = keys[:0], fps[:0]
            else:
                use[last:] = False
                yield linked(keys[use], fps[use])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield linked(keys, fps)

    dealt = entries.repartition("key").sortWithinPartitions("key", "fp")
    return materialize(dealt.mapInPandas(run, "a long, b long, key long"), label)


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` of a table within three differing bits.

    A spanning set of each list's links is kept, not all pairs, so that groups of thousands of near
    copies cost as many rows as members; what is connected is the same.
    """
    index = F.explode(F.array(*[_key(n, t) for n, t in enumerate(TRIPLES)]))
    first = _links(prints.select("fp", index.alias("key")), limit, "links")
    found = first.where("key is null").select("a", "b")
    wide = first.where("key is not null").select(F.col("a").alias("fp"), "key")
    if wide.isEmpty():
        return found
    number = F.shiftright("key", 24)
    finer = F.lit(None).cast("array<long>")
    for n, t in enumerate(TRIPLES):
        finer = F.when(number == n, F.array(*[_key(m, p, F.col("key")) for m, p in enumerate(_rest(t))])).otherwise(finer)
    second = _links(wide.select("fp", F.explode(finer).alias("key")), limit, "links")
    found = found.unionByName(second.where("key is null").select("a", "b"))
    dense = second.where("key is not null").select(F.col("a").alias("fp"), "key")
    if dense.isEmpty():
        return found
    # Members of a list differ in at most three bytes. A pair within three bits has a point at one
    # bit from the one and two from the other; a point with a member within one bit links its members.
    number, pick = F.shiftright("key", 44), F.shiftright("key", 16).bitwiseAND(F.lit(15))
    masks = F.lit(None).cast("array<struct<mask:long,near:boolean>>")
    for n, t in enumerate(TRIPLES):
        for m, p in enumerate(_rest(t)):
            free = [8 * i + b for i in range(8) if i not in t and i not in p for b in range(8)]
            flips = [((1 << a), True) for a in free] + [((1 << a) | (1 << b), False) for a, b in combinations(free, 2)]
            flat = [(0, True), *flips]
            signed = F.array(*[F.struct(F.lit(x - (1 << 64) if x >> 63 else x).alias("mask"), F.lit(k).alias("near")) for x, k in flat])
            masks = F.when((number == n) & (pick == m), signed).otherwise(masks)
    points = dense.select("fp", "key", F.explode(masks).alias("f"))
    points = materialize(points.select("fp", "key", F.col("fp").bitwiseXOR(F.col("f.mask")).alias("z"), F.col("f.near").alias("near")), "links")
    hubs = points.groupBy("key", "z").agg(F.min("fp").alias("hub"), F.bool_or("near").alias("ok")).where("ok")
    return found.unionByName(points.join(hubs, ["key", "z"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 3, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of every row; a component is its smallest doc_id.

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one
    entry of the index. Null identifiers never name a component unless all its rows have none.
    """
    found = materialize(pair(docs).select("doc_id", fingerprint(F.col("text"), width).alias("fp")), "fingerprints")
    prints = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    groups = connected(links(prints, limit)).withColumnRenamed("node", "fp")
    named = prints.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")
