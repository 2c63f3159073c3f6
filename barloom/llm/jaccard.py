"""Near-duplicates by SimHash and the Jaccard similarity of word shingles, at least 4/5.

Texts whose SimHash fingerprints (``simhash.links``, the positional index of bytes) differ in at most
three bits are the first pairs held against each other, decided by their sets of shingles. Three bits
stand for a similarity of about 0.98: a pair at 0.8 differs in about ten of 64 bits, and an index of
bits that misses few of those would need hundreds of lists a text. What fingerprints leave apart is
therefore looked for among minima: each set has 128 minima under random orders, pairs are looked for
among texts that share all four minima of one of 32 bands, and decided by their sets, so no pair under
0.8 is linked. A pair of similarity 0.8 is missed with a chance of (1 - 0.8^4)^32 = 5e-8 for the bands
and 2e-7 for the bytes below; more alike pairs are missed less.

In a band's list every member that fingerprints have not joined to the smallest one is first held
against it, so a group of copies costs its members. Members that this leaves in different components are then held against their best
partners, a few times over. At last all pairs of a list that are still in different components are
looked at: those whose 128 minima, a byte each, agree at ``SHARED`` or more positions have their
sets compared. The sets are brought to the lists for this, so pairs are never rows: a list gives the
links that join its components, fewer than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected, give_back, pair, ship
from barloom.llm.simhash import links as simhash_links
from barloom.llm.simhash import shingle_hashes, voted
from barloom.session import materialize

WIDTH = 5
BANDS, ROWS = 32, 4
SKETCH, SHARED = 128, 78
# Smaller sets are 0.8 alike only if equal, and equal sets are one entry.
LEAST = 4
BEST_ROUNDS = 3
# Sets that a set is held against at once.
BLOCK = 512
_ORDERS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word shingles; no words give none."""
    return np.unique(shingle_hashes(text, width))


def node(found: np.ndarray) -> int:
    """Signed name of a set; equal sets have one name."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.astype("<u8").tobytes())).view(np.int64))


def minima(found: np.ndarray) -> np.ndarray:
    low = np.full(len(_ORDERS), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1 << 12):
        low = np.minimum(low, (found[None, at : at + (1 << 12)] * _ORDERS[:, None]).min(axis=1))
    return low


def sketch(found: np.ndarray) -> tuple[bytes, list[int]]:
    """Positional bytes and the keys of the bands."""
    low = minima(found)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _STEP
        keys ^= keys >> np.uint64(29)
    return (low[:SKETCH] >> np.uint64(24)).astype(np.uint8).tobytes(), keys.view(np.int64).tolist()


def _described(text: Column, width: int) -> Column:
    ship()

    @F.pandas_udf("node long, n int, fp long, sketch binary, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b:
                hashes = shingle_hashes(t, width)
                found, fp = np.unique(hashes), np.uint64(voted(hashes)).view(np.int64)
                rows.append((node(found), len(found), fp, *(sketch(found) if len(found) >= LEAST else (b"", []))))
            yield pd.DataFrame(rows, columns=["node", "n", "fp", "sketch", "bands"])
        give_back()

    return run(text)


def _sets(text: Column, width: int) -> Column:
    ship()

    @F.pandas_udf("node long, items array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t, width) for t in b]
            yield pd.DataFrame({"node": [node(x) for x in found], "items": [x.view(np.int64) for x in found]})
        give_back()

    return run(text)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows sorted by key in frames that never cut a key's run, with the runs' starts and sizes."""

    def runs(b):
        starts = np.flatnonzero(np.diff(b["key"].to_numpy(), prepend=b["key"].iloc[0] - 1))
        return b, starts, np.diff(np.append(starts, len(b)))

    parts: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b["key"].to_numpy()
        if parts and k[-1] == parts[0]["key"].iloc[-1]:
            parts.append(b)
            continue
        cut = int(np.searchsorted(k, k[-1]))
        done = pd.concat([*parts, b[:cut]], ignore_index=True)
        parts = [b[cut:]]
        if len(done):
            yield runs(done)
    if parts:
        yield runs(pd.concat(parts, ignore_index=True))


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SKETCH)


def _alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sketches allow 0.8, and sizes do."""
    return ((a == b).sum(axis=1) >= SHARED) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def _lists(entries: DataFrame) -> DataFrame:
    """Lists (key, node) of two and more nodes, each node once, with the list's smallest as hub; written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, starts, sizes in _whole(batches):
            names = b["node"].to_numpy()
            hub = np.repeat(names[starts], sizes)
            again = np.zeros(len(b), bool)
            again[1:] = names[1:] == names[:-1]
            again[starts] = False
            held = ~again & np.repeat(np.logical_or.reduceat(names != hub, starts), sizes)
            if held.any():
                yield b.assign(hub=hub)[held]
        give_back()

    dealt = entries.repartition("key").sortWithinPartitions("key", "node")
    return materialize(dealt.mapInPandas(run, "key long, node long, hub long"), "lists")


def _dealt(lists: DataFrame) -> DataFrame:
    return lists.repartition("key").sortWithinPartitions("key", "node")


def _mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists, one at a time, whose members are of several components."""
    for b, starts, sizes in _whole(batches):
        component = b["component"].to_numpy()
        mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
        for at, size in zip(starts[mixed].tolist(), sizes[mixed].tolist(), strict=True):
            yield b[at : at + size]


def _main(c: np.ndarray) -> np.ndarray:
    """Whether a member is in the largest of the components."""
    kinds, counts = np.unique(c, return_counts=True)
    return c == kinds[counts.argmax()]


def _across(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a > b, of one list that may be alike and are in different components.

    A member outside the list's largest component is paired once, with the other components' member
    whose sketch agrees most: at most as many pairs as members.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _mixed(batches):
            c, name, marks, n = b["component"].to_numpy(), b["node"].to_numpy(), _bytes(b["sketch"]), b["n"].to_numpy(np.int64)
            left, right = [], []
            for i in np.flatnonzero(~_main(c)).tolist():
                j = np.flatnonzero(c != c[i])
                j = j[_alike(marks[j], marks[i], n[j], n[i])]
                if len(j):
                    j = j[np.argmax((marks[j] == marks[i]).sum(axis=1))]
                    left.append(max(name[j], name[i]))
                    right.append(min(name[j], name[i]))
            if left:
                yield pd.DataFrame({"a": left, "b": right})
        give_back()

    return _dealt(lists).mapInPandas(run, "a long, b long").distinct()


def _rivals(b: pd.DataFrame, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Members of a list outside its largest component, each with those that may be alike to it.

    They are in another component by ``c``, which may change between two members, and share no band
    before this list's, so that a pair comes in one list only.
    """
    marks, n, bands = _bytes(b["sketch"]), b["n"].to_numpy(np.int64), np.stack(b["bands"].to_list())
    earlier = bands[:, : int(np.argmax(bands[0] == b["key"].iloc[0]))]
    main, at = _main(c), np.arange(len(c))
    for i in np.flatnonzero(~main).tolist():
        j = np.flatnonzero((c != c[i]) & (main | (at > i)))
        j = j[_alike(marks[j], marks[i], n[j], n[i])]
        yield i, j[~(earlier[j] == earlier[i]).any(axis=1)]


def _open(lists: DataFrame) -> DataFrame:
    """Members (key, node, component) that may be alike to a member of another component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _mixed(batches):
            held = np.zeros(len(b), bool)
            for i, j in _rivals(b, b["component"].to_numpy()):
                held[i] |= len(j) > 0
                held[j] = True
            if held.any():
                yield b[["key", "node", "component"]][held]
        give_back()

    return _dealt(lists).mapInPandas(run, "key long, node long, component long")


def _joined(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a > b, of one list whose sets have a Jaccard similarity of at least 4/5.

    All pairs of different components are decided by their sets where the list is, and those that
    join components not yet joined within it are returned: fewer pairs than members.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _mixed(batches):
            c, name = b["component"].to_numpy().copy(), b["node"].to_numpy()
            size = b["items"].map(len).to_numpy(np.int64)
            words = np.unique(np.concatenate(b["items"].to_list()), return_inverse=True)[1]
            words, held = np.split(words, np.cumsum(size)[:-1]), np.zeros(words.max() + 1, np.int64)
            left, right = [], []
            for i, rivals in _rivals(b, c):
                held[words[i]] = 1
                for at in range(0, len(rivals), BLOCK):
                    j = rivals[at : at + BLOCK]
                    j = j[c[j] != c[i]]
                    if not len(j):
                        continue
                    common = np.add.reduceat(held[np.concatenate([words[k] for k in j])], np.cumsum(size[j]) - size[j])
                    for k in j[9 * common >= 4 * (size[j] + size[i])].tolist():
                        if c[k] != c[i]:
                            left.append(max(name[k], name[i]))
                            right.append(min(name[k], name[i]))
                            c[c == c[k]] = c[i]
                held[words[i]] = 0
            if left:
                yield pd.DataFrame({"a": left, "b": right})
        give_back()

    return _dealt(lists).mapInPandas(run, "a long, b long").distinct()


def _items(needed: DataFrame, texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Sets (node, items) of the needed nodes; written."""
    ids = nodes.join(needed, "node", "left_semi").select(F.col("first").alias("_id")).distinct()
    rows = texts.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = rows.select(_sets(F.col("text"), width).alias("s")).select("s.node", "s.items")
    return materialize(sets.join(needed, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Pairs whose sets have a Jaccard similarity of at least 4/5."""
    sets = _items(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, nodes, width)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "links")


def _printed(found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a > b, of sets whose fingerprints are equal or linked; each fingerprint's smallest set stands for it."""
    sets = found.select("fp", "node").distinct()
    prints = materialize(sets.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = sets.join(prints, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = simhash_links(prints).select("a", "b").distinct()
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    near = near.join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    pairs = same.unionByName(near.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
    return materialize(pairs.distinct(), "pairs")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, component_id) of every row; a component is its smallest doc_id.

    Texts without words are one set; texts of fewer than ``width`` words are one shingle. Null
    identifiers never name a component unless all its rows have none.
    """
    texts = pair(docs)
    found = materialize(texts.select("doc_id", _described(F.col("text"), width).alias("d")).select("doc_id", "d.*"), "sketches")
    nodes = materialize(found.groupBy("node").agg(F.min("doc_id").alias("first")), "sketches")
    printed = _printed(found)
    links = _verified(printed, texts, nodes, width)
    groups = connected(links)
    lists = _lists(found.select(F.explode("bands").alias("key"), "node"))
    hubs = lists.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct().join(printed, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        hubs = hubs.join(groups.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left")
    apart = F.coalesce("_a", "a") != F.coalesce("_b", "b")
    hubs = materialize(hubs.where(apart).select("a", "b"), "pairs")
    links = links.unionByName(_verified(hubs, texts, nodes, width))
    groups = connected(links)
    tried, held = printed.unionByName(hubs), lists.drop("hub")
    # Most of what belongs together is joined by each member's best partner, so that few sets are left for all pairs.
    for best in [True] * BEST_ROUNDS + [False]:
        named = held.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        named = materialize(named.join(mixed, "key", "left_semi").select("key", "node", "component"), "lists")
        held = named.drop("component")
        marks = found.join(named.select("node").distinct(), "node", "left_semi").groupBy("node")
        marks = marks.agg(*[F.first(x).alias(x) for x in ("n", "sketch", *([] if best else ["bands"]))])
        if best:
            more = materialize(_across(named.join(marks, "node")).join(tried, ["a", "b"], "left_anti"), "pairs")
            if more.isEmpty():
                continue
            tried = tried.unionByName(more)
            new = _verified(more, texts, nodes, width)
        else:
            rest = materialize(_open(named.join(marks, "node")), "lists")
            if rest.isEmpty():
                continue
            sets = _items(rest.select("node").distinct(), texts, nodes, width)
            new = materialize(_joined(rest.join(marks, "node").join(sets, "node")), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            groups = connected(links)
    named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("node", "component_id")
    return found.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id")
