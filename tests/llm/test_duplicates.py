import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import exact_dedup, jaccard, simhash
from barloom.llm.common import connected
from barloom.session import materialize
from tests.llm import helpers


def by_text(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[helpers.normalised(t)].append(i)
    return groups


def check_exact(docs, **more):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    groups = by_text(rows)
    got = exact_dedup.deduplicate(docs, **more).collect()
    assert len(got) == len(rows)
    want = Counter()
    for members in groups.values():
        known = [i for i in members if i is not None]
        keep = min(known) if known else None
        for i in members:
            want[i, keep, len(members)] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    return got


def test_exact_odd_rows(odd):
    got = check_exact(odd)
    assert {r["digest"] for r in got} >= {hashlib.sha256(b"").hexdigest()}


def test_exact_in_several_batches(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"t {rng.randrange(40)}") for i in range(300)]
    check_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), files_per_batch=2, broadcast_up_to=0)


def test_exact_clashing_digests_are_told_apart_by_bytes(spark):
    rows = [(i, f"text {i % 9}") for i in range(60)] + [(5, "text 5")]
    check_exact(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda t: F.substring(F.sha2(t, 256), 1, 0 + 1))


def test_exact_empty(none):
    assert exact_dedup.deduplicate(none).count() == 0


def check_near(docs, **more):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs, **more).collect()
    assert len(got) == len(rows)
    prints = sorted({helpers.simhash(t) for _, t in rows})
    root = dict(zip(prints, helpers.components(prints), strict=True))
    lowest = {}
    for i, t in rows:
        k = root[helpers.simhash(t)]
        lowest[k] = min([x for x in (lowest.get(k), i) if x is not None], default=None)
    want = Counter((i, helpers.simhash(t), lowest[root[helpers.simhash(t)]]) for i, t in rows)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def test_near_odd_rows(odd):
    check_near(odd)


def test_near_copies(spark):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(150)] = "changed"
            rows.append((rng.randrange(10_000), " ".join(copy)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("limit", [2048, 6, 1])
def test_links_in_lists_of_every_size(spark, limit):
    """Refined lists and lists linked through neighbours connect what pairwise comparison connects."""
    rng = np.random.default_rng(3)
    prints = set()
    for _ in range(6):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            x = at
            for b in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(b)
            prints.add(x)
    low = int(rng.integers(0, 1 << 63)) & ~0xFFFFFF
    prints |= {low | int(x) for x in rng.integers(0, 1 << 9, 40)}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["component"] for r in connected(simhash.links(df, limit)).collect()}
    want = helpers.components(prints)
    groups = Counter()
    for x, k in zip(signed, want, strict=True):
        groups[k, got.get(x, x)] += 1
    assert len(groups) == len(set(want)) == len({c for _, c in groups})


def test_connected_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(30)} == {100}


def test_near_empty(none):
    assert simhash.near_duplicates(none).count() == 0


def alike(rows):
    """Smallest doc_id reachable over pairs of 5-word Jaccard similarity 0.8 and more."""
    sets = []
    for _, t in rows:
        w = helpers.words(t)
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                par[b] = a
    lowest = {}
    for k, (i, _) in enumerate(rows):
        lowest[find(k)] = min([x for x in (lowest.get(find(k)), i) if x is not None], default=None)
    return Counter((i, lowest[find(k)]) for k, (i, _) in enumerate(rows))


def test_pipeline_near_copies(spark, odd, none):
    """Copies with a replaced passage or scattered edits, around and over 0.8 and up to it, link as their sets say."""
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(300)]
        for k in range(12):
            copy, n = list(base), rng.randrange(70)
            if k % 2:
                copy[100 : 100 + n] = [f"new{rng.randrange(10**9)}" for _ in range(n)]
            else:
                for _ in range(n // 10):
                    copy[rng.randrange(300)] = f"new{rng.randrange(10**9)}"
            rows.append((1000 + 100 * g + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = alike(rows)
    assert Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()) == want
    kept = {i for i, low in want if i == low}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, "").collect()} == kept
    assert jaccard.near_duplicates(none).count() == 0


def test_fingerprints_bring_the_first_pairs(spark, monkeypatch):
    """Near copies are joined by SimHash before any minima are looked at, and pairs too far apart never."""
    rng = np.random.default_rng(31)
    rows = []
    for k in range(6):
        words = [f"w{x}" for x in rng.integers(0, 5000, 1500)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words[:-1], "other"])), (10 * k + 2, " ".join(words[:800] + [f"v{x}" for x in rng.integers(0, 5000, 700)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: i - i % 10 if i % 10 == 1 else i for i, _ in rows}
    monkeypatch.setattr(jaccard, "_lists", lambda entries: entries.where("false").selectExpr("key", "node", "node as hub"))
    alone = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert sum(alone[10 * k + 1] == 10 * k for k in range(6)) >= 4 and all(alone[i] == i for i, _ in rows if i % 10 == 2)


def test_many_texts_almost_alike_make_no_rows_of_pairs(spark, monkeypatch):
    """Texts that all share bands at similarities around 0.7 cost their members, and links among them are found."""
    rng, rows = random.Random(9), []
    base = [f"w{k}" for k in range(150)]
    for k in range(150):
        copy, at = list(base), rng.randrange(140)
        copy[at : at + 10] = [f"new{k}x{x}" for x in range(10)]
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join([*rows[k][1].split()[:-6], *(f"end{k}x{x}" for x in range(6))])) for k in range(0, 150, 7)]
    docs, made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), []

    def counted(df, label):
        out = materialize(df, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    # Without best partners all is left to the last step.
    monkeypatch.setattr(jaccard, "BEST_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert got == alike(rows)
    assert max(n for label, n in made if label in ("pairs", "links")) <= jaccard.BANDS * len(rows)
