import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import byte_bpe, packing, token_counts
from barloom.llm.word_bpe import Words, default_path
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def odd_texts(seed, n=400):
    rng = random.Random(seed)
    alphabet = list("aB'sétdÖ1 9\n\t.,!|<>\x1c\x85\xa0 ́日") + ["<|endoftext|>", "'ll", "'s", "  ", "İ", "Σ"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bytes_round_trip_and_library(spark, odd):
    path = public_tokenizers.path(byte_bpe.RANKS)
    enc = byte_bpe.encoding(path)
    texts = odd_texts(1) + [t or "" for _, t in ODD]
    for t in texts:
        assert byte_bpe.encode(t, path, 16) == np.array(enc.encode_ordinary(t), "<u4").tobytes()
    rows = odd.select("doc_id", "text", byte_bpe.encoded(F.col("text")).alias("ids")).withColumn("back", byte_bpe.decoded("ids")).collect()
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in rows)
    assert isinstance(enc, tiktoken.Encoding)


def test_counts_equal_library(odd, library, none):
    texts = odd_texts(2) + [t or "" for _, t in ODD]
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Words(default_path(), False, remembered=50, call_bytes=40).counts(texts) == want
    got = odd.select("text", token_counts.token_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(library.encode(r["text"] or "", add_special_tokens=False)) for r in got)
    assert none.select(token_counts.token_count(F.col("text"))).count() == 0


def test_packing_whole_texts(odd, library, none):
    got = packing.packed_spans(odd, capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[i].append((k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {i: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for i, v in by_doc.items()} == {i: sorted(v) for i, v in want.items()}
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed_spans(none).count() == 0


def fewest(items, capacity):
    """Fewest bins by exhaustive search."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                put(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        put(k + 1, [*bins, items[k]])

    put(0, [])
    return best[0]


def used(patterns):
    return sum(n for _, n in patterns)


def test_dominance_keeps_the_optimum():
    """Fixing dominating sets never costs a bin: fixed bins plus the optimum of the rest is the optimum."""
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        histogram = {w: items.count(w) for w in set(items)}
        fixed, rest = packing.reduce(histogram, capacity)
        left = [w for w, n in rest.items() for _ in range(n)]
        assert used(fixed) + fewest(left, capacity) == fewest(items, capacity), (items, capacity, fixed)
        whole = packing.plan(histogram, capacity)
        packed = sorted(w for p, n in whole for w in p * n)
        assert packed == sorted(items) and all(sum(p) <= capacity for p, _ in whole)


def test_best_fit_equals_one_by_one():
    rng = random.Random(5)
    for _ in range(100):
        capacity = 50
        items = sorted((rng.randrange(1, 30) for _ in range(60)), reverse=True)
        bins = []
        for w in items:
            fit = [i for i, r in enumerate(bins) if r >= w]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= w
            else:
                bins.append(capacity - w)
        patterns = packing.best_fit({w: items.count(w) for w in set(items)}, capacity)
        assert sorted(capacity - sum(p) for p, n in patterns for _ in range(n)) == sorted(bins)
