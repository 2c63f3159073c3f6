"""Tokenizer alignment, vector codes and toxicity against plain Python and SQL."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from barloom.llm import alignment, toxicity, vector_codes
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def token_bytes(sides):
    """Bytes of identifiers by the byte-level table and the pieces' own rules."""
    a, b = sides
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(x): x for x in plain}
    char |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    of_a = lambda i: bytes(char[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return of_a, of_b


def by_hand(texts, sides):
    """The contract's columns for each text, whole texts to the libraries and one loop over tokens."""
    of_a, of_b = token_bytes(sides)
    split = []
    for t in texts:
        groups = []
        if t:
            data = (" " + t).encode()
            ids = [sides[0].encode(" " + t, add_special_tokens=False).ids, sides[1].encode(t)]
            raw = [[of_a(i) for i in ids[0]], [of_b(i) for i in ids[1]]]
            if all(b"".join(r) == data for r in raw):
                ends = [set(np.cumsum([len(x) for x in r]).tolist()) for r in raw]
                both = sorted(ends[0] & ends[1])
                at = [0, 0]
                done = [0, 0]
                for end in both:
                    group = ([], [])
                    for s in (0, 1):
                        while done[s] < end:
                            group[s].append(ids[s][at[s]])
                            done[s] += len(raw[s][at[s]])
                            at[s] += 1
                    groups.append(group)
        split.append(groups)
    count = Counter((x[-1], y[-1]) for groups in split for x, y in groups)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for groups in split:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
                sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("common", [0, 5, 50_000])
def test_alignment_of_odd_rows_equals_the_libraries(spark, odd, sides, common):
    """Rare pairs by the join and frequent ones by the look-up give the same."""
    got = alignment.align(odd, common=common).collect()
    want = by_hand([t for _, t in ODD], sides)
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in got) == sorted((str(i), *w) for (i, _), w in zip(ODD, want, strict=True))


def test_alignment_of_no_rows(none):
    assert alignment.align(none).count() == 0


def test_parts_join_to_the_whole(sides):
    """Texts cut at safe places have the tokens of whole texts, with a memory that is emptied all the time."""
    v = alignment.vocabularies(public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE))
    worker = alignment.Aligned(v, remembered=0)
    rng = np.random.default_rng(3)
    alphabet = list("ab Z9'.,\n\t é日▁ ́\U0001f600") + ["  ", "\n\n", " the", "'s", "<s>", "<0x41>", "<|endoftext|>", "\r\n", "Ж "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(400)]
    for at in range(0, 400, 50):
        part = texts[at : at + 50]
        sizes, digests, *_ = worker.batch(part)
        want = by_hand(part, sides)
        assert [(*s, d) for s, d in zip(sizes.tolist(), digests, strict=True)] == [(w[0], w[1], w[3], w[6]) for w in want]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_op11(spark, sides):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in docs], by_hand([r["text"] for r in docs], sides), strict=True))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in entry.queries()["op11_token_alignment"](spark, SF).collect()}
    assert got == want and any(w[4] < w[3] for w in want.values())


# ---- vector codes


def codes_by_hand(rows, entries=256, rounds=4, parts=4):
    good = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    v = [[int(np.floor(1024 * np.float64(x))) for x in r[1]] for r in good]
    w = len(v[0]) // parts if v else 0
    cut = [[x[k * w : k * w + w] for k in range(parts)] for x in v]
    books = [[x[k] for x in cut[:entries]] for k in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            own = {}
            for x in cut:
                own.setdefault(near(x[k], books[k])[1], []).append(x[k])
            for i, xs in own.items():
                books[k][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[near(x[k], books[k]) for k in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(good, errors, strict=True):
        by_label[r[2]] += e
    return sorted(str((r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], digest)) for r, f, e in zip(good, found, errors, strict=True))


def test_orchard_is_exact_with_ties_to_the_lower_index():
    rng = np.random.default_rng(5)
    for k, w, spread in ((1, 3, 4), (7, 2, 2), (40, 4, 3), (256, 8, 1000)):
        entries = rng.integers(-spread, spread + 1, (k, w))
        q = rng.integers(-2 * spread, 2 * spread + 1, (500, w))
        apart = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
        at, d = vector_codes.Orchard(entries).nearest(q)
        assert (at == apart.argmin(axis=1)).all() and (d == apart.min(axis=1)).all()


def test_vector_codes_with_nulls_ties_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.02, 8)], int(i % 3) if i % 5 else None) for i in range(60)]
    rows += [(61, None, 1), (62, [0.1] * 7 + [None], 1), (63, [0.1] * 7 + [float("nan")], 1), (64, [float("-inf")] + [0.0] * 7, 2)]
    rows += [(None, [0.5] * 8, None), (3, rows[3][1], 0), (3, rows[3][1], 0), (4, [-0.001] * 8, None)]
    table = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    for entries in (256, 16):
        got = sorted(str(tuple(r)) for r in vector_codes.compress(table, entries=entries).collect())
        assert got == codes_by_hand(rows, entries)
    assert vector_codes.compress(table.where("vec_id > 100")).count() == 0
    assert vector_codes.compress(table.where("vec_id = 61")).count() == 0
    with pytest.raises(ValueError, match="components"):
        vector_codes.integers(np.array([[1e9]]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_op12_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    cur = con.execute(entry.oracle_sql()["op12_vector_codes"])
    cols = [d[0] for d in cur.description]
    got = entry.queries()["op12_vector_codes"](spark, SF).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


# ---- toxicity


def test_windows_hold_the_whole_text():
    for text in ("", "   ", "One two\tthree", "x" * 1000, "wort " * 500, "Été 日本語 " * 60):
        parts = toxicity.windows(text, 64)
        assert b"".join(p[1:] for p in parts) == " ".join(text.split()).lower().encode()
        assert all(len(p) <= 129 for p in parts)


def test_toxicity_on_odd_rows(spark, odd, none):
    """Labels that are null, repeated or out of range teach nothing; unknown texts score like those without a distance."""
    kind = "doc_id long, toxic int, text string"
    labels = spark.createDataFrame([(5, 1, "c"), (6, 0, "c"), (6, 1, "c"), (7, None, "c"), (9, 3, "c"), (None, 1, "c"), (1, 1, "c")], kind)
    model = toxicity.train(odd, labels)
    scores = {r["doc_id"]: r["s"] for r in odd.select("doc_id", toxicity.toxicity(spark, model, odd["text"]).alias("s")).collect()}
    assert len(scores) == 16 and all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2] == scores[3]
    for no_labels in (labels.where("false"), labels.where("doc_id = 6")):
        none_toxic = toxicity.train(odd, no_labels)
        assert none_toxic.score("anything") < 1e-9 and none_toxic.score(None) < 1e-9
    assert toxicity.train(none, labels).score("a") < 1e-9
    assert none.select(toxicity.toxicity(spark, model, none["text"])).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables absent")
def test_toxicity_of_labels_no_fit_has_seen(spark):
    """English toxic pages carry the marking words; of those without them (label noise) nothing can be known."""
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in entry.queries()["op13_toxicity"](spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    rows = [r for r in rows if got[r["doc_id"]]["held_out"]]
    clean = [got[r["doc_id"]]["predicted"] for r in rows if r["toxic"] == 0]
    toxic = [got[r["doc_id"]]["predicted"] for r in rows if r["toxic"] == 1 and r["lang"] == "en"]
    assert len(clean) > 800 and np.mean(clean) < 0.02 and np.mean(toxic) > 0.8
