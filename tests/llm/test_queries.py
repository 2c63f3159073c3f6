"""The registered queries and the pipeline over the smallest driver tables, against plain Python or SQL."""

import hashlib
import math
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import byte_bpe, cotraining, language
from barloom.llm.common import remainder
from tests.llm import helpers
from tests.llm.test_duplicates import alike

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def held(i, m):
    return zlib.crc32(str(i).encode()) % m == 2


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_sharding", "op5_exact_dedup"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, map(tuple, df.select(cols).collect()))) == sorted(map(str, cur.fetchall()))


def test_op1(spark, docs):
    got = rows(spark, "op1_language_id")
    assert {r["doc_id"] for r in got} == set(docs) and all(r["held_out"] == held(r["doc_id"], 4) for r in got)
    unseen = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert np.mean(unseen) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_op2(spark, docs):
    ids = sorted(docs)
    got = {r["doc_id"]: r for r in rows(spark, "op2_merkle_fingerprint")}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        text, following = docs[i]["text"], docs[j]["text"]
        n = len(text) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
        assert len(text) < 200 or got[i]["near_edited"] > 0.5 > got[i]["near_next"] or text == following


def test_op4(spark, docs):
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS))
    for r in rows(spark, "op4_byte_bpe"):
        text = docs[r["doc_id"]]["text"]
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op6(spark, docs):
    ids = sorted(docs)
    prints = [helpers.simhash(docs[i]["text"]) for i in ids]
    want = {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, helpers.components(prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op6_simhash")} == want


def test_op7_on_labels_no_fit_has_seen(spark, docs):
    """Fit on half of the labels, judged on the other half."""
    folder = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = cotraining.train(table, labels.where("doc_id % 2 = 0"))
    unseen = table.join(labels.where("doc_id % 2 = 1"), "doc_id")
    got = unseen.select("quality", cotraining.quality(spark, model, unseen).alias("q")).collect()
    assert np.mean([(r["q"]["score"] >= 0.5) == (r["quality"] == 1) for r in got]) > 0.97
    assert {r["doc_id"] for r in rows(spark, "op7_cotraining_quality")} == set(docs)


def test_op8(spark, docs, library):
    for r in rows(spark, "op8_token_counts"):
        text = docs[r["doc_id"]]["text"]
        n = len(library.encode(text, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op9_pitman_yor")}
    count = defaultdict(int)
    for i, d in docs.items():
        for w in [*helpers.words(d["text"]), None] if not held(i, 7) else []:
            count[w] += 1
    n, v = sum(count.values()), len(count)
    for i, d in docs.items():
        own = [*helpers.words(d["text"]), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 7), len(own), sum(w in count for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    unseen = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def packed(got, texts, library):
    """Pieces equal the library's; sequences are gapless, hold at most 4096 and are as few as the lower bound plus one."""
    want, total = {}, 0
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[i, k] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 1


def test_op10(spark, docs, library):
    packed(rows(spark, "op10_packing"), {i: d["text"] for i, d in docs.items()}, library)


def test_pipeline(spark, docs, library):
    """Each stage again in plain Python, with the two fitted models taken as given."""
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    unseen = remainder("doc_id", 4) == 2
    profiles = language.learn(whole.where(~unseen))
    least = language.cutoffs(spark, profiles, whole.where(unseen))
    judged = {i: profiles.judge(d["text"]) for i, d in docs.items()}
    left = {i: docs[i] for i, (lang, score) in judged.items() if lang != "und" and score > 0 and score >= least.get(lang, 0.0)}
    table = spark.createDataFrame(list(left.values()), spark.read.parquet(f"{SF}/documents.parquet").schema)
    model = cotraining.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    trigrams = cotraining.Trigrams()
    for i in list(left):
        d = left[i]
        raw = model.text.raw(trigrams(d["text"])), model.meta.raw(cotraining.meta_features(d["source"], d["lang"], d["n_chars"]))
        if model.scores(*(np.array([x]) for x in raw))[0][0] < corpus_pipeline.ACCEPT:
            del left[i]
    first = {}
    for i in sorted(left):
        first.setdefault(helpers.normalised(left[i]["text"]), i)
    left = {i: left[i] for i in first.values()}
    ids = sorted(left)
    kept = {i for i, low in alike([(i, left[i]["text"]) for i in ids]) if i == low}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == kept
    packed(got, {i: left[i]["text"] for i in kept}, library)


def test_pipeline_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Every stage takes nulls, empty and long texts, repeats, clashing columns and empty tables, and keeps the columns."""
    spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns and after.count() <= docs.count()
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count() - 0
