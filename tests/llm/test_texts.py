import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import cotraining, language, merkle, pitman_yor, sharding
from barloom.llm.common import remainder
from tests.llm import helpers
from tests.llm.conftest import ODD

SAMPLES = {
    "en": "the quick brown fox and the lazy dog were with them in that house when they saw what this was",
    "de": "der schnelle braune fuchs und der faule hund waren mit ihnen in diesem haus als sie sahen was das ist",
    "fr": "le renard brun rapide et le chien paresseux avec eux dans cette maison quand ils virent ce que est",
}


def test_languages(spark, odd, none):
    rows = []
    for k, (lang, text) in enumerate(SAMPLES.items()):
        w = text.split()
        rows += [(k * 100 + i, " ".join(w[(i * 7 + j * 3) % len(w)] for j in range(12)), lang) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs.where(remainder("doc_id", 4) != 2))
    got = docs.select("lang", language.identify(spark, model, F.col("text")).alias("j")).collect()
    assert all(r["lang"] == r["j"]["lang"] and 0 < r["j"]["score"] <= 1 for r in got)
    got = {r["text"]: r["j"] for r in odd.select("text", language.identify(spark, model, F.col("text")).alias("j")).collect()}
    for text, judged in got.items():
        assert (judged["lang"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= judged["score"] <= 1
    empty = language.learn(none)
    assert odd.select(language.identify(spark, empty, F.col("text")).alias("j")).where("j.lang <> 'und'").count() == 0


def test_pipeline_drops_texts_of_no_known_language(spark):
    """Scripts no profile has and noise of letters go; clean texts, short ones too, stay."""
    rng = np.random.default_rng(12)
    rows = []
    for k, (lang, text) in enumerate(SAMPLES.items()):
        w = text.split()
        rows += [(k * 100 + i, " ".join(w[(i * 7 + j * 3) % len(w)] for j in range(3 if i == 0 else 12)), lang) for i in range(40)]
    noise = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(200))
    bad = [(1000, "\u039a\u03b1\u03bb\u03b7\u03bc\u03ad\u03c1\u03b1 \u03ba\u03cc\u03c3\u03bc\u03b5", None), (1001, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0", None), (1002, noise, None), (1003, "12 34", None)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {r[0] for r in rows}


def test_pipeline_learns_languages_from_all_rows(spark, monkeypatch):
    """Profiles and cutoffs of more rows than a sample would take equal plain counts and the plain order statistic."""
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 4)), "x") for i in range(18_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    for name in ("learn", "cutoffs"):
        monkeypatch.setattr(language, name, lambda *a, f=getattr(language, name), k=name, **b: seen.setdefault(k, f(*a, **b)))
    corpus_pipeline.identify_language(spark, docs, "")
    unseen = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]
    c = Counter(k for (_, t, _), u in zip(rows, unseen, strict=True) if not u for k in language.grams(t).view(np.int64).tolist())
    want = [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.TOP]]
    found = seen["learn"]
    assert np.array_equal(np.sort(found.keys), np.sort(want))
    assert [int(found.ranks[np.searchsorted(found.keys, k), 0]) for k in want] == list(range(len(want)))
    scores = sorted(found.judge(t)[1] for (_, t, _), u in zip(rows, unseen, strict=True) if u)
    assert len(scores) > 4200 and seen["cutoffs"] == {"x": scores[math.ceil(len(scores) * 0.05) - 1] / 2}


def test_profile_distance_by_hand():
    own = language.ranked("aab", (1,), 5).tolist()
    assert len(own) == 2 and own[0] == language.ranked("a", (1,), 5)[0]
    model = language.Profiles({"x": own, "y": own[::-1]}, (1,), 5)
    assert model.judge("aab") == ("x", 1.0)
    assert model.judge("abb")[0] == "y"
    assert model.judge("b c")[1] == 1 - (0 + 5) / 10


def test_profiles_equal_plain_counts(spark):
    docs = spark.createDataFrame([(i, f"{'ab' * (i % 5)} ba {'c' * (i % 3)}", "x") for i in range(50)], "doc_id long, text string, lang string")
    found = language.learn(docs, per_language=10**9, top=7)
    c = Counter(k for r in docs.collect() for k in language.grams(r["text"]).view(np.int64).tolist())
    want = [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:7]]
    assert np.array_equal(np.sort(found.keys), np.sort(want))
    assert [int(found.ranks[np.searchsorted(found.keys, k), 0]) for k in want] == list(range(7))


def test_merkle(odd, none):
    rows = sorted(((-math.inf if i is None else i), t or "") for i, t in ODD)
    got = merkle.fingerprints(odd).collect()
    want = Counter()
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        text = t[: len(t) - n] + following[:n]
        want[None if i == -math.inf else i, len(t), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {r["fingerprint"] for r in got}
    assert len(prints) == len({t for _, t in rows})
    assert merkle.fingerprints(none).count() == 0


def test_merkle_order_over_buckets(spark):
    docs = spark.createDataFrame([(i * i, f"text number {i} " * 5) for i in range(200)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(docs, per_bucket=9).collect()}
    assert got == {i * i: f"text number {(i + 1) % 200} " * 5 for i in range(200)}
    one = merkle.fingerprints(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


def test_merkle_locates_edits(spark):
    lines = [f"Paragraph {i} says something of its own." for i in range(160)]
    after = [*lines]
    after[20] = "Paragraph 20 was changed."
    df = spark.createDataFrame([("\n".join(lines), "\n".join(after))], "a string, b string")
    a, b = merkle.tree(F.col("a")), merkle.tree(F.col("b"))
    r = df.select(merkle.differing(a, b).alias("d"), a.alias("t"), merkle.likeness(merkle.spans(F.col("a")), merkle.spans(F.col("b")), F.lit(False)).alias("near")).first()
    assert r["d"]["paragraphs"] == [hashlib.sha256((lines[20] + "\n").encode()).hexdigest()]
    assert len(r["d"]["sections"]) <= 2 < len(r["t"]["sections"]) and r["near"] > 0.9


def test_spans_cover_texts(spark):
    texts = [t for _, t in ODD if t] + ["a.b, c. d\n\ne!  f? " * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.regexp_extract_all("t", F.lit(merkle.SPANS), F.lit(0)).alias("s")).collect():
        assert "".join(r["s"]) == r["t"] and max(map(len, r["s"])) <= merkle.SPAN


def test_sharding(odd, none):
    got = sharding.assign(odd, [1.0] * 6, [1.0] * 7, per_task=1).collect()
    assert len(got) == len(ODD)
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 6) for r in got)
    assert sharding.assign(none, [1.0, 2.0]).count() == 0


def test_shares_follow_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r["shard"] for r in sharding.assign(docs, [1.0, 2.0, 3.0]).collect())
    assert all(abs(n[k] - 1000 * (k + 1)) < 150 for k in range(3))


def base(rows, held):
    c = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            c.update([*helpers.words(t), None])
    n, v = sum(c.values()), len(c)
    return [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*helpers.words(t), None]) for _, t in rows], c


def test_pitman_yor_counts_and_base(odd, none):
    rows = [(r["doc_id"], r["text"], r["h"]) for r in odd.select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("h")).collect()]
    want, c = base([r[:2] for r in rows], [r[2] for r in rows])
    got = pitman_yor.score(odd, remainder("doc_id", 7) == 2, dictionary=4).collect()

    def key(i, h, n, known, b):
        return (i is None, i or 0, h, n, known, round(b, 5))

    mine = sorted(key(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    theirs = sorted(key(i, h, len(helpers.words(t)) + 1, sum(c[w] > 0 for w in [*helpers.words(t), None]), b) for (i, t, h), b in zip(rows, want, strict=True))
    assert mine == theirs and {r["train_tokens"] for r in got} == {sum(c.values())}
    assert all(r["score"] < 0 for r in got)
    assert pitman_yor.score(none, remainder("doc_id", 7) == 2).count() == 0
    assert pitman_yor.score(odd, F.lit(True)).where("n_known = 0 and train_tokens = 0").count() == len(ODD)


def test_pitman_yor_chances_sum_to_one(spark):
    """One-word texts give P(w|begin) P(end|w); two-word texts give P(w|v). Over all words and one unknown they sum to 1."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(12)]
    corpus = [" ".join(rng.choice(vocabulary, 30, p=np.arange(1, 13) / 78)) for _ in range(40)]
    asked = [f"w3 {w}" for w in [*vocabulary, "unseen"]] + ["w3"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)] + [(1000 + i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    for dictionary in (60_000, 4, 0):
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("doc_id") >= 1000, dictionary=dictionary).collect()}
        ends = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)] + [(1000, "w3"), (1001, "w3 w3"), (1002, "w3 w3 w3")], "doc_id long, text string")
        more = {r["doc_id"]: r["score"] for r in pitman_yor.score(ends, F.col("doc_id") >= 1000, dictionary=dictionary).collect()}
        assert all(math.isfinite(x) for x in [*got.values(), *more.values()])
        step = 10 ** (more[1001] - more[1000])
        assert abs(10 ** (more[1002] - more[1001]) / step - 1) < 1e-6 and 0 < step < 1


def test_pitman_yor_predicts_better_than_base(spark):
    rng = np.random.default_rng(7)
    follow = {k: rng.choice(50, 3) for k in range(50)}
    rows = []
    for i in range(400):
        w = [int(rng.integers(50))]
        for _ in range(40):
            w.append(int(rng.choice(follow[w[-1]])))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), remainder("doc_id", 7) == 2).where("held_out").collect()
    per_token = sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert 10**-per_token < 5 < 25 < 10 ** (-sum(r["base_score"] for r in got) / sum(r["n_tokens"] for r in got))


def test_model_is_a_distribution():
    """Predictions of one restaurant over all dishes and the unknown word sum to one."""
    words = pitman_yor.Dictionary(np.arange(1, 6, dtype=np.uint64) * np.uint64(7919), np.array([9, 7, 5, 3, 1]), 25, 5)
    model = pitman_yor.Model(words)
    context = np.zeros(5, np.uint16)
    pairs = np.arange(5, dtype=np.uint32) << np.uint32(16)
    empty = pitman_yor._nothing()
    blob = pitman_yor.pack(pairs, np.array([9, 7, 5, 3, 1], np.int64), empty[3], empty[4], np.empty(0, np.int64))
    types = pitman_yor.Types(blob)
    model.customers[0] = 25
    tables = np.array([3, 2, 2, 1, 1])
    model.add(types.totals(model, tables, 0), 0)
    types.rare_key, types.rare_order, types.dish_customers = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)
    data = [pairs, np.zeros(5, np.uint16), np.ones(5, np.uint32), np.array([3], np.uint64), np.zeros(1, np.uint16), np.zeros(1, np.uint16), np.ones(1, np.uint32)]
    logs, _, _ = pitman_yor.predict(model, types, [(tables, types.chance(model, 0, tables)[1])], data)
    assert len(context) == 5 and abs((10**logs).sum() - 1) < 1e-9


def test_tables_of_many_customers_are_drawn_from_their_distribution():
    """All customers of large dishes move: quantiles equal those of the exact distribution, by the recursion over customers."""
    for d, customers, weight, more in ((0.75, 700, 0.8, 0.0), (0.5, 900, 20.0, 0.05), (0.75, 600, 1e6, 0.1)):
        ways = np.full(customers + 1, -np.inf)
        ways[1] = 0
        t = np.arange(1, customers + 1)
        for c in range(1, customers):
            ways = np.concatenate(([-np.inf], np.logaddexp(ways[:-1], ways[1:] + np.log(np.maximum(c - d * t, 1e-300)))))
        assert np.abs(pitman_yor.log_ways(customers, t, d) - ways[1:]).max() < 1e-3
        odds = ways[1:] + np.cumsum(np.log(weight + more * (t - 1)))
        odds = np.cumsum(np.exp(odds - odds.max()))
        u = np.linspace(0.0005, 0.9995, 300)
        same = [np.full(300, x) for x in (customers, weight, more)]
        got = pitman_yor.draw_tables(*same, d, u)
        assert np.abs(got - 1 - np.searchsorted(odds, u * odds[-1])).max() <= 1
    huge = pitman_yor.draw_tables(np.full(50, 3_000_000), np.full(50, 900.0), np.full(50, 0.01), 0.75, np.linspace(0.01, 0.99, 50))
    assert (np.diff(huge) >= 0).all() and 1 < huge[0] < huge[-1] < 3_000_000


def test_every_word_has_a_restaurant_of_its_own(spark):
    """Where every pair occurs once only the parent's tables are drawn, by the words, so a dictionary of any size scores alike."""
    rng = np.random.default_rng(83)
    left, walk = {(i, j) for i in range(30) for j in range(30)}, [0]
    while after := sorted(j for i, j in left if i == walk[-1]):
        walk.append(int(rng.choice(after)))
        left.remove((walk[-2], walk[-1]))
    asked = [" ".join(f"x{k}ed" for k in rng.integers(0, 33, 12)) for _ in range(40)]
    rows = [(0, " ".join(f"x{k}ed" for k in walk))] + [(1000 + i, t) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, got = ({r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("doc_id") >= 1000, dictionary=n, burn=0, kept=2).collect()} for n in (60_000, 0))
    assert len(walk) > 500 and set(want) == set(got) and all(math.isclose(want[i], got[i], rel_tol=1e-9) for i in want)


def test_totals_of_rare_restaurants(spark):
    """Customers and tables of every restaurant are those of its pairs, wherever these are seated."""
    rng = np.random.default_rng(84)
    rows = [(i, " ".join(f"v{k}" for k in rng.geometric(0.04, 60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = Counter()
    for _, text in rows:
        w = text.split()
        count.update(zip(w, [*w[1:], None], strict=True))
    words = pitman_yor.learn_words(docs, 20)
    model, types, rooms, samples, _ = pitman_yor.fit(docs, words, burn=1, kept=2)
    tables = types.join(rooms, "bucket", "left")
    for s, (seating, answers) in enumerate(samples):
        tables = tables.join(seating.select("bucket", F.col("seated").alias(f"s{s}")), "bucket")
        tables = tables.join(answers.select("bucket", F.col("answer").alias(f"a{s}")), "bucket", "left")
    rare, total, listed = {}, Counter(), [Counter(), Counter()]
    for r in tables.collect():
        t = pitman_yor.Types(r["types"])
        kept = [t.tables(pitman_yor._each(r[f"s{s}"])) for s in range(2)]
        home = pitman_yor.Home.of(t, pitman_yor.Rooms(r["rooms"]), kept, [pitman_yor._answer(r[f"a{s}"]) for s in range(2)])
        rare |= {w: (n, a, b) for w, n, a, b in zip(home.words.tolist(), home.customers, *home.tables, strict=True)}
        names = np.concatenate((np.arange(pitman_yor.CONTEXTS, dtype=np.uint64), t.rare))[t.context].tolist()
        for w, n, a, b in zip(names, t.customers, *kept, strict=True):
            total[w] += n
            listed[0][w] += a
            listed[1][w] += b
    far = [w for w in total if w >= pitman_yor.FIRST]
    assert far and {w: rare[w] for w in far} == {w: (total[w], listed[0][w], listed[1][w]) for w in far}
    by_word = Counter()
    for (v, _), n in count.items():
        by_word[int(pitman_yor.hashes(v.encode())[1][0])] += n
    known = set(words.words.tolist())
    assert {w: n for w, n in by_word.items() if w not in known} == {w: total[w] for w in far}
    near = [w for w in total if w < pitman_yor.FIRST]
    assert all(model.customers[int(w)] == total[w] and model.tables[0][int(w)] == listed[0][w] for w in near)


def test_gibbs_matches_exact_posterior():
    """Tables of one dish with three customers: visits equal the exact posterior over partitions."""
    d, weight = 0.5, 0.8
    chance = {1: (1 - d) * (2 - d), 2: 3 * weight * (1 - d), 3: weight * weight}
    total = sum(chance.values())
    rng = np.random.default_rng(8)
    n = 4000
    seats = pitman_yor.Seating(np.full(n, 3), np.ones(n))
    for _ in range(12):
        seats.sweep(np.full(n, 3), np.full(n, weight), d, rng, np.zeros(n))
    seen = Counter(seats.tables.tolist())
    assert all(abs(seen[t] / n - chance[t] / total) < 0.03 for t in (1, 2, 3))


def test_tables_are_drawn_as_customers_move_one_by_one():
    """Tables drawn for whole dishes follow the posterior, and many moves of single customers end in the same."""
    d, weight, n = 0.5, 0.8, 20_000
    rng = np.random.default_rng(81)
    chance = {1: (1 - d) * (2 - d), 2: 3 * weight * (1 - d), 3: weight * weight}
    seen = Counter(pitman_yor.draw_tables(np.full(n, 3), np.full(n, weight), np.zeros(n), d, rng.random(n)).tolist())
    assert all(abs(seen[t] / n - chance[t] / sum(chance.values())) < 0.015 for t in chance)
    many, n = 30, 2000
    seats = pitman_yor.Seating(np.full(n, many), np.ones(n))
    for _ in range(15):
        seats.sweep(np.full(n, many), np.full(n, 5.0), 0.75, rng, np.zeros(n))
    drawn = pitman_yor.draw_tables(np.full(n, many), np.full(n, 5.0), np.zeros(n), 0.75, rng.random(n))
    assert abs(drawn.mean() - seats.tables.mean()) < 0.35 and abs(drawn.std() - seats.tables.std()) < 0.3
    parent = pitman_yor.parent_tables(rng.integers(1, 1 << 62, n, dtype=np.uint64), np.full(n, 3.0), 0, weight, d)
    assert all(abs((parent == t).mean() - chance[t] / sum(chance.values())) < 0.05 for t in chance)


def test_first_seating_seats_customers_one_by_one():
    """Numbers and sizes of tables vary as they do when each customer chooses in turn, not at their mean."""
    d, weight, customers, n = 0.5, 0.8, 40, 3000
    rng = np.random.default_rng(82)
    got = pitman_yor.first_seating(np.full(n, customers), np.full(n, weight), d, rng)
    rows = np.split(got.sizes, np.cumsum(got.tables)[:-1])
    assert all(x.sum() == customers and x.min() > 0 for x in rows)
    slow = np.zeros((n, customers))
    slow[:, 0] = 1
    for _ in range(1, customers):
        odds = np.cumsum(np.where(slow > 0, slow - d, 0), axis=1)
        pick = rng.random(n) * (weight + odds[:, -1])
        old = np.minimum((odds <= pick[:, None]).sum(axis=1), customers - 1)
        slow[np.arange(n), np.where(pick < odds[:, -1], old, (slow > 0).sum(axis=1))] += 1
    want = (slow > 0).sum(axis=1)
    assert abs(got.tables.mean() - want.mean()) < 0.2 and abs(got.tables.std() - want.std()) < 0.15
    assert abs(np.mean([x.max() for x in rows]) - slow.max(axis=1).mean()) < 0.8
    far = pitman_yor.parent_tables(rng.integers(1, 1 << 62, 500, dtype=np.uint64), np.full(500, 5000.0), 0, weight, d)
    assert far.std() > 0.3 and far.min() >= 1


def test_word_hashes_do_not_depend_on_pieces():
    rng = np.random.default_rng(9)
    text = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(1, 12))) for _ in range(2000)).encode()
    whole = pitman_yor.hashes(text)[1].tolist()
    step = pitman_yor.STEP
    try:
        pitman_yor.STEP = 100
        assert pitman_yor.hashes(text)[1].tolist() == whole
    finally:
        pitman_yor.STEP = step
    assert len(set(whole)) == len(set(text.split()))


def test_quality(spark, odd, none):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 != 0
        word = ["plain", "words", "about", "things"] if good else ["BUY!!", "$$$", "WIN***", "NOW%%%"]
        rows.append((i, " ".join(rng.choice(word, 30)), "en", f"s{int(rng.integers(3))}", 150))
        if i % 2:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = cotraining.train(docs, known)
    got = docs.select("doc_id", cotraining.quality(spark, model, docs).alias("q")).collect()
    assert all((r["q"]["score"] > 0.5) == (r["doc_id"] % 3 != 0) for r in got)
    assert odd.select(cotraining.quality(spark, model, odd).alias("q")).where("q.score between 0 and 1").count() == len(ODD)
    blank = cotraining.train(odd, known.where("false"))
    assert len({round(r["q"]["score"], 9) for r in odd.select(cotraining.quality(spark, blank, odd).alias("q")).collect()}) == 1
    cotraining.train(none, known)


def test_views_exchange_labels(spark):
    """Pseudo-labels of the text view teach the metadata view what no label says."""
    rows = [(i, ("plain words here " if i % 2 else "JUNK$$$ BUY!!! ") * 5, "en", ("a" if i % 2 else "b") if i >= 60 else "c", 75) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = docs.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    weight = [cotraining.train(docs, known, rounds=r).meta.weights for r in (0, 1)]
    a, b = (cotraining.meta_features(x, "en", 75)[0] for x in "ab")
    assert weight[0][a] == weight[0][b] == 0 and weight[1][a] > 1 > -1 > weight[1][b]


def test_logistic_is_stationary():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + rng.normal(size=500) > 0).astype(float)
    w = cotraining.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    assert np.abs(x.T @ (p - y) + 1e-2 * w[:2]).max() < 1e-4
    assert isinstance(pd.DataFrame(), pd.DataFrame)
