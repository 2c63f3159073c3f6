import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import ranking
from barloom.models import calibration
from barloom.operators import bootstrap, metrics, policy


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("hot", 3000), ("cold", 60)):
        p = np.round(rng.random(n), 2)  # many ties
        if key == "hot":
            p[: n // 3] = 0.5  # one value holds a third
        y = (rng.random(n) < 0.3 + 0.4 * p).astype(int)
        rows += [(key, i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame(rows, "k string, seq bigint, p double, y int").cache()


def by_key(scored):
    pdf = scored.toPandas()
    return {k: g.sort_values(["p", "seq"]) for k, g in pdf.groupby("k")}


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_auc_against_all_pairs(scored):
    want = {k: brute_auc(g.p.to_numpy(), g.y.to_numpy()) for k, g in by_key(scored).items()}
    for got in (ranking.auc(scored, ["k"], "p", "y"), metrics.auc_of_levels(metrics.levels(scored, ["k"]), ["k"])):
        for r in got.collect():
            assert r["auc"] == pytest.approx(want[r["k"]], abs=1e-12)


def test_auc_needs_two_classes(spark):
    one = spark.createDataFrame([("a", 0.2, 1), ("a", 0.4, 1)], "k string, p double, y int")
    assert ranking.auc(one, ["k"], "p", "y").first()["auc"] is None


def test_quantiles_against_numpy(scored):
    probs = {"a": 0.05, "b": 0.5, "c": 0.731, "d": 1.0}
    groups = by_key(scored)
    for r in ranking.quantiles(scored, ["k"], "p", probs).collect():
        want = np.quantile(groups[r["k"]].p, list(probs.values()))
        assert [r[n] for n in probs] == pytest.approx(list(want))
    whole = ranking.quantiles(scored, [], "p", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median(scored.toPandas().p))


def pava(p, y):
    """Plain sequential pooling, kept simple on purpose."""
    x, w, s = [], [], []
    for a, b in zip(p, y):
        x.append(float(a)), w.append(1.0), s.append(float(b))
        while len(x) > 1 and s[-1] / w[-1] < s[-2] / w[-2]:
            tw = w[-2] + w[-1]
            x[-2:] = [(x[-2] * w[-2] + x[-1] * w[-1]) / tw]
            s[-2:] = [s[-2] + s[-1]]
            w[-2:] = [tw]
    return np.array(x), np.array(s) / np.array(w)


@pytest.mark.parametrize("parts", [1, 7])
def test_isotonic_equals_one_pass(spark, scored, parts):
    # Distinct probabilities but for the hot 0.5: means of blocks then never fall on one.
    rng = np.random.default_rng(8)
    pdf = scored.toPandas()
    pdf["p"] = np.where(pdf.p == 0.5, 0.5, rng.random(len(pdf)))
    scored = spark.createDataFrame(pdf, scored.schema)
    steps = calibration.fit_isotonic(scored, ["k"], seq="seq", parts=parts)
    got = calibration.apply_isotonic(scored, steps, ["k"]).toPandas()
    for k, g in by_key(scored).items():
        x, v = pava(g.p, g.y)
        mine = got[got.k == k].sort_values(["p", "seq"])
        at = np.clip(np.searchsorted(x, mine.p.to_numpy(), side="right") - 1, 0, len(v) - 1)
        np.testing.assert_allclose(mine.isotonic.to_numpy(), v[at], atol=1e-12)


def test_isotonic_knots(spark):
    rows = spark.createDataFrame([("a", i, p, y) for i, (p, y) in enumerate([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)])], "k string, seq bigint, p double, y int")
    steps = sorted((r["from_p"], r["value"]) for r in calibration.fit_isotonic(rows, ["k"]).collect())
    assert steps == [pytest.approx((0.1, 0.0)), pytest.approx((0.25, 0.5)), pytest.approx((0.4, 1.0))]


def test_platt_against_gradient(scored):
    for r in calibration.fit_platt(scored, ["k"]).collect():
        g = by_key(scored)[r["k"]]
        p = np.clip(g.p.to_numpy(), 1e-7, 1 - 1e-7)
        z = np.log(p / (1 - p))
        mu = 1 / (1 + np.exp(-(r["a"] * z + r["b"])))
        # At the optimum the score equations vanish.
        assert abs(np.mean(g.y - mu)) < 1e-6 and abs(np.mean((g.y - mu) * z)) < 1e-5


def test_conformal_quantiles(scored):
    groups = by_key(scored)
    for r in policy.class_quantiles(scored, ["k"]).collect():
        g = groups[r["k"]]
        for cls, name in ((0, "q0"), (1, "q1")):
            s = g.p[g.y == 0] if cls == 0 else 1 - g.p[g.y == 1]
            q = min(1.0, np.ceil((len(s) + 1) * 0.9) / len(s))
            assert r[name] == pytest.approx(np.quantile(s, q, method="higher"))


def test_conformal_withheld_on_small_sample(scored):
    small = scored.where("k = 'cold' AND seq < 20")
    r = policy.conformal_band(small, ["k"]).first()
    assert r["half_width"] is None and r["status"] == "insufficient_sample"


def test_scorecard_counts(scored):
    groups = by_key(scored)
    for r in metrics.scorecard(scored, ["k"]).collect():
        g = groups[r["k"]]
        assert r["n"] == len(g)
        assert r["accuracy"] == pytest.approx(((g.p >= 0.5) == (g.y == 1)).mean())
        loss = (g.p - g.y) ** 2
        assert r["brier"] == pytest.approx(loss.mean())
        assert r["brier_se"] == pytest.approx(loss.std(ddof=1) / np.sqrt(len(g)))
        assert r["distinct_levels"] == g.p.nunique()
        edges = np.linspace(0, 1, 11)
        ece = 0.0
        for lo, hi in zip(edges[:-1], edges[1:]):
            m = (g.p >= lo) & ((g.p <= hi) if hi == 1 else (g.p < hi))
            if m.any():
                ece += m.mean() * abs(g.p[m].mean() - g.y[m].mean())
        assert r["ece"] == pytest.approx(ece)


def test_threshold_search_against_loop(scored):
    pdf = scored.toPandas()
    got = {r["k"]: r for r in policy.best_thresholds(scored, ["k"]).collect()}
    for k, g in pdf.groupby("k"):
        best = None
        for level in policy.GRID:
            long = g[(g.p >= level) & ((g.p - 0.5).abs() * 2 >= 0.08)]
            if len(long) >= 50:
                score = (round(long.y.mean(), 4), len(long))
                if best is None or score > best[0]:
                    best = (score, level)
        if best is None:
            assert k not in got
        else:
            assert got[k]["buy"] == best[1] and got[k]["n_long"] == best[0][1]


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1.0, 2.0, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, v double")
    r = bootstrap.mean_interval(df, "v", "id").first()
    assert r["mean"] == pytest.approx(x.mean())
    assert r["se"] == pytest.approx(x.std(ddof=1) / np.sqrt(300), rel=0.15)
    assert r["ci_lower"] < r["mean"] < r["ci_upper"]
    assert r["ci_upper"] - r["ci_lower"] == pytest.approx(3.92 * r["se"], rel=0.15)


def test_random_acceptance_keeps_coverage(scored):
    cover = scored.select("k").distinct().withColumn("coverage", F.lit(0.4))
    rows = policy.null_controls(scored, cover, "k", "seq").where("k = 'hot'").collect()
    share = {r["control"]: r["coverage"] for r in rows}
    assert share["always_accept"] == 1 and share["always_abstain"] == 0
    assert share["random_accept"] == pytest.approx(0.4, abs=0.05)


def test_bootstrap_of_equal_rows(spark):
    """Units with equal values draw apart: five distinct values have the error of 500 units."""
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(500)], "id int, v double")
    r = bootstrap.mean_interval(df, "v", "id").first()
    assert r["se"] == pytest.approx(np.sqrt(2.0 / 500), rel=0.15)


def test_paired_interval_resamples_units_that_have_both(spark):
    """Replicates from the same draws by numpy."""
    import hashlib

    rng = np.random.default_rng(4)
    rows = [(f"u{i}", float(rng.normal()), float(rng.normal()) if i % 5 else None) for i in range(40)]
    got = bootstrap.paired_interval(spark.createDataFrame(rows, "u string, a double, b double"), "a", "b", "u", 300, 7).first()
    both = [(u, a - b) for u, a, b in rows if b is not None]
    draw = lambda u, b: int(hashlib.md5(f"7:{b}:{u}".encode()).hexdigest()[:13], 16) / 2**52
    w = np.array([[sum(draw(u, b) > x for x in bootstrap.POISSON) for b in range(1, 301)] for u, _ in both])
    m = (np.array([d for _, d in both]) @ w) / w.sum(axis=0)
    want = (len(both), np.mean([d for _, d in both]), *np.quantile(m, [0.025, 0.975]), m.std(ddof=1))
    assert np.allclose([got["n_units"], got["mean"], got["ci_lower"], got["ci_upper"], got["se"]], want)


def test_entropy_validation_gates(spark):
    """An uplift under 0.02 rejects, one above is evidence still insufficient, no rows at all too."""
    kind = "policy string, symbol string, p double, y int, accepted boolean"
    rows = [("candidate_a_entropy", f"s{i % 4}", 0.9 if i % 2 else 0.55, 1 if i % 2 or i % 4 else 0, bool(i % 2)) for i in range(80)]
    good = bootstrap.entropy_validation(spark.createDataFrame(rows, kind), "symbol", rounds=50).first()
    assert good["classification"] == "EVIDENCE STILL INSUFFICIENT" and good["coverage"] == 0.5 and good["accuracy_uplift"] > 0.2
    assert good["n_symbols"] == 2 and good["delta"] == 0.0  # a symbol without an accepted row has no pair
    flat = spark.createDataFrame([(a, b, p, 1, True) for a, b, p, _, _ in rows], kind)
    assert bootstrap.entropy_validation(flat, "symbol", rounds=50).first()["classification"] == "REJECTED"
    assert bootstrap.entropy_validation(flat.where("false"), "symbol", rounds=50).first()["classification"] == "EVIDENCE STILL INSUFFICIENT"


def test_values_close_together_spread_over_buckets(spark):
    """A third of the rows within 1e-4 of each other, on one key: no bucket holds more than a few of the levels."""
    df = spark.range(30_000).selectExpr("0 as k", "case when id % 3 = 0 then 0.5 + id * 3e-9 else (id * 7919 % 30011) / 30011.0d end as p", "cast(id * 31 % 7 < 3 as int) as y")
    counted = df.groupBy("k", "p").agg(F.count_if(F.col("y") == 1).alias("up"), F.count_if(F.col("y") == 0).alias("down"))
    sizes = ranking.bucketed(counted, ["k"], "p").groupBy("_b").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("_b").collect()
    assert len(sizes) > 200 and max(r["n"] for r in sizes) < 3 * counted.count() / len(sizes)
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    local = df.toPandas()
    rank = local.p.rank().to_numpy()
    n1 = local.y.sum()
    want = (rank[local.y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(local) - n1))
    assert abs(ranking.auc(df, ["k"], "p", "y").first()["auc"] - want) < 1e-12


def test_no_row_moves_to_its_key(spark):
    """Splitters come to the rows: a key with most rows stays spread; rows of unknown keys go, and ranks stay exact."""
    rows = [("a", float(i * i % 7919)) for i in range(3000)] + [("b", float(i)) for i in range(10)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    cut = ranking.bucketed(df, ["k"], "v", 16)
    assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert cut.where("k is null").isEmpty() and cut.count() == 3010
    most = max(r["count"] for r in cut.groupBy("k", "_b").count().collect())
    assert most < 2 * 3010 / 16
    got = {r["k"]: r["m"] for r in ranking.median(df, ["k"], "v", "m").collect()}
    assert got == {k: statistics.median(v for x, v in rows if x == k) for k in ("a", "b")}
