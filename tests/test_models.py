import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.models import grouped, pooled


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    data = []
    for s in ("A", "B"):
        x = rng.normal(size=(250, 2))
        p = 1 / (1 + np.exp(-(0.4 + x @ np.array([1.0, -0.7]))))
        y = (rng.random(250) < p).astype(float)
        data += [(s, i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "symbol string, i int, a double, b double, y double").cache()


def test_ridge_equals_normal_equations(rows):
    pdf = rows.toPandas()
    for r in grouped.fit_ridge(rows, ["symbol"], ["a", "b"], "y", l2=2.0).collect():
        g = pdf[pdf.symbol == r["symbol"]]
        x = np.column_stack([np.ones(len(g)), g.a, g.b])
        want = np.linalg.solve(x.T @ x + np.diag([0, 2.0, 2.0]), x.T @ g.y)
        assert r["weights"] == pytest.approx(list(want))


def test_logistic_reaches_the_optimum(rows):
    pdf = rows.toPandas()
    for r in grouped.fit_logistic(rows, ["symbol"], ["a", "b"], "y", l2=1.0).collect():
        g = pdf[pdf.symbol == r["symbol"]]
        x = np.column_stack([np.ones(len(g)), g.a, g.b])
        b = np.array(r["weights"])
        grad = x.T @ (g.y - 1 / (1 + np.exp(-x @ b))) - np.array([0, 1.0, 1.0]) * b
        assert np.abs(grad).max() < 1e-6


def test_dropped_terms_stay_zero(rows):
    stats = grouped.gram(rows, ["symbol"], ["a", "b"], F.col("y")).withColumn("terms", F.array(F.lit(0), F.lit(2)))
    for r in grouped.solve(stats, ["symbol"], keep="terms").collect():
        assert r["weights"][1] == 0 and r["weights"][2] != 0


def test_leave_one_out_excludes_the_symbol(spark, rows):
    base = F.lit("2024-01-01").cast("date")
    panel = rows.withColumn("date", F.date_add(base, F.col("i")))
    folds = panel.select("date", "i").distinct().select(
        F.lit(0).alias("fold"), F.when(F.col("i") < 200, "train").otherwise("test").alias("role"), "date"
    )
    got = grouped.leave_one_symbol_out(panel, folds, ["a", "b"], "y").where("symbol = 'A'").toPandas()
    pdf = rows.toPandas()
    train = pdf[pdf.i < 200]
    mean, std = train[["a", "b"]].mean(), train[["a", "b"]].std(ddof=0)
    other = train[train.symbol == "B"]
    z = ((other[["a", "b"]] - mean) / std).to_numpy()
    x = np.column_stack([np.ones(len(z)), z])
    w = np.linalg.solve(x.T @ x + np.diag([0, 1.0, 1.0]), x.T @ other.y)
    test = pdf[(pdf.symbol == "A") & (pdf.i >= 200)].sort_values("i")
    want = np.clip(np.column_stack([np.ones(50), ((test[["a", "b"]] - mean) / std).to_numpy()]) @ w, 0, 1)
    assert got.sort_values("i").prob.to_numpy() == pytest.approx(want)


def test_permutation_is_a_rearrangement(rows):
    mixed = pooled.permuted(rows.select("i", "symbol", "a"), ["a"], 3)
    before = sorted(r[0] for r in rows.select("a").collect())
    after = sorted(r[0] for r in mixed.select("a__p").collect())
    assert before == after
    moved = mixed.where("a <> a__p").count()
    assert moved > 450


def test_single_class_gives_the_prior(rows):
    ones = rows.withColumn("y", F.lit(1.0))
    model, prior = pooled.fit(ones, ["a", "b"], "y", "logistic")
    assert model is None and prior == 1.0


def test_important_feature_ranks_first(rows):
    noisy = rows.withColumn("noise", F.rand(1))
    model, _ = pooled.fit(noisy, ["a", "b", "noise"], "y", "logistic")
    out = pooled.permutation_importance(model, noisy, ["a", "b", "noise"], "y", 2)
    imp = {r["feature"]: r["importance"] for r in out.collect()}
    assert imp["a"] > imp["b"] > imp["noise"]


def test_pooled_dataset_reasons(spark):
    """One bad symbol is set aside, and labels never read past the cut-off."""
    import datetime as dt

    from barloom.plans import research

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [("A", day(i), 100.0 + i) for i in range(10)]
    rows += [("B", day(0), 1.0), ("B", day(0), 2.0), ("C", day(0), 1.0), ("E", day(8), 1.0), ("F", day(1), 1.0)]
    frame = spark.createDataFrame(rows, "symbol string, date date, close double")
    universe = spark.createDataFrame(
        [
            ("A", None, None, "included", None), ("B", None, None, "included", None), ("D", None, None, "included", None),
            ("E", None, None, "included", None), ("F", None, None, "excluded", "too thin"),
        ],
        "symbol string, valid_from date, valid_to date, inclusion_status string, exclusion_reason string",
    )
    panel, skipped = research.pooled_dataset([frame], universe, 2, str(day(6)))
    got = {r["symbol"]: r["reason"] for r in skipped.collect()}
    assert got == {
        "B": "duplicate dates in feature frame",
        "C": "not in universe manifest",
        "D": "no feature frame supplied",
        "E": "no rows inside point-in-time universe window",
        "F": "too thin",
    }
    labels = {r["date"]: r["target_ret_2d"] for r in panel.collect()}
    assert len(labels) == 7 and labels[day(5)] is None and labels[day(4)] == pytest.approx(106 / 104 - 1)
