"""Wide linear models and tree ensembles against plain Python and numpy."""

import datetime as dt

import numpy as np
import pytest

from barloom.models import grouped, trees, wide
from barloom.operators import splits
from barloom.operators.splits import assign

COLUMNS = ["fa", "fb", "fc", "fd"]


@pytest.fixture(scope="module")
def panel(spark):
    """Two symbols, one with three quarters of the rows; unknown values, a constant and a column of one symbol only."""
    rng = np.random.default_rng(11)
    rows = []
    for symbol, n in (("A", 160), ("B", 120)):
        for i in range(n):
            x = rng.normal(size=3)
            y = int(x[0] + 0.5 * x[1] + rng.normal() > 0)
            rows.append((symbol, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x[0]), None if i % 7 == 0 else float(1000 + x[1]), 5.0, float(x[2]) if symbol == "A" else None, y if i % 11 else None, float(x[0] + rng.normal())))
    return spark.createDataFrame(rows, "symbol string, date date, fa double, fb double, fc double, fd double, up int, ret double")


@pytest.fixture(scope="module")
def folds(panel):
    return splits.panel_folds(panel, 2, 2, 40)


@pytest.fixture(scope="module")
def labelled(panel):
    """The grouped models scale by all training rows, the wide ones by those with a label."""
    return panel.where("up is not null")


def table(df, *columns):
    return {tuple(r[:-1]): r[-1] for r in df.select(*columns).collect()}


@pytest.mark.parametrize("group", [[], ["symbol"]])
@pytest.mark.parametrize("block_rows", [20_000, 9])
def test_wide_ridge_equals_the_grouped_one(labelled, folds, group, block_rows, monkeypatch):
    """Any number of blocks, summed with a fan-in of three, and dates shared by folds give the same models."""
    monkeypatch.setattr(wide, "FAN_IN", 3)
    keys = [*group, "fold"]
    rows = labelled.withColumn("x", wide.vector(COLUMNS))
    stats, center = wide.moments(rows, folds, group, COLUMNS, "up", block_rows=block_rows)
    got = table(wide.score(assign(rows, folds).where("role = 'test'"), wide.solve_ridge(stats, center, keys), keys), "symbol", "date", "fold", "prob")
    want = table(grouped.out_of_fold(labelled, folds, COLUMNS, "up", group, "ridge"), "symbol", "date", "fold", "prob")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_wide_logistic_equals_the_grouped_one(labelled, folds):
    rows = labelled.withColumn("x", wide.vector(COLUMNS))
    stats, center = wide.moments(rows, folds, ["symbol"], COLUMNS, "up")
    train = assign(rows, folds).where("role = 'train' and up is not null").selectExpr("symbol", "fold", "x", "cast(up as double) _y", "date")
    train = wide.blocked(train, ["symbol", "fold"], ["date"], 25)
    weights = wide.fit_logistic(train, stats, center, ["symbol", "fold"], 1.0, False)
    assert {r["converged"] for r in weights.collect()} == {True}
    got = table(wide.score(assign(rows, folds).where("role = 'test'"), weights, ["symbol", "fold"], "logistic"), "symbol", "date", "fold", "prob")
    want = table(grouped.out_of_fold(labelled, folds, COLUMNS, "up", ["symbol"], "logistic"), "symbol", "date", "fold", "prob")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_signed_balanced_ridge_solves_its_weighted_equations(panel, folds):
    """Numpy's least squares on rows weighted by class gives the same score."""
    rows = panel.withColumn("x", wide.vector(COLUMNS))
    got = table(wide.out_of_fold(panel, folds, COLUMNS, "up", [], "signed"), "symbol", "date", "fold", "prob")
    local = assign(rows, folds).toPandas()
    for fold, part in local.groupby("fold"):
        train, test = part[(part.role == "train") & part.up.notna()], part[part.role == "test"]
        x = np.array([[np.nan if v is None else v for v in r] for r in train.x], float)
        y = np.where(train.up == 1, 1.0, -1.0)
        mean, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
        to = lambda m: np.nan_to_num((m - mean) / np.where(scale > 0, scale, np.inf))
        w = len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == -1).sum()))
        z = np.column_stack((np.ones(len(x)), to(x)))
        c = np.linalg.solve((z * w[:, None]).T @ z + np.diag([0] + [1.0] * 4) + 1e-12 * np.eye(5), (z * w[:, None]).T @ y)
        t = np.array([[np.nan if v is None else v for v in r] for r in test.x], float)
        p = 1 / (1 + np.exp(-(np.column_stack((np.ones(len(t)), to(t))) @ c)))
        assert all(abs(got[s, d, fold] - v) < 1e-8 for s, d, v in zip(test.symbol, test.date, p, strict=True))


# ---- trees


def gini_tree(bins, y, w, times, least, depth, width, seed, tree, node=1, level=0):
    """A tree by recursion over lists of rows: (feature, bin, left, right) or a rate."""
    w = w * times

    def rate(rows):
        a, b = w[rows][y[rows] == 0].sum(), w[rows][y[rows] == 1].sum()
        return b / (a + b) if a + b else 0.5

    def pure(rows):
        a, b = w[rows][y[rows] == 0].sum(), w[rows][y[rows] == 1].sum()
        return (a * a + b * b) / (a + b) if a + b else 0.0

    rows = np.arange(len(y))
    best = None
    if level < depth:
        for f in trees.chosen(width, seed, tree, node):
            for cut in range(trees.BINS - 1):
                left, right = rows[bins[:, f] <= cut], rows[bins[:, f] > cut]
                if min(times[left].sum(), times[right].sum()) < least:
                    continue
                gain = round(pure(left) + pure(right) - pure(rows), 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, int(f), cut, left, right)
    if best is None:
        return rate(rows)
    _, f, cut, left, right = best
    sides = [gini_tree(bins[r], y[r], (w / np.maximum(times, 1))[r], times[r], least, depth, width, seed, tree, 2 * node + k, level + 1) for k, r in enumerate((left, right))]
    return (f, cut, *sides)


def walk(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


@pytest.mark.parametrize("block_rows", [20_000, 13])
def test_forest_equals_recursion(panel, folds, block_rows):
    size = trees.Forest(trees=3, depth=4, least=5)
    rows = trees.prepare(panel, folds, ["symbol"], COLUMNS, "up", block_rows=block_rows)
    nodes = trees.fit_forest(rows, ["symbol"], 4, (0, 3), size)
    got = table(trees.score_forest(rows, nodes, ["symbol"], 4, size.depth), "symbol", "fold", "seed", "date", "prob")
    local = rows.toPandas()
    want = {}
    for (symbol, fold), part in local.groupby(["symbol", "fold"]):
        train, test = part[part.role == "train"], part[part.role == "test"]
        bins = np.array([list(b) for b in train.bins])
        y, w = train._y.to_numpy(), np.where(train._y == 1, train._w1, train._w0)
        assert abs(w[y == 1].sum() - w[y == 0].sum()) < 1e-9
        for seed in (0, 3):
            grown = []
            for tree in range(size.trees):
                times = trees.draws(train._row.to_numpy(), seed, tree)
                use = times > 0
                grown.append(gini_tree(bins[use], y[use], w[use], times[use], size.least, size.depth, 4, seed, tree))
            for date, b in zip(test.date, test.bins, strict=True):
                want[symbol, fold, seed, date] = np.mean([walk(t, list(b)) for t in grown])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(isinstance(t, tuple) for t in grown)


def test_bins_are_quantiles_of_the_group(panel, folds):
    rows = trees.prepare(panel, folds, ["symbol"], COLUMNS, "up").toPandas()
    raw = panel.toPandas().set_index(["symbol", "date"])
    for (symbol, fold), part in rows.groupby(["symbol", "fold"]):
        x = np.array([raw.loc[(symbol, d), "fa"] for d in part.date])
        bins = np.array([b[0] for b in part.bins])
        order = np.argsort(x)
        assert (np.diff(bins[order].astype(int)) >= 0).all()
        train = part.role == "train"
        counts = np.bincount(bins[train], minlength=32)
        assert counts.max() <= 1 + train.sum() / 32 + 1
        # Unknown and constant columns have one bin.
        assert {b[2] for b in part.bins} == {0} and (symbol == "A" or {b[3] for b in part.bins} == {0})


def boosted_by_rows(bins, y, row, test, heavy, seed, size):
    """Boosting with every split tried by summing its rows."""
    score, unseen = np.zeros(len(y)), np.zeros(len(test))
    width = bins.shape[1]
    for k in range(size.rounds):
        p = 1 / (1 + np.exp(-score))
        weight = np.where(y == 1, heavy, 1.0)
        g, h = weight * (p - y), weight * p * (1 - p)
        use = trees.mixed(seed, k, row).astype(float) < size.rows * 2.0**64
        columns = np.sort(np.argsort(trees.mixed(seed, k, -1, np.arange(width)), kind="stable")[: max(1, int(size.columns * width))])

        def grow(rows, known, test_rows, level):
            value = -g[known].sum() / (h[known].sum() + size.l2)
            best = None
            fit = lambda r: g[r].sum() ** 2 / (h[r].sum() + size.l2)
            if level < size.depth and len(known) > 1:
                for f in columns:
                    for cut in range(trees.BINS - 1):
                        low, high = known[bins[known, f] <= cut], known[bins[known, f] > cut]
                        if h[low].sum() < size.child or h[high].sum() < size.child:
                            continue
                        gain = round(fit(low) + fit(high) - fit(known), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, cut)
            if best is None:
                score[rows] += size.rate * value
                unseen[test_rows] += size.rate * value
                return
            _, f, cut = best
            for right in (False, True):
                side = lambda r, t: r[(t[r, f] > cut) == right]  # noqa: E731, B023
                grow(side(rows, bins), side(known, bins), side(test_rows, test), level + 1)

        grow(np.arange(len(y)), np.flatnonzero(use), np.arange(len(test)), 0)
    return 1 / (1 + np.exp(-unseen))


def test_boosting_equals_sums_over_rows(panel, folds):
    size = trees.Boost(rounds=12, depth=3)
    rows = trees.prepare(panel, folds, ["symbol"], COLUMNS, "up")
    got = table(trees.out_of_fold_boosted(rows, ["symbol"], 4, (2,), size), "symbol", "fold", "date", "prob")
    want = {}
    for (symbol, fold), part in rows.toPandas().groupby(["symbol", "fold"]):
        part = part.sort_values("_row")
        train, test = part[part.role == "train"], part[part.role == "test"]
        bins = [np.array([list(b) for b in p.bins], int).reshape(-1, 4) for p in (train, test)]
        y = train._y.to_numpy()
        p = boosted_by_rows(bins[0], y, train._row.to_numpy(), bins[1], (len(y) - y.sum()) / y.sum(), 2, size)
        want |= {(symbol, fold, d): v for d, v in zip(test.date, p, strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_groups_of_one_class_and_without_training_rows(spark, panel, folds):
    one = panel.withColumn("up", panel["up"] * 0)
    rows = trees.prepare(one, folds, ["symbol"], COLUMNS, "up")
    assert {r["prob"] for r in trees.out_of_fold_boosted(rows, ["symbol"], 4).collect()} == {0.0}
    size = trees.Forest(trees=2, depth=2, least=2)
    nodes = trees.fit_forest(rows, ["symbol"], 4, (0,), size)
    assert {r["prob"] for r in trees.score_forest(rows, nodes, ["symbol"], 4, 2).collect()} == {0.0}
