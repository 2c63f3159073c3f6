"""Forests and boosted trees of many groups at once on binned features.

Bin edges are quantiles of a group's training rows. A forest grows level by level for all groups, folds,
seeds and trees together: blocks of rows walk the trees grown so far and give histograms of weighted
class sums by (group, tree, node, feature, bin), one aggregation adds them, and every node chooses its
split from the sum. Nothing is kept between levels but the table of nodes, so a group may have any number
of rows. Boosting needs a round's scores before the next round; groups that are a symbol's calendar in a
fold are boosted where their rows are, all groups in one job.

Draws are hashes: a row's weight in a tree and a node's features depend on seed, tree, node and row alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, send_package
from .wide import _fields, added, blocked, dense, vector

BINS = 32


@dataclass(frozen=True)
class Forest:
    """Sizes of the per-fold forest."""

    trees: int = 50
    depth: int = 8
    least: int = 30


@dataclass(frozen=True)
class Boost:
    """Sizes of the per-fold boosted trees."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    child: float = 1.0


def mixed(*parts) -> np.ndarray:
    """Uniform 64-bit hash of whole numbers (scalars or arrays), by the finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = np.uint64(0)
        for p in parts:
            h = (np.asarray(p, dtype=np.int64).astype(np.uint64) ^ h) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def draws(row: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, as drawing with replacement gives in the limit."""
    return np.searchsorted(_POISSON, mixed(seed, tree, row).astype(np.float64) / 2.0**64)


def chosen(width: int, seed: int, tree: int, node: int) -> np.ndarray:
    """The square root of all features, drawn for one node."""
    return np.sort(np.argsort(mixed(seed, tree, node, np.arange(width)), kind="stable")[: max(1, int(np.sqrt(width)))])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many edges lie below it; unknown ones are in the bin of the median, the middle edge."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        own = x[:, j]
        if len(e):
            own = np.where(np.isnan(own), e[len(e) // 2], own)
            out[:, j] = np.searchsorted(e, own, side="left")
        else:
            out[:, j] = 0
    return out


def split(h: np.ndarray, least: float) -> tuple[int, int, float, np.ndarray, np.ndarray] | None:
    """Best split of a node by Gini impurity: position of the feature, last bin of the left side, gain, both sides' sums.

    ``h`` is (feature, bin, 3): class weights down and up and drawn rows. Ties go to the first feature and bin.
    """
    left = np.cumsum(h, axis=1)[:, :-1]
    total = h.sum(axis=1)[0]
    right = total - left
    ok = (left[..., 2] >= least) & (right[..., 2] >= least)
    if not ok.any() or min(total[0], total[1]) <= 0:
        return None

    def pure(s):
        w = s[..., 0] + s[..., 1]
        return (s[..., 0] ** 2 + s[..., 1] ** 2) / np.maximum(w, 1e-300)

    gain = np.where(ok, pure(left) + pure(right) - pure(total), -np.inf)
    # Sums in another order differ in their last digits; a rounded gain makes ties ties.
    gain = np.round(gain, 9)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    if gain[f, b] <= 0:
        return None
    return f, b, float(gain[f, b]), left[f, b], right[f, b]


def _rate(s: np.ndarray) -> float:
    return float(s[1] / (s[0] + s[1])) if s[0] + s[1] > 0 else 0.5


NODE = "seed int, tree int, node int, feature int, bin int, gain double, value_left double, value_right double"
_NAMES = ["seed", "tree", "node", "feature", "bin", "gain", "value_left", "value_right"]


class Walk:
    """Nodes of a group's trees by tree, and the way of binned rows through them."""

    def __init__(self, nodes: pa.Table):
        self.by: dict[tuple[int, int], dict[int, tuple]] = {}
        for seed, tree, *rest in zip(*(nodes.column(c).to_pylist() for c in _NAMES), strict=True):
            self.by.setdefault((seed, tree), {})[rest[0]] = tuple(rest[1:])

    def place(self, bins: np.ndarray, seed: int, tree: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Last node of each row (twice a parent's number, one more to the right) and the parent's value for its side."""
        at, value = np.ones(len(bins), np.int64), np.full(len(bins), np.nan)
        own = self.by.get((seed, tree), {})
        for level in range(depth):
            for n in [n for n in own if n >> level == 1]:
                feature, cut, _, low, high = own[n]
                rows = np.flatnonzero(at == n)
                right = bins[rows, feature] > cut if feature >= 0 else np.zeros(len(rows), bool)
                value[rows] = np.where(right, high, low)
                if feature >= 0:
                    at[rows] = 2 * n + right
        return at, value


def prepare(panel: DataFrame, folds: DataFrame, group: list[str], features: list[str], label: str, bins: int = BINS, block_rows: int = 20_000) -> DataFrame:
    """(keys, _block, role, _row, symbol, date, _y, _w0, _w1, bins) of every row of every fold, written once.

    ``_w0`` and ``_w1`` weigh both classes of a group's training rows alike. Training rows without a label
    take no part; a feature without a known training value has one bin.
    """
    from ..operators.splits import assign

    send_package(panel.sparkSession)
    keys = [*group, "fold"]
    rows = assign(panel.withColumn("x", vector(features)), folds)
    rows = rows.select(*dict.fromkeys([*keys, "symbol", "date"]), "role", F.col(label).cast("double").alias("_y"), "x")
    rows = materialize(rows.where("role = 'test' or _y is not null"), "tree-rows")
    width = len(features)
    steps = [(i + 1) / bins for i in range(bins - 1)]
    train = rows.where("role = 'train'")
    quantiles = [F.percentile_approx(F.element_at("x", j + 1), F.array(*[F.lit(q) for q in steps]), 10_000).alias(f"q{j}") for j in range(width)]
    n, p = F.count(F.lit(1)), F.sum("_y")
    edges = train.groupBy(*keys).agg(F.try_divide(n, 2 * (n - p)).alias("_w0"), F.try_divide(n, 2 * p).alias("_w1"), *quantiles)
    none = F.array().cast("array<double>")
    edges = edges.select(*keys, *[F.coalesce(f"_w{c}", F.lit(1.0)).alias(f"_w{c}") for c in "01"], F.array(*[F.coalesce(f"q{j}", none) for j in range(width)]).alias("edges"))
    rows = materialize(blocked(rows, keys, ["symbol", "date"], block_rows).withColumn("_row", F.xxhash64("symbol", "date")), "tree-blocks")
    # Each block meets its group's edges once.
    held = materialize(edges.join(rows.select(*keys, "_block").distinct(), keys), "tree-edges")
    kept = [*dict.fromkeys([*keys, "_block", "role", "_row", "symbol", "date", "_y"])]
    out = f"{_fields(rows, kept)}, _w0 double, _w1 double, bins binary"

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        if len(left) and len(right):
            limits = [np.unique(np.array(e, float)) for e in right.column("edges")[0].as_py()]
            made = binned(dense(left.column("x"), width), limits)
            w = [right.column(c)[0].as_py() for c in ("_w0", "_w1")]
        else:
            left, made, w = left.slice(0, 0), np.zeros((0, width), np.uint8), (1.0, 1.0)
        data = made.tobytes()
        table = left.select(kept)
        for name, value in zip(("_w0", "_w1"), w, strict=True):
            table = table.append_column(name, pa.array(np.full(len(left), value)))
        return table.append_column("bins", pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary()))

    found = rows.groupBy(*keys, "_block").cogroup(held.groupBy(*keys, "_block")).applyInArrow(cut, out)
    return materialize(found, "tree-bins")


def _bins(table: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(table), width)


def fit_forest(rows: DataFrame, group: list[str], width: int, seeds: tuple[int, ...] = (0,), size: Forest = Forest(), bins: int = BINS) -> DataFrame:
    """Nodes (keys, seed, tree, node, feature, bin, gain, value_left, value_right) of all forests on ``prepare``d rows.

    A root that cannot be split is a node with feature -1 that holds the group's rate.
    """
    keys = [*group, "fold"]
    train = rows.where("role = 'train'")
    blocks = materialize(train.select(*keys, "_block").distinct(), "forest-blocks")
    part = f"{_fields(train, keys)}, _id long, seed int, tree int, node int, h binary"
    empty_nodes = train.select(*keys).limit(0).withColumns({n.split()[0]: F.lit(None).cast(n.split()[1]) for n in NODE.split(", ")})
    nodes = materialize(empty_nodes, "forest-nodes")
    names = [*keys, "_id", "seed", "tree", "node", "h"]

    def grow(level: int):
        def histograms(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out: dict[str, list] = {n: [] for n in names}
            if len(left):
                table, walk = _bins(left, width), Walk(right)
                y, row = left.column("_y").to_numpy(), left.column("_row").to_numpy()
                w = np.where(y == 1, left.column("_w1").to_numpy(), left.column("_w0").to_numpy())
                own = [left.column(k)[0].as_py() for k in (*keys, "_block")]
                for seed in seeds:
                    for tree in range(size.trees):
                        if level and (seed, tree) not in walk.by:
                            continue
                        at, _ = walk.place(table, seed, tree, level)
                        times = draws(row, seed, tree)
                        live = np.flatnonzero((times > 0) & (at >> level == 1))
                        order = live[np.argsort(at[live], kind="stable")]
                        for rows_of in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                            node = int(at[rows_of[0]])
                            features = chosen(width, seed, tree, node)
                            spot = table[rows_of][:, features].astype(np.int64) + np.arange(len(features)) * bins
                            t = times[rows_of]
                            weights = (t * w[rows_of] * (y[rows_of] == 0), t * w[rows_of] * (y[rows_of] == 1), t)
                            h = np.stack([np.bincount(spot.ravel(), np.repeat(v, len(features)), len(features) * bins) for v in weights], axis=1)
                            for name, value in zip(names, (*own, seed, tree, node, h.tobytes()), strict=True):
                                out[name].append(value)
            return pa.table({n: pa.array(out[n], t) for n, t in zip(names, types(left), strict=True)})

        return histograms

    def types(table: pa.Table) -> list[pa.DataType]:
        return [*(table.schema.field(k).type for k in keys), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def choose(level: int):
        def run(batches):
            for b in batches:
                cols: dict[str, list] = {n: [] for n in _NAMES}
                kept = []
                for i, (seed, tree, node, h) in enumerate(zip(*(b.column(c).to_pylist() for c in ("seed", "tree", "node", "h")), strict=True)):
                    features = chosen(width, seed, tree, node)
                    h = np.frombuffer(h, np.float64).reshape(len(features), bins, 3)
                    best = split(h, size.least)
                    if best:
                        f, cut, gain, low, high = best
                        row = (seed, tree, node, int(features[f]), cut, gain, _rate(low), _rate(high))
                    elif level == 0:
                        rate = _rate(h[0].sum(axis=0))
                        row = (seed, tree, node, -1, 0, 0.0, rate, rate)
                    else:
                        continue
                    kept.append(i)
                    for n, v in zip(_NAMES, row, strict=True):
                        cols[n].append(v)
                own = b.take(pa.array(kept, pa.int64()))
                kinds = [pa.int32()] * 5 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *(pa.array(cols[n], t) for n, t in zip(_NAMES, kinds, strict=True))], names=[*keys, *_NAMES])

        return run

    many = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = many.isEmpty()
    for level in range(size.depth):
        held = nodes.join(blocks, keys)
        live = train.select(*keys, "_block", "_row", "_y", "_w0", "_w1", "bins")
        partial = live.groupBy(*keys, "_block").cogroup(held.groupBy(*keys, "_block")).applyInArrow(grow(level), part)
        # A group of one block has its sums already.
        total = partial.drop("_id") if whole else added(materialize(partial, "forest-sums"), [*keys, "seed", "tree", "node"], "h")
        more = materialize(total.mapInArrow(choose(level), f"{_fields(train, keys)}, {NODE}"), "forest-level")
        nodes = nodes.unionByName(more)
        if more.where("feature >= 0").isEmpty():
            break
    return nodes


def score_forest(rows: DataFrame, nodes: DataFrame, group: list[str], width: int, depth: int = Forest().depth) -> DataFrame:
    """(keys, symbol, date, _y, seed, prob) of test rows: mean over a seed's trees of the rate where a row ends."""
    keys = [*group, "fold"]
    test = rows.where("role = 'test'")
    held = nodes.join(materialize(test.select(*keys, "_block").distinct(), "forest-test"), keys)
    kept = [*dict.fromkeys([*keys, "symbol", "date", "_y"])]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        walk, table = Walk(right), _bins(left, width)
        parts = []
        for seed in sorted({s for s, _ in walk.by}) if len(left) else []:
            values = [walk.place(table, seed, tree, depth)[1] for s, tree in walk.by if s == seed]
            own = left.select(kept).append_column("seed", pa.array(np.full(len(left), seed, np.int32)))
            parts.append(own.append_column("prob", pa.array(np.mean(values, axis=0))))
        if not parts:
            own = left.select(kept).slice(0, 0)
            return own.append_column("seed", pa.array([], pa.int32())).append_column("prob", pa.array([], pa.float64()))
        return pa.concat_tables(parts)

    columns = [*dict.fromkeys([*kept, "_block", "bins"])]
    return test.select(*columns).groupBy(*keys, "_block").cogroup(held.groupBy(*keys, "_block")).applyInArrow(run, f"{_fields(rows, kept)}, seed int, prob double")


def gain_shares(nodes: DataFrame, features: list[str], top: int = 15) -> DataFrame:
    """(feature, rank, share): split gains summed over all groups, folds, seeds and trees, the largest first."""
    named = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    found = nodes.where("feature >= 0").groupBy(named.alias("feature")).agg(F.sum("gain").alias("gain"))
    # One row for each feature.
    rows = found.orderBy(F.desc("gain"), "feature").collect()
    total = sum(r["gain"] for r in rows)
    ranked = [(r["feature"], k, r["gain"] / total) for k, r in enumerate(rows[:top], 1)]
    return nodes.sparkSession.createDataFrame(ranked, "feature string, rank int, share double")


def boosted(bins_: np.ndarray, y: np.ndarray, row: np.ndarray, test: np.ndarray, heavy: float, seed: int, size: Boost, bins: int = BINS) -> np.ndarray:
    """P(up) of ``test`` rows after all rounds on the other binned rows.

    Second-order boosting of the logistic loss; each round draws a share of rows and of features.
    """
    width = bins_.shape[1]
    weight = np.where(y == 1, heavy, 1.0)
    known, unseen = np.zeros(len(bins_)), np.zeros(len(test))
    offset = np.arange(width) * bins
    for k in range(size.rounds):
        p = 1 / (1 + np.exp(-known))
        g, h = weight * (p - y), weight * p * (1 - p)
        use = mixed(seed, k, row).astype(np.float64) < size.rows * 2.0**64
        columns = np.sort(np.argsort(mixed(seed, k, -1, np.arange(width)), kind="stable")[: max(1, int(size.columns * width))])
        at, at_test = np.ones(len(bins_), np.int64), np.ones(len(test), np.int64)
        value = np.zeros(2 << size.depth)
        value[1] = -g[use].sum() / (h[use].sum() + size.l2)
        for level in range(size.depth):
            for node in range(1 << level, 2 << level):
                rows = np.flatnonzero((at == node) & use)
                if len(rows) < 2:
                    continue
                spot = (bins_[rows][:, columns] + offset[: len(columns)]).ravel()
                sums = [np.bincount(spot, np.repeat(v[rows], len(columns)), len(columns) * bins).reshape(len(columns), bins) for v in (g, h)]
                left = [s.cumsum(axis=1)[:, :-1] for s in sums]
                total = [float(s[0].sum()) for s in sums]
                right = [t - s for t, s in zip(total, left, strict=True)]
                fits = lambda a, b: a * a / (b + size.l2)
                gain = fits(*left) + fits(*right) - fits(*total)
                gain = np.round(np.where((left[1] >= size.child) & (right[1] >= size.child), gain, -np.inf), 9)
                f, b = divmod(int(np.argmax(gain)), bins - 1)
                if not gain[f, b] > 0:
                    continue
                for ways, table in ((at, bins_), (at_test, test)):
                    own = ways == node
                    ways[own] = 2 * node + (table[own, columns[f]] > b)
                for side, s in ((2 * node, left), (2 * node + 1, right)):
                    value[side] = -s[0][f, b] / (s[1][f, b] + size.l2)
        known += size.rate * value[at]
        unseen += size.rate * value[at_test]
    return 1 / (1 + np.exp(-unseen))


def out_of_fold_boosted(rows: DataFrame, group: list[str], width: int, seeds: tuple[int, ...] = (0,), size: Boost = Boost(), bins: int = BINS) -> DataFrame:
    """(keys, symbol, date, _y, seed, prob) of test rows of ``prepare``d rows, every group and seed in one job.

    A group is gathered in one task, so it has to be bounded, as a symbol's calendar in a fold is; a pooled
    model belongs in ``pooled``. With one class only, the class is the forecast.
    """
    keys = [*group, "fold"]
    kept = [*dict.fromkeys([*keys, "symbol", "date", "_y"])]
    tried = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_test = np.array([r == "test" for r in table.column("role").to_pylist()], bool)
        # The order of rows decides sums' last digits, so it is fixed.
        order = np.argsort(table.column("_row").to_numpy(), kind="stable")
        train, test = order[~is_test[order]], np.flatnonzero(is_test)
        out = table.select(kept).take(pa.array(test))
        y = table.column("_y").to_numpy()[train] if len(train) else np.zeros(0)
        up = float(y.sum())
        if not len(train):
            prob = np.full(len(test), 0.5)
        elif up in (0.0, float(len(y))):
            prob = np.full(len(test), up / len(y))
        else:
            made = _bins(table, width)
            prob = boosted(made[train], y, table.column("_row").to_numpy()[train], made[test], (len(y) - up) / up, key[-1].as_py(), size, bins)
        out = out.append_column("seed", pa.array(np.full(len(test), key[-1].as_py(), np.int32)))
        return out.append_column("prob", pa.array(prob))

    columns = [*dict.fromkeys([*kept, "role", "_row", "bins", "seed"])]
    return tried.select(*columns).groupBy(*keys, "seed").applyInArrow(run, f"{_fields(rows, kept)}, seed int, prob double")
