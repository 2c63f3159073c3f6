"""Linear models on a hundred and more features for many groups at once.

Every group's model comes from one square matrix of cross products. Workers compute it from blocks
of rows as a packed triangle, triangles of a key are added in rounds of bounded fan-in, and a small
system is solved per key. Rows are read once for all folds: dates that train the same folds share
their sums, and a fold adds up those of its dates.

Unknown values stand at the training mean of their feature, and features are scaled by their
population deviation over the training rows, both recovered from the sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, send_package
from .grouped import sigmoid

BLOCK_ROWS = 20_000
FAN_IN = 64


def vector(features: list[str]) -> Column:
    """Features as one array; values that are not finite are unknown."""
    known = [F.col(f).cast("double") for f in features]
    return F.array(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in known])


def dense(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as a matrix, unknown as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def blocked(rows: DataFrame, keys: list[str], spread: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block``: rows of a key dealt by a hash of ``spread`` into blocks of about ``block_rows``."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    return rows.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64(*spread), F.col("_blocks"))).drop("_blocks")


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def added(partials: DataFrame, keys: list[str], values: str = "g", fan_in: int = FAN_IN) -> DataFrame:
    """Sum packed vectors (float64 bytes) of each key; no task adds more than about ``fan_in`` of them.

    ``_id`` tells the parts of a key apart.
    """
    while True:
        most = partials.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= 1:
            return partials.drop("_id")
        parts = -(-most // fan_in)
        at = F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("long")
        names = [*keys, "_id", values]

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = None
            for x in table.column(values):
                one = np.frombuffer(x.as_buffer(), np.float64)
                total = one.copy() if total is None else total + one
            return pa.Table.from_pydict(dict(zip(names, ([k.as_py()] for k in key), strict=False)) | {values: [total.tobytes()]}, schema=schema(table))

        def schema(table: pa.Table) -> pa.Schema:
            return pa.schema([table.schema.field(n) for n in names])

        dealt = partials.select(*keys, at.alias("_id"), values)
        partials = materialize(dealt.groupBy(*keys, "_id").applyInArrow(add, _fields(dealt, names)), "added")
        if parts == 1:
            return partials.drop("_id")


def moments(
    panel: DataFrame, folds: DataFrame, keys: list[str], features: list[str], label: str, spread: tuple[str, ...] = ("symbol", "date"),
    by_class: bool = True, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """(keys, fold, cls, g): cross products of every group's training rows, by class, and the common pivot.

    ``g`` packs the upper triangle over 1, the features' being known, their values less the pivot
    (0 if unknown) and the label. Rows without a label take no part.
    """
    send_package(panel.sparkSession)
    known = panel.where(F.col(label).isNotNull())
    # The pivot only keeps sums small; any value near the data gives the same models.
    pivot = known.agg(*[F.coalesce(F.avg(F.element_at("x", i + 1)), F.lit(0.0)).alias(f"c{i}") for i in range(len(features))]) if "x" in panel.columns else None
    if pivot is None:
        known = known.withColumn("x", vector(features))
        pivot = known.agg(*[F.coalesce(F.avg(F.element_at("x", i + 1)), F.lit(0.0)).alias(f"c{i}") for i in range(len(features))])
    center = np.array(list(pivot.first()), float)
    width = len(features)
    size = 2 * width + 2
    upper = np.triu_indices(size)
    days = folds.where("role = 'train'").groupBy("date").agg(F.array_join(F.sort_array(F.collect_set("fold")).cast("array<string>"), ",").alias("_folds"))
    cls = F.col(label).cast("int") if by_class else F.lit(0)
    rows = known.join(days, "date").select(*keys, "_folds", cls.alias("cls"), F.col(label).cast("double").alias("_y"), "x", *[F.col(c).alias(f"_at{i}") for i, c in enumerate(spread)])
    own = [*keys, "_folds", "cls"]
    rows = blocked(rows, own, [f"_at{i}" for i in range(len(spread))], block_rows)

    def cross(key: tuple, table: pa.Table) -> pa.Table:
        x = dense(table.column("x"), width) - center
        have = ~np.isnan(x)
        d = np.column_stack((np.ones(len(x)), have, np.where(have, x, 0.0), table.column("_y").to_numpy()))
        first = table.slice(0, 1).select([*own, "_block"])
        return first.append_column("g", pa.array([(d.T @ d)[upper].tobytes()], pa.binary()))

    parts = rows.groupBy(*own, "_block").applyInArrow(cross, _fields(rows, [*own, "_block"]) + ", g binary")
    parts = materialize(parts, "cross-products")
    parts = parts.withColumns({"fold": F.explode(F.split("_folds", ",").cast("array<int>")), "_id": F.xxhash64("_folds", "_block")})
    return added(parts.drop("_folds", "_block"), [*keys, "fold", "cls"]), center


def unpacked(g: bytes, width: int) -> np.ndarray:
    size = 2 * width + 2
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.frombuffer(g, np.float64)
    return out + np.triu(out, 1).T


def scaled(total: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature's known values (pivot at 0); an unknown or constant one has deviation 0."""
    n = np.diag(total)[1 : width + 1]
    safe = np.maximum(n, 1)
    x, xx = total[0, width + 1 : 2 * width + 1], np.diag(total)[width + 1 : 2 * width + 1]
    mean = np.where(n > 0, x / safe, 0.0)
    var = xx / safe - mean**2
    # What is left of a constant by rounding is no variance.
    return mean, np.sqrt(np.where((n > 1) & (var > 1e-12 * np.maximum(xx / safe, 1e-300)), np.maximum(var, 0.0), 0.0))


def standardized(g: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Cross products over 1, the standardised features and the label, from those of ``moments``."""
    w = len(mean)
    size = len(g)
    # Each standardised feature is a combination of its value and of its being known.
    to = np.zeros((size, w + 2))
    to[0, 0] = to[size - 1, w + 1] = 1.0
    inv = np.divide(1.0, scale, out=np.zeros(w), where=scale > 0)
    at = np.arange(w)
    to[1 + w + at, 1 + at] = inv
    to[1 + at, 1 + at] = -mean * inv
    return to.T @ g @ to


def _by_key(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its classes' triangles: at most two."""
    return stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cls", "g"))).alias("parts"))


def solve_ridge(stats: DataFrame, center: np.ndarray, keys: list[str], l2: float = 1.0, balance: bool = False, signed: bool = False) -> DataFrame:
    """(keys, n_rows, base, shift, slope) by key; the intercept is not penalised.

    ``balance`` gives both classes the same weight; ``signed`` fits labels of 1 and -1 instead of 1 and 0.
    A score is base + sum of slope * (x - shift) over known features.
    """
    width = len(center)

    def step(batches):
        for b in batches:
            out = {"n_rows": [], "base": [], "shift": [], "slope": []}
            for parts in b.column("parts").to_pylist():
                each = [(p["cls"], unpacked(p["g"], width)) for p in parts]
                total = sum(g for _, g in each)
                mean, scale = scaled(total, width)
                n = total[0, 0]
                weight = {c: n / (len(each) * g[0, 0]) if balance else 1.0 for c, g in each}
                s = sum(weight[c] * standardized(g, mean, scale) for c, g in each)
                if signed:
                    one = s[:, 0].copy()
                    s[:-1, -1] = s[-1, :-1] = 2 * s[:-1, -1] - one[:-1]
                a = s[:-1, :-1].copy()
                a[np.arange(1, width + 1), np.arange(1, width + 1)] += l2
                w = np.linalg.lstsq(a, s[:-1, -1], rcond=None)[0]
                inv = np.divide(1.0, scale, out=np.zeros(width), where=scale > 0)
                out["n_rows"].append(int(n))
                out["base"].append(float(w[0]))
                out["shift"].append((mean + center).tolist())
                out["slope"].append((w[1:] * inv).tolist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), pa.array(out["n_rows"], pa.int64()), pa.array(out["base"], pa.float64()), pa.array(out["shift"], pa.list_(pa.float64())), pa.array(out["slope"], pa.list_(pa.float64()))],
                names=[*keys, "n_rows", "base", "shift", "slope"],
            )

    rows = _by_key(stats, keys)
    return rows.mapInArrow(step, f"{_fields(rows, keys)}, n_rows long, base double, shift array<double>, slope array<double>")


def score(rows: DataFrame, weights: DataFrame, keys: list[str], kind: str = "ridge") -> DataFrame:
    """Add ``prob`` to rows with a feature array ``x``: the score, clipped to [0, 1] (ridge) or as a logistic probability."""
    out = rows.join(weights.select(*keys, "base", "shift", "slope"), keys)
    terms = F.zip_with("x", F.arrays_zip("shift", "slope"), lambda v, s: F.coalesce((v - s["shift"]) * s["slope"], F.lit(0.0)))
    lin = F.col("base") + F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    p = sigmoid(lin) if kind == "logistic" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), lin)) if kind == "ridge" else lin
    return out.withColumn("prob", p).drop("base", "shift", "slope")


def fit_logistic(
    rows: DataFrame, stats: DataFrame, center: np.ndarray, keys: list[str], l2: float = 1.0, balance: bool = True, tolerance: float = 1e-8, most: int = 50,
) -> DataFrame:
    """(keys, n_rows, base, shift, slope, rounds, converged) by Newton's method from blocked sums.

    ``rows`` hold keys, ``x``, ``_y`` and ``_block`` of training rows; ``stats`` and ``center`` come from ``moments``.
    A round sums gradient and curvature over a key's blocks; keys that stand still leave the next round.
    """
    width = len(center)
    upper = np.triu_indices(width + 1)

    def first(batches):
        for b in batches:
            out = {"n_rows": [], "mean": [], "scale": [], "heavy": [], "w": []}
            for parts in b.column("parts").to_pylist():
                each = {p["cls"]: unpacked(p["g"], width) for p in parts}
                total = sum(each.values())
                mean, scale = scaled(total, width)
                n = total[0, 0]
                out["n_rows"].append(int(n))
                out["mean"].append((mean + center).tolist())
                out["scale"].append(scale.tolist())
                out["heavy"].append([float(n / (2 * each[c][0, 0])) if balance and len(each) == 2 else 1.0 for c in (0, 1)])
                out["w"].append([0.0] * (width + 1))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), pa.array(out["n_rows"], pa.int64()), *(pa.array(out[c], pa.list_(pa.float64())) for c in ("mean", "scale", "heavy", "w"))],
                names=[*keys, "n_rows", "mean", "scale", "heavy", "w"],
            )

    grouped = _by_key(stats, keys)
    fields = f"{_fields(grouped, keys)}, n_rows long, mean array<double>, scale array<double>, heavy array<double>, w array<double>"
    state = materialize(grouped.mapInArrow(first, fields), "logistic-state")
    blocks = materialize(rows.select(*keys, "_block").distinct(), "logistic-blocks")

    def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, "_id", "g"]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in zip(names, [*(left.schema.field(k).type for k in keys), pa.int64(), pa.binary()], strict=True)})
        mean, scale, heavy, w = (np.array(right.column(c)[0].as_py()) for c in ("mean", "scale", "heavy", "w"))
        z = (dense(left.column("x"), width) - mean) * np.divide(1.0, scale, out=np.zeros(width), where=scale > 0)
        z = np.column_stack((np.ones(len(z)), np.where(np.isnan(z), 0.0, z)))
        y = left.column("_y").to_numpy()
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        c = np.where(y == 1, heavy[1], heavy[0])
        curve = (z * (c * p * (1 - p))[:, None]).T @ z
        g = np.concatenate((z.T @ (c * (y - p)), curve[upper]))
        return left.slice(0, 1).select([*keys, "_block"]).rename_columns([*keys, "_id"]).append_column("g", pa.array([g.tobytes()], pa.binary()))

    def moved(batches):
        for b in batches:
            steps, ws = [], []
            for g, w in zip(b.column("g").to_pylist(), b.column("w").to_pylist(), strict=True):
                flat, w = np.frombuffer(g, np.float64), np.array(w)
                h = np.zeros((width + 1, width + 1))
                h[upper] = flat[width + 1 :]
                h = h + np.triu(h, 1).T
                penalty = np.full(width + 1, l2)
                penalty[0] = 0.0
                step = np.linalg.lstsq(h + np.diag(penalty), flat[: width + 1] - penalty * w, rcond=None)[0]
                step = np.clip(step, -5, 5)
                steps.append(float(np.abs(step).max()))
                ws.append((w + step).tolist())
            kept = [b.column(k) for k in (*keys, "n_rows", "mean", "scale", "heavy")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ws, pa.list_(pa.float64())), pa.array(steps, pa.float64())], names=[*keys, "n_rows", "mean", "scale", "heavy", "w", "_step"])

    done = None
    for k in range(1, most + 1):
        held = state.select(*keys, "mean", "scale", "heavy", "w").join(blocks, keys)
        live = rows.select(*keys, "_block", "x", "_y")
        parts = live.groupBy(*keys, "_block").cogroup(held.groupBy(*keys, "_block")).applyInArrow(sums, f"{_fields(rows, keys)}, _id long, g binary")
        totals = added(materialize(parts, "logistic-sums"), keys)
        after = materialize(state.join(totals, keys).mapInArrow(moved, f"{fields}, _step double"), "logistic-state")
        ready = after.where(F.col("_step") <= tolerance).withColumns({"rounds": F.lit(k), "converged": F.lit(True)}).drop("_step")
        done = ready if done is None else done.unionByName(ready)
        state = after.where(F.col("_step") > tolerance).drop("_step")
        if state.isEmpty():
            break
    else:
        done = done.unionByName(state.withColumns({"rounds": F.lit(most), "converged": F.lit(False)}))
    own = F.slice("w", 2, width)
    slope = F.zip_with(own, "scale", lambda a, s: F.when(s > 0, a / s).otherwise(0.0))
    return done.select(*keys, "n_rows", F.element_at("w", 1).alias("base"), F.col("mean").alias("shift"), slope.alias("slope"), "rounds", "converged")


def out_of_fold(
    panel: DataFrame, folds: DataFrame, features: list[str], label: str, group: list[str], kind: str = "ridge", l2: float = 1.0,
    fit: Callable | None = None,
) -> DataFrame:
    """Out-of-fold rows with ``prob`` of one model per group and fold on any number of features.

    ``ridge`` is the clipped linear score, ``signed`` the balanced fit of 1 and -1 seen through a logistic
    curve, ``logistic`` the balanced logistic model.
    """
    from ..operators.splits import assign

    keys = [*group, "fold"]
    rows = materialize(panel.withColumn("x", vector(features)).drop(*[f for f in features if f not in ("close",)]), "wide-rows")
    if kind == "plain":
        stats, center = moments(rows, folds, group, features, label, by_class=False)
        weights = solve_ridge(stats, center, keys, l2)
    else:
        stats, center = moments(rows, folds, group, features, label)
        if kind == "logistic":
            train = assign(rows, folds).where(F.col("role") == "train").where(F.col(label).isNotNull())
            train = train.select(*keys, "x", F.col(label).cast("double").alias("_y"), "symbol", "date")
            train = materialize(blocked(train, keys, ["symbol", "date"]).drop(*[c for c in ("symbol", "date") if c not in keys]), "logistic-rows")
            weights = fit_logistic(train, stats, center, keys, l2)
        else:
            weights = solve_ridge(stats, center, keys, l2, balance=kind == "signed", signed=kind == "signed")
    weights = materialize(weights, "wide-weights")
    test = assign(rows, folds).where("role = 'test'")
    how = {"logistic": "logistic", "signed": "logistic", "plain": "plain"}.get(kind, "ridge")
    return score(test, weights, keys, how).drop("x")
