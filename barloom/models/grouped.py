"""Linear models for many groups at once from additive statistics.

A group's fit needs only the sums of its cross products. Spark computes those sums for
every (symbol, fold, ...) in one aggregation, combined before the shuffle, so neither a
group nor the table is ever gathered; a pandas helper then solves one small system per
row of the statistics table. Meant for up to a few dozen features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def standardize(rows: DataFrame, train: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Scale features by the mean and population deviation of the group's training rows;
    unknown values become the training mean."""
    stats = train.groupBy(*keys).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    out = rows.join(stats, keys)
    scaled = {
        f: F.coalesce(F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.nullif(f"_s_{f}", F.lit(0.0))), F.lit(0.0))
        for f in features
    }
    return out.withColumns(scaled).drop(*[f"_{k}_{f}" for k in "ms" for f in features])


def _terms(features: list[str]) -> list[Column]:
    return [F.lit(1.0)] + [F.col(f) for f in features]


def gram(rows: DataFrame, keys: list[str], features: list[str], target: Column, weight: Column | None = None) -> DataFrame:
    """Weighted cross products per key: ``xx`` (upper triangle), ``xy`` and row count."""
    w = F.lit(1.0) if weight is None else weight
    x = _terms(features)
    d = len(x)
    xx = [F.sum(w * x[i] * x[j]).alias(f"xx{i}_{j}") for i in range(d) for j in range(i, d)]
    xy = [F.sum(w * x[i] * target).alias(f"xy{i}") for i in range(d)]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *xx, *xy)
    return out.select(
        *keys,
        "n_rows",
        F.array(*[F.col(f"xx{i}_{j}") for i in range(d) for j in range(i, d)]).alias("xx"),
        F.array(*[F.col(f"xy{i}") for i in range(d)]).alias("xy"),
    )


def solve(stats: DataFrame, keys: list[str], l2: float = 1.0, keep: str | None = None) -> DataFrame:
    """Ridge weights per row of ``gram`` statistics; the intercept is not penalised.

    ``keep`` names an array<int> column of term positions to fit on (0 is the intercept);
    other weights are zero.
    """
    cols = [*keys, "n_rows", "xx", "xy"] + ([keep] if keep else [])
    schema = stats.select(*keys, "n_rows").withColumn("weights", F.array(F.lit(0.0))).schema

    def step(batches):
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                xy = np.asarray(row.xy, dtype=float)
                d = len(xy)
                a = np.zeros((d, d))
                a[np.triu_indices(d)] = np.asarray(row.xx, dtype=float)
                a = a + np.triu(a, 1).T
                a[np.arange(1, d), np.arange(1, d)] += l2
                at = np.asarray(getattr(row, keep), dtype=int) if keep else np.arange(d)
                full = np.zeros(d)
                full[at] = np.linalg.lstsq(a[np.ix_(at, at)], xy[at], rcond=None)[0]
                found.append(full)
            out = pdf[[*keys, "n_rows"]].copy()
            out["weights"] = pd.Series(found, index=pdf.index, dtype=object)
            yield out

    return stats.select(*cols).mapInPandas(step, schema)


def linear(features: list[str], weights: str = "weights") -> Column:
    """Dot product of the terms with a weights array, on the JVM."""
    out = F.element_at(weights, 1)
    for i, f in enumerate(features):
        out = out + F.element_at(weights, i + 2) * F.col(f)
    return out


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def balanced(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Add ``_w`` so that both classes weigh the same inside a group."""
    y = F.col(label)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_p"))
    each = F.when(y == 1, F.try_divide(F.col("_n"), 2 * F.col("_p"))).otherwise(
        F.try_divide(F.col("_n"), 2 * (F.col("_n") - F.col("_p")))
    )
    return rows.join(sizes, keys).withColumn("_w", F.coalesce(each, F.lit(1.0))).drop("_n", "_p")


def fit_ridge(train: DataFrame, keys: list[str], features: list[str], label: str, l2: float = 1.0) -> DataFrame:
    known = train.where(F.col(label).isNotNull())
    return solve(gram(known, keys, features, F.col(label).cast("double")), keys, l2)


def fit_logistic(
    train: DataFrame, keys: list[str], features: list[str], label: str, l2: float = 1.0, balance: bool = False,
    tolerance: float = 1e-9, most: int = 200,
) -> DataFrame:
    """Logistic weights per key by iteratively reweighted least squares.

    Each round is one aggregation over the training rows; the small weights table is
    written between rounds, which keeps the plan short and survives lost executors. A key
    whose weights move by no more than ``tolerance`` is done and leaves the next round; one
    that still moves after ``most`` rounds comes back with ``converged`` false.
    """
    rows = train.where(F.col(label).isNotNull()).select(*keys, *features, F.col(label).cast("double").alias("_y"))
    rows = balanced(rows, keys, "_y") if balance else rows.withColumn("_w", F.lit(1.0))
    weights = done = None
    for _ in range(most):
        if weights is None:
            lin = F.lit(0.0)
            seen = rows
        else:
            seen = rows.join(weights.select(*keys, "weights"), keys)
            lin = linear(features)
        seen = seen.withColumn("_lin", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), lin)))
        seen = seen.withColumn("_mu", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), sigmoid(F.col("_lin")))))
        spread = F.col("_mu") * (1 - F.col("_mu"))
        working = F.col("_lin") + (F.col("_y") - F.col("_mu")) / spread
        after = solve(gram(seen, keys, features, working, F.col("_w") * spread), keys, l2)
        if weights is None:
            weights = materialize(after, "logistic-weights")
            continue
        step = F.array_max(F.zip_with("weights", "_before", lambda a, b: F.abs(a - b)))
        after = after.join(weights.select(*keys, F.col("weights").alias("_before")), keys).withColumn("_step", step)
        after = materialize(after.drop("_before"), "logistic-weights")
        still = after.where(F.col("_step") <= tolerance).drop("_step").withColumn("converged", F.lit(True))
        done = still if done is None else done.unionByName(still)
        weights = after.where(F.col("_step") > tolerance).drop("_step")
        if weights.isEmpty():
            return done
    return done.unionByName(weights.withColumn("converged", F.lit(False)))


def score(
    test: DataFrame, weights: DataFrame, keys: list[str], features: list[str], kind: str = "logistic", tags: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``prob`` to the rows: sigmoid of the linear score, the score clipped to [0, 1],
    or the plain score. ``tags`` are further columns of the weights, one output row each."""
    out = test.join(weights.select(*keys, *tags, "weights"), keys)
    lin = linear(features)
    p = sigmoid(lin) if kind == "logistic" else lin
    if kind == "ridge":
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lin))
    return out.withColumn("prob", p).drop("weights")


def out_of_fold(
    panel: DataFrame, folds: DataFrame, features: list[str], label: str, group: list[str], kind: str = "logistic",
    l2: float = 1.0, fold_keys: list[str] | None = None,
) -> DataFrame:
    """Out-of-fold probabilities of one model per ``group`` and fold, all in one job.

    With ``group=[]`` the model is pooled over symbols; with ``["symbol"]`` each symbol
    has its own.
    """
    from ..operators.splits import assign

    keys = [*group, "fold"]
    rows = assign(panel, folds, fold_keys)
    rows = materialize(standardize(rows, rows.where("role = 'train'"), keys, features), "oof-rows")
    train = rows.where("role = 'train'")
    if kind == "logistic":
        weights = fit_logistic(train, keys, features, label, l2)
    else:
        weights = fit_ridge(train, keys, features, label, l2)
    return score(rows.where("role = 'test'"), weights, keys, features, kind)


def leave_one_symbol_out(
    panel: DataFrame, folds: DataFrame, features: list[str], label: str, l2: float = 1.0
) -> DataFrame:
    """Score each symbol with a ridge model pooled over all other symbols.

    Statistics are additive: the pool without a symbol is the fold's total minus the
    symbol's own part, so every held-out model comes from one aggregation.
    """
    from ..operators.splits import assign

    rows = assign(panel, folds)
    rows = materialize(standardize(rows, rows.where("role = 'train'"), ["fold"], features), "loso-rows")
    train = rows.where((F.col("role") == "train") & F.col(label).isNotNull())
    own = materialize(gram(train, ["symbol", "fold"], features, F.col(label).cast("double")), "loso-stats")
    d = len(features) + 1
    total = own.groupBy("fold").agg(
        F.sum("n_rows").alias("_n"),
        F.array(*[F.sum(F.element_at("xx", i + 1)) for i in range(d * (d + 1) // 2)]).alias("_xx"),
        F.array(*[F.sum(F.element_at("xy", i + 1)) for i in range(d)]).alias("_xy"),
    )
    rest = own.join(total, "fold").select(
        "symbol",
        "fold",
        (F.col("_n") - F.col("n_rows")).alias("n_rows"),
        F.zip_with("_xx", "xx", lambda a, b: a - b).alias("xx"),
        F.zip_with("_xy", "xy", lambda a, b: a - b).alias("xy"),
    )
    weights = solve(rest, ["symbol", "fold"], l2)
    return score(rows.where("role = 'test'"), weights, ["symbol", "fold"], features, "ridge")


def ablation(
    panel: DataFrame, folds: DataFrame, groups: dict[str, list[str]], label: str, l2: float = 1.0
) -> DataFrame:
    """Out-of-fold rows of the full model and of one model per dropped feature group.

    The cross products are computed once; a variant only solves a sub-matrix.
    """
    from ..operators.splits import assign

    features = [f for fs in groups.values() for f in fs]
    rows = assign(panel, folds)
    rows = materialize(standardize(rows, rows.where("role = 'train'"), ["fold"], features), "ablation-rows")
    train = rows.where((F.col("role") == "train") & F.col(label).isNotNull())
    stats = gram(train, ["fold"], features, F.col(label).cast("double"))
    variants = {"full": features} | {f"-{g}": [f for f in features if f not in fs] for g, fs in groups.items()}
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                F.array(F.lit(0), *[F.lit(features.index(f) + 1) for f in kept]).alias("terms"),
            )
            for name, kept in variants.items()
        ]
    )
    stats = stats.withColumn("_v", F.explode(options)).select("*", "_v.*").drop("_v")
    weights = materialize(solve(stats, ["fold", "variant"], l2, keep="terms"), "ablation-weights")
    return score(rows.where("role = 'test'"), weights, ["fold"], features, "ridge", ("variant",))


def penalty_sweep(panel: DataFrame, folds: DataFrame, features: list[str], label: str, grid: list[float]) -> DataFrame:
    """Out-of-fold rows for every penalty of a grid from one set of statistics."""
    from ..operators.splits import assign

    rows = assign(panel, folds)
    rows = materialize(standardize(rows, rows.where("role = 'train'"), ["fold"], features), "sweep-rows")
    train = rows.where((F.col("role") == "train") & F.col(label).isNotNull())
    stats = materialize(gram(train, ["fold"], features, F.col(label).cast("double")), "sweep-stats")
    out = None
    for l2 in grid:
        one = solve(stats, ["fold"], l2).withColumn("penalty", F.lit(float(l2)))
        out = one if out is None else out.unionByName(one)
    weights = materialize(out, "sweep-weights")
    return score(rows.where("role = 'test'"), weights, ["fold"], features, "ridge", ("penalty",))
