"""Resampling of units (symbols, dates, clusters of rows) with replicates as vectors.

A statistic that is a ratio of sums is resampled from each unit's own sums: the sums of a batch of
units times the matrix of their weights in all rounds give the batch's share of every replicate.
Workers pass on one row per round and task, whatever the number of units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.tables import one_row
from ..session import materialize
from . import quality


def _poisson() -> list[float]:
    """P(Poisson(1) <= k) for every k below 1 in double precision."""
    out, total, p, k = [], 0.0, 2.718281828459045 ** -1, 0
    while total + p > total:
        total += p
        out.append(total)
        k += 1
        p /= k
    return out


POISSON = _poisson()


def weights(key: str, rounds: int, seed: int) -> Column:
    """A unit's Poisson(1) weight in every round, drawn by a hash of seed, round and key, as one array.

    The first 13 hexadecimal digits of the hash are a fraction of 2**52; digits compare like numbers.
    """
    text = lambda b: F.concat_ws(":", F.lit(str(seed)), b.cast("string"), F.col(key).cast("string"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda b: F.substring(F.md5(text(b)), 1, 13))

    def drawn(x: Column) -> Column:
        k = F.when(x <= f"{int(POISSON[0] * (1 << 52)):013x}", 0)
        for n, level in enumerate(POISSON[1:], 1):
            k = k.when(x <= f"{int(level * (1 << 52)):013x}", n)
        return k.otherwise(len(POISSON)).cast("tinyint")

    return F.transform(digits, drawn)


def replicates(units: DataFrame, key: str, sums: list[str], rounds: int, seed: int) -> DataFrame:
    """(_b, *sums): the sums over all units under every round's weights."""
    names = [f"s{i}" for i in range(len(sums))]
    # Units are few bytes but much work, so they are dealt to all cores.
    dealt = units.repartition(units.sparkSession.sparkContext.defaultParallelism, key)
    drawn = dealt.select(*[F.col(c).cast("double").alias(n) for c, n in zip(sums, names, strict=True)], weights(key, rounds, seed).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not len(b):
                continue
            w = b.column("w").flatten().to_numpy().reshape(len(b), rounds).astype(np.float64)
            v = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names])
            total = v.T @ w if total is None else total + v.T @ w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, rounds + 1, dtype=np.int32)), *map(pa.array, total)], names=["_b", *names])

    parts = drawn.mapInArrow(run, "_b int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("_b").agg(*[F.sum(n).alias(c) for n, c in zip(names, sums, strict=True)])


def ratio_interval(
    units: DataFrame, key: str, top: str, bottom: str, rounds: int = 1000, low: float = 0.025, high: float = 0.975, seed: int = 42
) -> DataFrame:
    """One row (mean, ci_lower, ci_upper, se) of sum(top) / sum(bottom) under resampling of ``units``.

    ``key`` names each unit: units of equal values draw apart, a repeated key fails. Units without
    either sum take no part; a round that draws no unit has no replicate.
    """
    known = quality.require_unique(units, [key]).where(F.col(top).isNotNull() & F.col(bottom).isNotNull())
    known = known.select(F.col(key).alias("_key"), F.col(top).alias("_top"), F.col(bottom).alias("_bottom"))
    # A row for each round, written once for all that is read from it.
    rounds_df = replicates(known, "_key", ["_top", "_bottom"], rounds, seed).select(F.try_divide("_top", "_bottom").alias("m"))
    rounds_df = materialize(rounds_df, "replicates")
    ci = ranking.quantiles(rounds_df, [], "m", {"ci_lower": low, "ci_upper": high}).drop("total")
    se = rounds_df.agg(F.stddev_samp("m").alias("se"))
    return one_row(known.agg(F.try_divide(F.sum("_top"), F.sum("_bottom")).alias("mean")), ci, se)


def mean_interval(units: DataFrame, value: str, key: str, rounds: int = 1000, low: float = 0.025, high: float = 0.975, seed: int = 42) -> DataFrame:
    """As ``ratio_interval`` for the mean of ``value`` over units that have one."""
    return ratio_interval(units.withColumn("_one", F.lit(1.0)), key, value, "_one", rounds, low, high, seed)


def paired_interval(units: DataFrame, candidate: str, reference: str, key: str, rounds: int = 2000, seed: int = 17) -> DataFrame:
    """As ``mean_interval`` for candidate minus reference, over units that have both, with their number ``n_units``."""
    both = units.select(key, (F.col(candidate) - F.col(reference)).alias("_delta")).where(F.col("_delta").isNotNull())
    return one_row(both.agg(F.count(F.lit(1)).alias("n_units")), mean_interval(both, "_delta", key, rounds, seed=seed))


def entropy_validation(
    rows: DataFrame, unit: str, policy: str = "candidate_a_entropy", prob: str = "p", y: str = "y", rounds: int = 2000, seed: int = 17
) -> DataFrame:
    """One row: does the frozen entropy rule hold against accepting everything?

    ``rows`` are the policies' rows with ``accepted``. Accuracy, risk and coverage are compared over all
    rows; the accuracies of each ``unit`` (symbol), paired, are resampled by unit because its rows depend on
    each other. Coverage under 0.30, or an uplift or risk reduction under 0.02, rejects the rule; passing these
    gates alone never promotes it, so what is left is insufficient evidence, as it is without any accepted row.
    """
    right = ((F.col(prob) >= 0.5) == (F.col(y) >= 0.5)).cast("double")
    known = rows.where(F.col(prob).isNotNull() & F.col(y).isNotNull() & (F.col("policy") == policy))
    # Every row is there once for the rule; accepting everything is all of them.
    per = known.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("n_accepted"), F.sum(right).alias("right_all"),
        F.sum(F.when(F.col("accepted"), right)).alias("right_accepted"),
    )
    per = materialize(per, "policy-units")
    per = per.withColumns({"_all": F.try_divide("right_all", "n"), "_own": F.try_divide("right_accepted", "n_accepted")})
    total = per.agg(F.sum("n").alias("n"), F.sum("n_accepted").alias("n_retained"), F.sum("right_all").alias("_ra"), F.sum("right_accepted").alias("_rs"))
    band = paired_interval(per, "_own", "_all", unit, rounds, seed).withColumnsRenamed({"mean": "delta", "n_units": "n_symbols"})
    out = one_row(total, band)
    uplift = F.try_divide("_rs", "n_retained") - F.try_divide("_ra", "n")
    out = out.withColumns({"coverage": F.try_divide(F.col("n_retained").cast("double"), F.col("n")), "accuracy_uplift": uplift, "risk_reduction": uplift})
    passes = (F.col("coverage") >= 0.30) & F.coalesce((F.col("accuracy_uplift") >= 0.02) & (F.col("risk_reduction") >= 0.02), F.lit(False))
    verdict = F.when(F.col("coverage").isNull(), "EVIDENCE STILL INSUFFICIENT").when(~passes, "REJECTED").otherwise("EVIDENCE STILL INSUFFICIENT")
    return out.withColumns({"policy": F.lit(policy), "classification": verdict}).drop("_ra", "_rs")
