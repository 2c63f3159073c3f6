"""Probability calibration: Platt scaling, exact isotonic regression, selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import grouped

MIN_ROWS, MIN_SELECT, SELECT_SHARE, MIN_LEVELS = 100, 40, 0.20, 3


def logit(p: Column) -> Column:
    c = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return F.log(c / (1 - c))


def fit_platt(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Slope ``a`` and intercept ``b`` on the logit per key."""
    seen = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(
        *keys, logit(F.col(p)).alias("_z"), F.col(y).cast("double").alias("_t")
    )
    w = grouped.fit_logistic(seen, keys, ["_z"], "_t", l2=0.0)
    return w.select(*keys, F.element_at("weights", 2).alias("a"), F.element_at("weights", 1).alias("b"))


def apply_platt(rows: DataFrame, params: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    out = rows.join(params, keys)
    q = grouped.sigmoid(F.col("a") * logit(F.col(p)) + F.col("b"))
    return out.withColumn("platt", q).drop("a", "b")


class _Pool:
    """Adjacent-violator pooling over blocks of ``(base, off, first, w, s)``.

    A block's mean probability is ``base + off / w``, exact when all its probabilities
    are equal. Neighbours of equal level are kept as one run that remembers where it
    starts: once one of them is pooled with a violator, the comparison pools all of them.
    """

    FIELDS = ("base", "off", "first", "w", "s")

    def __init__(self):
        self.blocks = []

    def add(self, base, off, first, w, s):
        kept = self.blocks
        while kept:
            base0, off0, first0, w0, s0 = kept[-1]
            mine, before = s * w0, s0 * w
            if mine > before:
                break
            kept.pop()
            base, off = base0, off0 + off + w * (base - base0)
            w, s = w0 + w, s0 + s
            first = first0 if mine == before else base + off / w
        kept.append((base, off, first, w, s))

    def frame(self):
        return pd.DataFrame(self.blocks, columns=self.FIELDS)


def fit_isotonic(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y", seq: str = "seq", parts: int | None = None) -> DataFrame:
    """Exact pool-adjacent-violators steps per key, without gathering a key's rows.

    Rows are range-partitioned by (key, probability, seq), which also splits a key or a
    probability that holds most rows; every task pools its own stretch, and the few
    remaining blocks of a key are pooled once more. Pooling in stretches gives the same
    blocks as one pass. ``from_p`` is where a step starts, ``value`` its level.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    seen = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(p).cast("double").alias("_p"), F.col(seq).cast("bigint").alias("_q"), F.col(y).cast("double").alias("_y")
    )
    order = [*keys, "_p", "_q"]
    ranged = seen.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fields = ", ".join(f"{c} {t}" for c, t in seen.dtypes if c in keys)
    head = f"{fields}, " if fields else ""

    def local(batches):
        key, pool, at = None, None, None
        for pdf in batches:
            for values in pdf.itertuples(index=False):
                k, (x, q, t) = values[: len(keys)], values[len(keys) :]
                if k != key:
                    if pool is not None:
                        yield _named(pool.frame(), keys, key, at)
                    key, pool, at = k, _Pool(), (x, q)
                pool.add(x, 0.0, x, 1.0, t)
        if pool is not None:
            yield _named(pool.frame(), keys, key, at)

    blocks = ranged.mapInPandas(local, f"{head}base double, off double, first double, w double, s double, at_p double, at_q bigint, i int")

    def merge(pdf):
        pdf = pdf.sort_values(["at_p", "at_q", "i"], kind="mergesort")
        pool = _Pool()
        for r in pdf.itertuples(index=False):
            pool.add(r.base, r.off, r.first, r.w, r.s)
        out = pool.frame()
        out["from_p"], out["value"] = out["first"], (out["s"] / out["w"]).clip(0.0, 1.0)
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "from_p", "value", "w"]]

    return blocks.groupBy(*keys).applyInPandas(merge, f"{head}from_p double, value double, w double")


def _named(frame, keys, key, at):
    frame["at_p"], frame["at_q"], frame["i"] = float(at[0]), int(at[1]), range(len(frame))
    for name, value in zip(keys, key):
        frame[name] = value
    return frame[[*keys, *_Pool.FIELDS, "at_p", "at_q", "i"]]


def apply_isotonic(rows: DataFrame, steps: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Right-closed step lookup with clipped ends.

    The steps of a key are few and travel as one sorted array; rows never meet them in a
    range join.
    """
    table = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("from_p", "value"))).alias("_steps"))
    out = rows.join(table, keys)
    below = F.filter("_steps", lambda s: s["from_p"] <= F.col(p))
    value = F.when(F.size(below) > 0, F.element_at(below, -1)["value"]).otherwise(F.element_at("_steps", 1)["value"])
    return out.withColumn("isotonic", F.when(F.col(p).isNotNull(), value)).drop("_steps")


def select_calibrator(rows: DataFrame, keys: list[str], order: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Calibration method per key, chosen on the newest fifth of the fit rows only.

    Below 100 rows nothing is calibrated; a map with under three levels falls back to
    Platt; isotonic must beat Platt by one standard error of the raw Brier loss.
    ``order`` is chronological; positions come from counts per leading order column, so
    no key is sorted in one task.
    """
    seen = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    per = seen.groupBy(*keys, order[0]).agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*keys)
    per = per.withColumns(
        {
            "_before": F.coalesce(F.sum("_c").over(by.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_n": F.sum("_c").over(by),
        }
    ).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*keys, order[0]).orderBy(*order[1:])) - 1
    ranked = seen.join(per, [*keys, order[0]]).withColumn("_r", F.col("_before") + inside)
    size = F.greatest(F.lit(MIN_SELECT), F.rint(F.col("_n") * SELECT_SHARE))
    ranked = materialize(ranked.withColumn("_pick", F.col("_r") >= F.col("_n") - size), "calibration-rows")
    enough = (F.col("_n") >= MIN_ROWS) & (F.col("_n") - size >= MIN_ROWS)
    fit, pick = ranked.where(enough & ~F.col("_pick")), ranked.where(enough & F.col("_pick"))
    steps = materialize(fit_isotonic(fit, keys, p, y, order[-1]), "isotonic-steps")
    both = apply_isotonic(apply_platt(pick, fit_platt(fit, keys, p, y), keys, p), steps, keys, p)
    yy = F.col(y)
    loss = F.pow(F.col(p) - yy, 2)
    result = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_select"),
        F.avg(F.pow(F.col("platt") - yy, 2)).alias("brier_platt"),
        F.avg(F.pow(F.col("isotonic") - yy, 2)).alias("brier_isotonic"),
        (F.stddev_samp(loss) / F.sqrt(F.count(F.lit(1)))).alias("brier_se"),
    )
    levels = steps.groupBy(*keys).agg(F.count_distinct(F.round("value", 12)).alias("levels"))
    every = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = every.join(result, keys, "left").join(levels, keys, "left")
    method = (
        F.when(F.col("n_select").isNull(), "uncalibrated")
        .when(F.col("levels") < MIN_LEVELS, "platt")
        .when(F.col("brier_isotonic") + F.col("brier_se") < F.col("brier_platt"), "isotonic")
        .otherwise("platt")
    )
    return out.withColumn("method", method)


def calibrate(fit: DataFrame, rows: DataFrame, methods: DataFrame, keys: list[str], seq: str, p: str = "p", y: str = "y") -> DataFrame:
    """Calibrated probability ``q`` with each key's method, refitted on all fit rows."""
    params = fit_platt(fit, keys, p, y)
    steps = materialize(fit_isotonic(fit, keys, p, y, seq), "isotonic-steps")
    out = apply_isotonic(apply_platt(rows, params, keys, p), steps, keys, p)
    out = out.join(methods.select(*keys, "method"), keys)
    q = F.when(F.col("method") == "platt", F.col("platt")).when(F.col("method") == "isotonic", F.col("isotonic"))
    return out.withColumn("q", F.coalesce(q, F.col(p)))


def sensitivity(rows: DataFrame, keys: list[str], raw: str = "p", calibrated: str = "q") -> DataFrame:
    """Distinct calibrated levels, concentration at one half and decision changes."""
    q = F.col(calibrated)
    seen = rows.where(F.col(raw).isNotNull() & q.isNotNull())
    near = lambda d: F.round(F.avg((F.abs(q - 0.5) <= d).cast("double")), 4)
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.round(q, 8)).alias("n_levels"),
        near(0.02).alias("near_002"),
        near(0.05).alias("near_005"),
        F.count_if((F.col(raw) >= 0.5) != (q >= 0.5)).alias("n_crossing"),
    )
