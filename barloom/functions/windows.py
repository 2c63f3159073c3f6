"""Rolling window columns over a ``(symbol, date)`` panel.

Every function returns a ``Column``. A panel holds one row per symbol and day, so a
window partition never exceeds the length of the calendar (about 250 rows a year).
Frames count a symbol's own rows (``ROWS``), and a full window is required: the value
is NULL until ``n`` non-null inputs sit in the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(keys=("symbol",), order="date"):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def trailing(n: int, keys=("symbol",), order="date"):
    return ordered(keys, order).rowsBetween(-(n - 1), 0)


def running(keys=("symbol",), order="date"):
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def full(agg: Column, x, n: int, **spec) -> Column:
    """``agg`` over the last ``n`` rows, NULL while fewer than ``n`` values are present."""
    frame = trailing(n, **spec)
    return F.when(F.count(col(x)).over(frame) == n, agg.over(frame))


def lag(x, n: int = 1, **spec) -> Column:
    return F.lag(col(x), n).over(ordered(**spec))


def lead(x, n: int = 1, **spec) -> Column:
    return F.lead(col(x), n).over(ordered(**spec))


def ratio(a, b) -> Column:
    """Division where a zero denominator means unknown."""
    return F.try_divide(col(a), col(b))


def sma(x, n: int, **spec) -> Column:
    return full(F.avg(col(x)), x, n, **spec)


def roll_sum(x, n: int, **spec) -> Column:
    return full(F.sum(col(x)), x, n, **spec)


def roll_max(x, n: int, **spec) -> Column:
    return full(F.max(col(x)), x, n, **spec)


def roll_min(x, n: int, **spec) -> Column:
    return full(F.min(col(x)), x, n, **spec)


def roll_std(x, n: int, sample: bool = False, **spec) -> Column:
    agg = F.stddev_samp(col(x)) if sample else F.stddev_pop(col(x))
    return full(agg, x, n, **spec)


def pct_change(x, n: int = 1, **spec) -> Column:
    return ratio(x, lag(x, n, **spec)) - 1


def diff(x, n: int = 1, **spec) -> Column:
    return col(x) - lag(x, n, **spec)


def slope(x, lookback: int = 5, **spec) -> Column:
    before = lag(x, lookback, **spec)
    return ratio(col(x) - before, before)


def percentile_of_last(x, n: int, **spec) -> Column:
    """Share of the window that does not exceed its newest value."""
    frame = trailing(n, **spec)
    kept = F.collect_list(col(x)).over(frame)
    share = F.size(F.filter(kept, lambda v: v <= col(x))) / F.lit(float(n))
    return F.when((F.size(kept) == n) & col(x).isNotNull(), share)


def mean_abs_dev(x, n: int, **spec) -> Column:
    frame = trailing(n, **spec)
    kept = F.collect_list(col(x)).over(frame)
    mean = F.avg(col(x)).over(frame)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + F.abs(v - mean))
    return F.when(F.size(kept) == n, total / n)


def max_drawdown(x, n: int, **spec) -> Column:
    """Deepest fall below the running peak inside the window."""
    kept = F.collect_list(col(x)).over(trailing(n, **spec))
    start = F.struct(
        F.element_at(kept, 1).cast("double").alias("peak"), F.lit(0.0).alias("depth")
    )

    def step(acc, v):
        peak = F.greatest(acc["peak"], v)
        return F.struct(
            peak.alias("peak"), F.least(acc["depth"], F.try_divide(v, peak) - 1).alias("depth")
        )

    return F.when(F.size(kept) == n, F.aggregate(kept, start, step, lambda acc: acc["depth"]))


def correlation(x, y, frame=None) -> Column:
    """Pearson correlation of pairs, NULL for a constant side (``corr`` would fail the
    job there under ANSI rules)."""
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    c, sa, sb = parts if frame is None else [p.over(frame) for p in parts]
    return F.try_divide(c, sa * sb)


def annual(x: Column, on: bool = True) -> Column:
    return x * F.sqrt(F.lit(float(TRADING_DAYS))) if on else x


def is_true(cond: Column) -> Column:
    """Unknown comparisons count as false."""
    return F.coalesce(cond, F.lit(False))
