"""Chronological splits as tables of ``(fold, role, date)``.

Only distinct dates are ever ranked: their number is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_dates(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct dates with position ``r`` (from 0) and count ``n``, per key or overall."""
    part = keys or ["_one"]
    days = panel.select(*(keys or []), "date").distinct()
    if not keys:
        days = days.withColumn("_one", F.lit(1))
    by = Window.partitionBy(*part)
    out = days.withColumns(
        {"r": F.row_number().over(by.orderBy("date")) - 1, "n": F.count(F.lit(1)).over(by)}
    )
    return out if keys else out.drop("_one")


def chronological(panel: DataFrame, train_end, test_end=None) -> DataFrame:
    """Rows with role train (up to ``train_end``) or test (after it, up to ``test_end``)."""
    d, cut = F.col("date"), F.lit(train_end).cast("date")
    role = F.when(d <= cut, "train").otherwise("test")
    out = panel.withColumn("role", role)
    return out if test_end is None else out.where(d <= F.lit(test_end).cast("date"))


def _roles(days: DataFrame, start: Column, end: Column, gap: Column, keep: list[str]) -> DataFrame:
    r = F.col("r")
    role = (
        F.when((r >= start) & (r < end), "test")
        .when((r < start) & (r >= start - gap), "purge")
        .when(r < start, "train")
    )
    return days.withColumn("role", role).where(F.col("role").isNotNull()).select(*keep, "fold", "role", "date")


def walk_forward(
    panel: DataFrame, test_size: int, step: int | None = None, min_train: int = 0, embargo: int = 0, keys: list[str] | None = None
) -> DataFrame:
    """Expanding folds: test windows of ``test_size`` dates every ``step`` dates.

    The last ``embargo`` training dates are purged unless that would empty the training
    set; a trailing partial window is dropped.
    """
    step = step or test_size
    days = ranked_dates(panel, keys)
    count = F.floor((F.col("n") - test_size - min_train) / step) + 1
    days = days.where(count >= 1).withColumn("fold", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    start = min_train + F.col("fold") * step
    gap = F.when(start > embargo, embargo).otherwise(0)
    return _roles(days.where(start > 0), start, start + test_size, gap, keys or [])


def chrono_folds(panel: DataFrame, n_splits: int = 5, embargo: int = 20) -> DataFrame:
    """Training on the first i/n of the dates, testing on all the rest."""
    days = ranked_dates(panel).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    cut = F.rint(F.col("n") * F.col("fold") / n_splits)
    gap = F.when(cut > embargo, embargo).otherwise(0)
    return _roles(days.where(cut < F.col("n")), cut, F.col("n"), gap, [])


def panel_folds(
    panel: DataFrame, horizon: int = 20, n_folds: int = 4, min_train: int = 60, holdout: float = 0.20,
    embargo: int | None = None, test_size: int | None = None,
) -> DataFrame:
    """Global folds before an untouched newest holdout.

    ``max(horizon, embargo)`` dates are purged before every test window and before the
    holdout, whose rows carry fold -1.
    """
    gap = max(horizon, horizon if embargo is None else embargo)
    days = ranked_dates(panel)
    held = F.greatest(F.lit(1), F.ceil(F.col("n") * holdout))
    days = days.withColumn("pre", F.col("n") - held)
    size = F.lit(test_size) if test_size else F.greatest(F.lit(1), F.floor((F.col("pre") - min_train) / n_folds))
    fold = F.explode(F.sequence(F.lit(-1), F.lit(n_folds - 1)))
    days = days.withColumn("size", size).withColumn("fold", fold)
    start = F.when(F.col("fold") < 0, F.col("pre")).otherwise(min_train + F.col("fold") * F.col("size"))
    end = F.when(F.col("fold") < 0, F.col("n")).otherwise(F.least(start + F.col("size"), F.col("pre")))
    ok = (F.col("fold") < 0) | ((start < F.col("pre")) & (start > gap))
    return _roles(days.where(ok), start, end, F.lit(gap), [])


def assign(panel: DataFrame, folds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Panel rows repeated for every fold and role their date takes part in."""
    return panel.join(folds.where("role <> 'purge'"), [*(keys or []), "date"])
