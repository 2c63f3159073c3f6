"""Panel hygiene: eligibility, missingness, coverage, uniqueness, column pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLCV = ["open", "high", "low", "close", "adj_close", "volume"]


def as_of_cutoff(panel: DataFrame, as_of) -> DataFrame:
    """Rows known at ``as_of``; apply before any label is built."""
    return panel.where(F.col("date") <= F.lit(as_of).cast("date"))


def inside_window(date: str = "date") -> Column:
    d = F.col(date)
    return (F.col("valid_from").isNull() | (d >= F.col("valid_from"))) & (
        F.col("valid_to").isNull() | (d <= F.col("valid_to"))
    )


def eligible_rows(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Panel rows inside their member's validity window, excluded members removed.

    A universe that lists a symbol twice fails instead of doubling its rows.
    """
    members = require_unique(universe, ["symbol"]).where(F.coalesce("inclusion_status", F.lit("included")) != "excluded")
    return (
        panel.join(members.select("symbol", "valid_from", "valid_to"), "symbol")
        .where(inside_window())
        .select(*[panel[c] for c in panel.columns])
    )


def with_eligibility(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Keep every row and say whether its member was valid that day."""
    m = require_unique(universe, ["symbol"]).select("symbol", "valid_from", "valid_to", F.lit(True).alias("_member"))
    return (
        panel.join(m, "symbol", "left")
        .withColumn("eligible", F.coalesce(F.col("_member") & inside_window(), F.lit(False)))
        .drop("valid_from", "valid_to", "_member")
    )


def mask(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.withColumns({c: F.when(F.col("eligible"), F.col(c)) for c in columns})


def skipped_symbols(panel: DataFrame, universe: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Why a symbol is absent from the pooled panel. ``known`` are the rows left by the
    information cut-off, if there is one."""
    have = panel.select("symbol").distinct()
    unknown = have.join(universe, "symbol", "left_anti").select(
        "symbol", F.lit("not in universe manifest").alias("reason")
    )
    excluded = (
        universe.where(F.col("inclusion_status") == "excluded")
        .join(have, "symbol", "left_semi")
        .select("symbol", F.coalesce("exclusion_reason", F.lit("excluded")).alias("reason"))
    )
    absent = universe.join(have, "symbol", "left_anti").select(
        "symbol", F.lit("no feature frame supplied").alias("reason")
    )
    inside = eligible_rows(panel if known is None else known, universe).select("symbol").distinct()
    empty = (
        universe.where(F.coalesce("inclusion_status", F.lit("included")) != "excluded")
        .join(have, "symbol", "left_semi")
        .join(inside, "symbol", "left_anti")
        .select("symbol", F.lit("no rows inside point-in-time universe window").alias("reason"))
    )
    return unknown.unionByName(excluded).unionByName(absent).unionByName(empty)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled rows and whether a column varies, one row per column, one pass.

    Minimum and maximum tell a constant column; no distinct count is needed.
    """
    stats = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"v_{c}") for c in columns],
    )
    return stats.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"n_{c}").alias("filled"),
                        F.col(f"v_{c}").alias("varies"),
                    )
                    for c in columns
                ]
            )
        )
    )


def model_columns(df: DataFrame, drop_levels: bool = False) -> list[str]:
    """Numeric, varying, non-target columns. The profile is one row per column."""
    numeric = [
        n
        for n, t in df.dtypes
        if t in ("double", "float", "int", "bigint", "smallint", "tinyint")
        and not n.startswith(("target_", "train_", "vol_theta"))
        and not (drop_levels and n in OHLCV)
    ]
    rows = column_profile(df, numeric).where("varies").select("column").collect()
    keep = {r[0] for r in rows}
    return [c for c in numeric if c in keep]


def supervised(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    cols = features or [c for c in df.columns if not c.startswith(("target_", "train_"))]
    return df.where(F.col(target).isNotNull()).select(*cols, target)


def missingness(df: DataFrame, columns: list[str], by: str = "symbol") -> DataFrame:
    """Missing, total and rate per column, overall (NULL key) and per ``by``."""
    rolled = df.rollup(by).agg(
        F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in columns]
    )
    long = rolled.unpivot([by, "total"], columns, "column", "present")
    lost = F.col("total") - F.col("present")
    return long.select(
        by, "column", lost.alias("missing"), "total", F.round(lost / F.col("total"), 6).alias("rate")
    )


def symbol_coverage(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        F.count(target).alias("target_rows"),
    )


def feature_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("symbol").alias("n_symbols"),
        F.countDistinct("date").alias("n_dates"),
        *[F.count(c).alias(c) for c in columns],
    )
    return one.unpivot(["rows", "n_symbols", "n_dates"], columns, "feature", "present").select(
        "feature",
        "rows",
        "n_symbols",
        "n_dates",
        "present",
        (F.col("rows") - F.col("present")).alias("missing"),
        F.round(F.try_divide(F.col("present"), F.col("rows")), 6).alias("coverage"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; running them fails if a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bad = F.raise_error(F.concat_ws(" ", F.lit("duplicate key"), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, bad.cast("boolean")).otherwise(True)).drop("_n")


def quarantine(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of sound symbols, and the symbols with repeated keys and the reason."""
    bad = (
        duplicates(df, keys)
        .select("symbol")
        .distinct()
        .select("symbol", F.lit("duplicate dates in feature frame").alias("reason"))
    )
    return df.join(bad, "symbol", "left_anti"), bad


def keep_one(df: DataFrame, keys: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """First (or last) row per key in an explicit order, combined before the shuffle."""
    seq = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), seq).alias("_r"))
        .select(*keys, "_r.*")
        .select(*df.columns)
    )


def pool(frames: list[DataFrame]) -> DataFrame:
    """Union of frames over the union of their columns; absent means NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    lead = [c for c in ["symbol", "date", *OHLCV] if c in out.columns]
    return out.select(*lead, *sorted(c for c in out.columns if c not in lead))
