"""Join patterns of panel data: common dates, as-of, forward, interval, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# No join here carries a broadcast hint: sizes are measured at run time, and the adaptive
# planner turns a shuffled join into a broadcast one below its threshold.


def attach_series(panel: DataFrame, series: DataFrame, name: str) -> DataFrame:
    """Left join a ``(date, close)`` series; absent days stay NULL."""
    return panel.join(series.select("date", F.col("close").alias(name)), "date", "left").select(
        *panel.columns, name
    )


def common_rows(panel: DataFrame, other: str, x: str = "close") -> DataFrame:
    """Mark rows where both values exist; ``_pair`` partitions windows over them alone."""
    return panel.withColumn("_pair", F.col(x).isNotNull() & F.col(other).isNotNull())


PAIR = ("symbol", "_pair")


def align(series: DataFrame, ids: list[str]) -> DataFrame:
    """Full outer alignment of series on date, one column per id."""
    return series.groupBy("date").pivot("series_id", ids).agg(F.max("close"))


def alignment_report(wide: DataFrame, ids: list[str]) -> DataFrame:
    complete = F.lit(True)
    for i in ids:
        complete = complete & F.col(i).isNotNull()
    one = wide.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(complete).alias("complete_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *[F.count(i).alias(i) for i in ids],
    )
    return one.unpivot(["rows", "complete_rows", "first_date", "last_date"], ids, "series_id", "present")


def as_of(
    panel: DataFrame, snapshots: DataFrame, fields: list[str], at: str = "available_at", seq: str | None = None
) -> DataFrame:
    """Newest snapshot known on each panel day, by symbol.

    The newest snapshot counts even where its value is NULL; among snapshots of one day
    the highest ``seq`` wins. Snapshots are first reduced to one per symbol and day
    (combined before the shuffle), then merged with the panel in one sorted pass. Both
    sides hold at most one row per symbol and day.
    """
    order = F.struct(F.col(seq)) if seq else F.struct(*[F.col(f).isNotNull() for f in fields], *fields)
    daily = (
        snapshots.where(F.col(at).isNotNull())
        .groupBy("symbol", F.col(at).cast("date").alias("date"))
        .agg(F.max_by(F.struct(*fields), order).alias("_snap"))
        .withColumn("_row", F.lit(None).cast(panel.select(F.struct(*panel.columns)).schema[0].dataType))
    )
    rows = panel.select(
        "symbol", "date", F.lit(None).cast(daily.schema["_snap"].dataType).alias("_snap"), F.struct(*panel.columns).alias("_row")
    )
    merged = rows.unionByName(daily)
    # A snapshot of the same day comes before the panel row.
    spec = (
        Window.partitionBy("symbol")
        .orderBy("date", F.col("_row").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    known = F.last("_snap", ignorenulls=True).over(spec)
    return (
        merged.withColumn("_known", known)
        .where(F.col("_row").isNotNull())
        .select("_row.*", *[F.col(f"_known.{f}").alias(f) for f in fields])
    )


def default_visibility(snapshots: DataFrame, panel: DataFrame, at: str = "available_at") -> DataFrame:
    """A snapshot without a date becomes visible on the symbol's last bar."""
    last = panel.groupBy("symbol").agg(F.max("date").alias("_last"))
    return snapshots.join(last, "symbol").withColumn(at, F.coalesce(at, "_last")).drop("_last")


def interval_sector(panel: DataFrame, mapping: DataFrame, field: str = "sector") -> DataFrame:
    """Valid mapping row per symbol and day; a later ``valid_from`` overrides.

    The join runs on symbol; overlapping validity windows are resolved by an aggregation
    that keeps one struct per panel row.
    """
    m = mapping.select(
        F.col("symbol").alias("_s"), "valid_from", "valid_to", F.col(field).alias("_f")
    )
    d = F.col("date")
    hit = (
        (F.col("symbol") == F.col("_s"))
        & (F.col("valid_from").isNull() | (d >= F.col("valid_from")))
        & (F.col("valid_to").isNull() | (d <= F.col("valid_to")))
    )
    base = panel.drop(field)
    rest = [c for c in base.columns if c not in ("symbol", "date")]
    pick = F.max_by(
        F.struct("_f"), F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), F.col("_f"))
    )
    return (
        base.join(m, hit, "left")
        .groupBy("symbol", "date")
        .agg(F.any_value(F.struct(*rest)).alias("_r"), pick.alias("_p"))
        .select("symbol", "date", "_r.*", F.col("_p._f").alias(field))
    )


def static_sector(panel: DataFrame, mapping: DataFrame, field: str = "sector") -> DataFrame:
    return panel.drop(field).join(mapping.select("symbol", field), "symbol", "left")


def dated_sector(panel: DataFrame, mapping: DataFrame, order: Column, field: str = "sector") -> DataFrame:
    """Exact-date mapping, the last row of a repeated key wins."""
    one = mapping.groupBy("symbol", "date").agg(F.max_by(field, order).alias(field))
    return panel.drop(field).join(one, ["symbol", "date"], "left")


def matched_sample(reference: DataFrame, candidates: dict[str, DataFrame], prob: str = "prob") -> DataFrame:
    """Rows where the reference and every candidate have a probability, one per key.

    Each side is averaged to one row per key first, so the join can never multiply rows.
    """
    out = reference
    for name, df in candidates.items():
        one = df.groupBy("symbol", "date").agg(F.avg(prob).alias(name)).where(F.col(name).isNotNull())
        out = out.join(one, ["symbol", "date"])
    return out


def forward_outcome(predictions: DataFrame, bars: DataFrame, horizon: int = 20) -> DataFrame:
    """Realised outcome: entry at the first bar on or after ``as_of``, exit ``horizon``
    rows later; NULL while the history is too short.

    The next bar day is found once per distinct (symbol, as_of) by a sorted merge; the
    predictions themselves only take part in equi-joins.
    """
    own = Window.partitionBy("symbol").orderBy("date")
    ready = bars.where(F.col("close").isNotNull()).select(
        "symbol",
        "date",
        F.col("close").alias("bar_close"),
        F.lead("close", horizon).over(own).alias("exit_close"),
        F.lead("date", horizon).over(own).alias("exit_date"),
    )
    days = predictions.select("symbol", F.col("as_of").cast("date").alias("date")).distinct()
    info = F.struct("date", "bar_close", "exit_close", "exit_date")
    merged = ready.select("symbol", "date", info.alias("_bar"), F.lit(0).alias("_ask")).unionByName(
        days.select("symbol", "date", F.lit(1).alias("_ask")), allowMissingColumns=True
    )
    ahead = (
        Window.partitionBy("symbol")
        .orderBy("date", F.desc("_ask"))
        .rowsBetween(0, Window.unboundedFollowing)
    )
    found = (
        merged.withColumn("_next", F.first("_bar", ignorenulls=True).over(ahead))
        .where("_ask = 1")
        .select(
            F.col("symbol").alias("_s"),
            F.col("date").alias("_d"),
            F.col("_next.bar_close").alias("bar_close"),
            F.col("_next.exit_close").alias("exit_close"),
            F.col("_next.exit_date").alias("exit_date"),
        )
    )
    day = F.col("as_of").cast("date")
    joined = predictions.join(
        found, (F.col("symbol") == F.col("_s")) & (day == F.col("_d")), "left"
    ).drop("_s", "_d")
    entry = F.coalesce("close", "bar_close")
    ret = F.try_divide(F.col("exit_close"), entry) - 1
    done = F.col("exit_close").isNotNull() & (entry != 0)
    return joined.withColumns(
        {
            "entry_close": F.when(done, F.round(entry, 4)),
            "realised_return": F.when(done, F.round(ret, 6)),
            "label_up": F.when(done, ret > 0),
            "scored": F.coalesce(done, F.lit(False)),
        }
    ).drop("bar_close")


def latest_card(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per symbol from its latest quote, indicators, fundamentals and so on."""
    names = list(parts)
    out = parts[names[0]]
    for name in names[1:]:
        out = out.join(parts[name], "symbol", "left")
    return out
