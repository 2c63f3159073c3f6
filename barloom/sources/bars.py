"""Bars: cleaning, resampling, records, CSV panels and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close"]

# Native intervals, and those built by resampling a finer one.
INTERVALS = {
    "1m": ("1 minute", None),
    "5m": ("5 minutes", None),
    "10m": ("10 minutes", "5m"),
    "20m": ("20 minutes", "5m"),
    "30m": ("30 minutes", None),
    "1h": ("1 hour", None),
}

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in [*PRICES, "volume"]],
    ]
)


def clean_ohlcv(raw: DataFrame) -> DataFrame:
    """Coerce prices to numbers, default ``adj_close`` to ``close`` and drop rows
    without a close. Column names are matched case-insensitively, spaces as ``_``."""
    named = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    numeric = [c for c in [*PRICES, "adj_close", "volume"] if c in named.columns]
    out = named.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in numeric})
    out = out.withColumns(
        {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in numeric}
    )
    if "adj_close" not in out.columns:
        out = out.withColumn("adj_close", F.col("close"))
    return out.withColumn("date", F.col("date").cast("date")).where(F.col("close").isNotNull())


def bars_from_trades(
    trades: DataFrame,
    price: str = "price",
    qty: str = "qty",
    at: str = "date",
    order: tuple[str, ...] = ("ts",),
    keys: tuple[str, ...] = ("symbol",),
) -> DataFrame:
    """OHLCV per key and time bucket ``at``; ``order`` decides first and last trade.

    A plain aggregation: every task folds its trades to one row per bar before the
    shuffle, so a symbol with a third of all trades still ships only its bars. A single
    order column keeps it a hash aggregation; tie-breakers make each task sort its input.
    """
    seq = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return (
        trades.groupBy(*keys, at)
        .agg(
            F.min_by(price, seq).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, seq).alias("close"),
            F.sum(qty).alias("volume"),
        )
        .where(F.col("close").isNotNull())
    )


def interval_bars(
    ticks: DataFrame, interval: str, price: str, qty: str | Column, order: tuple[str, ...]
) -> DataFrame:
    """Intraday bars keyed by ``(symbol, time)`` for an entry of ``INTERVALS``."""
    width, finer = INTERVALS[interval]
    if finer:
        return resample_bars(interval_bars(ticks, finer, price, qty, order), width)
    bucketed = ticks.withColumns(
        {"time": F.window("ts", width)["start"], "_qty": F.col(qty) if isinstance(qty, str) else qty}
    )
    return bars_from_trades(bucketed, price, "_qty", "time", order)


def resample_bars(bars: DataFrame, width: str) -> DataFrame:
    return (
        bars.groupBy("symbol", F.window("time", width)["start"].alias("time2"))
        .agg(
            F.min_by("open", "time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "time").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("time2", "time")
    )


def to_records(bars: DataFrame) -> DataFrame:
    """Edge records: prices at four decimals, whole volumes, ISO dates."""
    return bars.select(
        "symbol",
        F.col("date").cast("string").alias("date"),
        *[F.round(c, 4).alias(c) for c in PRICES],
        F.floor("volume").cast("bigint").alias("volume"),
    )


def record_lines(bars: DataFrame) -> DataFrame:
    return to_records(bars).select(F.to_json(F.struct("*")).alias("value"))


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType = BAR_SCHEMA) -> DataFrame:
    """CSV panel; an unreadable date fails the job instead of vanishing."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    day = F.try_to_date(F.col("date"))
    bad = F.raise_error(F.concat(F.lit("panel has an invalid date: "), F.coalesce("date", F.lit("null"))))
    return rows.withColumn("date", F.when(day.isNotNull(), day).otherwise(bad.cast("date")))


def write_panel(panel: DataFrame, path: str) -> DataFrame:
    """Write the panel partitioned by symbol plus a one-row JSON description of it."""
    panel.repartition("symbol").sortWithinPartitions("date").write.partitionBy("symbol").parquet(
        f"{path}/panel"
    )
    stored = panel.sparkSession.read.schema(panel.schema).parquet(f"{path}/panel")
    about = stored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("symbol").alias("n_symbols"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        F.lit(",".join(panel.columns)).alias("columns"),
    )
    about.coalesce(1).write.json(f"{path}/about")
    return panel.sparkSession.read.schema(about.schema).json(f"{path}/about")
