"""News-tone timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TONE_SCALE = 0.01  # fixed value


def daily_tone(segments: DataFrame) -> DataFrame:
    """``(symbol, segment, points array<struct<date,value>>)`` to one tone per day.

    Points with an unreadable date or value are ignored and a later segment wins.
    """
    points = segments.select("symbol", "segment", F.posexplode("points").alias("pos", "p"))
    return (
        points.select(
            "symbol",
            "segment",
            "pos",
            F.try_to_date(F.col("p.date")).alias("date"),
            (F.expr("try_cast(p.value AS double)") * TONE_SCALE).alias("tone"),
        )
        .where(F.col("date").isNotNull() & F.col("tone").isNotNull())
        .groupBy("symbol", "date")
        .agg(F.max_by("tone", F.struct("segment", "pos")).alias("tone"))
    )


def tone_coverage(tone: DataFrame, trading_days: DataFrame) -> DataFrame:
    """Coverage of the trading calendar ``(symbol, date)`` by tone days."""
    joined = trading_days.join(tone, ["symbol", "date"], "left")
    has = F.col("tone").isNotNull()
    day = F.when(has, F.col("date"))
    return joined.groupBy("symbol").agg(
        F.count_if(has).alias("n_days_with_news"),
        F.count(F.lit(1)).alias("n_trading_days"),
        (100 * F.count_if(has) / F.count(F.lit(1))).alias("coverage_pct"),
        F.min(day).alias("first_news_day"),
        F.max(day).alias("last_news_day"),
        F.countDistinct("tone").alias("n_distinct"),
        F.min("tone").alias("tone_min"),
        F.max("tone").alias("tone_max"),
        F.avg("tone").alias("tone_mean"),
    )


def tone_articles(tone: DataFrame) -> DataFrame:
    """One article per toned day, published at 00:00 UTC."""
    t = F.col("tone")
    return tone.select(
        "symbol",
        F.concat("symbol", F.lit(" daily news tone")).alias("title"),
        F.col("date").cast("timestamp_ntz").alias("published_utc"),
        F.round(t, 4).alias("score"),
        F.when(t > 0, "pos").when(t < 0, "neg").otherwise("neutral").alias("label"),
    )
