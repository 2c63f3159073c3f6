"""Catalogue: streaming jobs replayed over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import prediction_log as plog
from ..streaming import jobs
from . import views as v
from .catalog_sources import fresh
from .registry import query


def stream_of(spark, sf, name):
    schema = v.table(spark, sf, name).schema
    return jobs.source(spark, sf, f"{name}.parquet", schema)


def tick_stream(spark, sf):
    return stream_of(spark, sf, "events").select(
        v._flag(F.col("user_id")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("value").alias("price"),
    )


@query(
    "stream_bars",
    "symbol, time:t, open:4, high:4, low:4, close:4, volume:4",
    """SELECT * FROM (SELECT symbol, time_bucket(INTERVAL '10 minutes', ts) AS time, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2) WHERE time + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM ticks) - INTERVAL 30 MINUTE""",
)
def _(spark, sf):
    return jobs.replay(jobs.bars(tick_stream(spark, sf), "10 minutes", "30 minutes"), "stream-bars")


@query("stream_first_seen", "link, n:i", "SELECT link, 1 AS n FROM news GROUP BY link")
def _(spark, sf):
    rows = stream_of(spark, sf, "events").select(
        F.concat(F.lit("https://news/"), (F.col("event_id") % 4000).cast("string")).alias("link"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    out = jobs.replay(jobs.first_seen(rows, ["link"], "ts", "40 days"), "stream-dedup")
    return out.groupBy("link").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_trailing_counts",
    "symbol, start:t, n:i",
    """SELECT symbol, s AS start, count(*) AS n FROM (SELECT symbol, published, CAST(CAST(published AS DATE) - CAST(k AS INTEGER) AS TIMESTAMP) AS s FROM news, range(0, 5) t(k))
WHERE s + INTERVAL 5 DAY <= (SELECT max(published) FROM news) - INTERVAL 1 HOUR GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = stream_of(spark, sf, "events").select(
        v._flag(F.col("user_id")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts")
    )
    return jobs.replay(jobs.trailing_counts(rows, "ts", "5 days", "1 day", "1 hour"), "stream-counts")


@query(
    "stream_prediction_log",
    "prediction_id, symbol, as_of, data_fingerprint",
    """SELECT prediction_id, symbol, as_of, data_fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY symbol, as_of, data_fingerprint ORDER BY prediction_id) AS k
FROM forecasts WHERE is_available AND probability IS NOT NULL) WHERE k = 1""",
)
def _(spark, sf):
    from . import catalog_sources as cs

    # The same projection serves tables and streams.
    rows = cs.forecast_rows(stream_of(spark, sf, "orders"))
    path = fresh(spark, "stream-log")
    empty = spark.createDataFrame([], plog.LOG_SCHEMA)
    empty.write.json(path)
    jobs.replay_batches(rows, jobs.append_log(path), "stream-log-state")
    # A second replay of everything must add nothing.
    jobs.replay_batches(rows, jobs.append_log(path), "stream-log-state")
    return plog.read_log(spark, path)


@query(
    "stream_indicators",
    "symbol, date:d, macd:4, macd_signal:4, rsi:6",
    "SELECT m.symbol, m.date, m.macd, m.macd_signal, r.rsi FROM q_macd m JOIN q_rsi r ON r.symbol = m.symbol AND r.date = m.date",
)
def _(spark, sf):
    path = fresh(spark, "bars-for-stream")
    table = v.bars(spark, sf).select("symbol", "date", "close")
    table.write.parquet(path)
    return jobs.replay(jobs.running_indicators(jobs.source(spark, path, "*.parquet", table.schema)), "stream-indicators")


@query(
    "stream_indicators_any_order",
    "symbol, date:d, macd:4, macd_signal:4, rsi:6",
    "SELECT m.symbol, m.date, m.macd, m.macd_signal, r.rsi FROM q_macd m JOIN q_rsi r ON r.symbol = m.symbol AND r.date = m.date",
)
def _(spark, sf):
    path = fresh(spark, "bars-in-any-order")
    table = v.bars(spark, sf).select("symbol", "date", "close")
    # Files cut across the calendar and come in three micro-batches; an end marker releases what waits.
    table.repartition(6, F.xxhash64("date")).write.parquet(path)
    end = table.groupBy("symbol").agg(F.max("date").alias("date")).withColumn("close", F.lit(None).cast("double"))
    end.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.ordered_indicators(jobs.source(spark, path, "*.parquet", table.schema, 2), 36_500)
    return jobs.replay(stream, "stream-any-order").where("not late")
