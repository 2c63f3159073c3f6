"""Structured Streaming forms of bars, dedup, event counts, the prediction log and
running indicators."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder
from ..sources import prediction_log as plog


def source(spark: SparkSession, folder: str, file_glob: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream over a folder; each new file is read once, at most ``files_per_batch`` in a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def bars(ticks: DataFrame, width: str, delay: str, price: str = "price", order=("ts", "event_id")) -> DataFrame:
    """Tumbling OHLCV bars, emitted once their window is behind the watermark."""
    seq = F.struct(*order)
    out = (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", width))
        .agg(
            F.min_by(price, seq).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, seq).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )
    return out.select("symbol", F.col("window.start").alias("time"), "open", "high", "low", "close", "volume")


def first_seen(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """First arrival per key; a key is remembered for ``delay`` of event time."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def trailing_counts(rows: DataFrame, at: str, window: str, slide: str, delay: str) -> DataFrame:
    """Sliding event counts per symbol."""
    out = rows.withWatermark(at, delay).groupBy("symbol", F.window(at, window, slide)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def append_log(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that adds only unseen predictions, so a replayed batch
    changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        plog.append(batch, path)

    return write


STATE = "n long, day date, close double, ema12 double, ema26 double, signal double, gain double, loss double"
OUTPUT = "symbol string, date date, close double, macd double, macd_signal double, rsi double"


def _step(means: list, closes: Iterator[float]) -> list[tuple]:
    """The recursive means carried over closes in order; ``means`` (n, last, e12, e26, signal, gain, loss) is updated."""
    n, last, e12, e26, sig, gain, loss = means
    out = []
    for close in closes:
        step = close - last if n else 0.0
        up, down = max(step, 0.0), max(-step, 0.0)
        if n == 0:
            e12 = e26 = close
            gain, loss = up, down
        else:
            e12 += (close - e12) * 2 / 13
            e26 += (close - e26) * 2 / 27
            gain += (up - gain) / 14
            loss += (down - loss) / 14
        macd = e12 - e26
        sig = macd if n == 0 else sig + (macd - sig) * 2 / 10
        out.append((macd, sig, 100 - 100 / (1 + gain / loss) if loss > 0 else None))
        n, last = n + 1, close
    means[:] = n, last, e12, e26, sig, gain, loss
    return out


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Carry the recursive means of one symbol over the rows of a micro-batch.

    The means depend on the order of dates. A batch is sorted; one that brings a date the state
    has passed already fails, for its values could only be wrong.
    """
    rows = pd.concat(list(batches)).sort_values("date")
    n, day, last, e12, e26, sig, gain, loss = state.get if state.exists else (0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    if day is not None and rows["date"].iloc[0] <= day:
        raise ValueError(f"{key[0]}: bar of {rows['date'].iloc[0]} after that of {day}")
    means = [n, last, e12, e26, sig, gain, loss]
    out = _step(means, rows["close"])
    n, last, e12, e26, sig, gain, loss = means
    state.update((n, rows["date"].iloc[-1], last, e12, e26, sig, gain, loss))
    made = pd.DataFrame(out, columns=["macd", "macd_signal", "rsi"], index=rows.index)
    yield pd.concat([rows[["symbol", "date", "close"]], made], axis=1)


def running_indicators(bar_stream: DataFrame) -> DataFrame:
    """MACD and RSI with a few numbers of state per symbol. A micro-batch brings a symbol's
    new bars, so its size is the trigger's, not the history's. Bars have to come in order of
    dates, batch by batch; a late bar stops the stream."""
    return (
        bar_stream.select("symbol", "date", "close")
        .groupBy("symbol")
        .applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


HELD = f"{STATE}, days array<date>, closes array<double>, clock date"
ORDERED = f"{OUTPUT}, late boolean"


def ordered_indicators(bar_stream: DataFrame, lateness_days: int) -> DataFrame:
    """MACD and RSI of bars that arrive in any order, released behind each symbol's own clock.

    A symbol's clock is its latest date less ``lateness_days``; bars wait in the state until the clock has
    passed them and are then taken in order of dates, so any order of arrival within the lateness gives what
    the ordered history gives. A bar whose date has been released already comes out at once with ``late`` true
    and no values; nothing fails. Of several waiting bars of one date the last to arrive counts, the others are
    late. A row without a close only moves the clock, to its date as it stands: an end marker releases what waits.
    The state holds the bars of the last ``lateness_days``, and a few numbers.
    """
    wait = dt.timedelta(days=lateness_days)

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, day, last, e12, e26, sig, gain, loss, days, closes, clock = state.get if state.exists else (0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, [], [], None)
        waiting = dict(zip(days, closes, strict=True))
        late = []
        for rows in batches:
            for date, close in zip(rows["date"], rows["close"], strict=True):
                mark = date if pd.isna(close) else date - wait
                if not pd.isna(close):
                    if day is not None and date <= day:
                        late.append((date, close))
                    else:
                        if date in waiting:
                            late.append((date, waiting[date]))
                        waiting[date] = float(close)
                clock = mark if clock is None else max(clock, mark)
        ready = sorted(d for d in waiting if clock is not None and d <= clock)
        means = [n, last, e12, e26, sig, gain, loss]
        values = [waiting.pop(d) for d in ready]
        made = [(key[0], d, c, *v, False) for d, c, v in zip(ready, values, _step(means, values), strict=True)]
        made += [(key[0], d, c, None, None, None, True) for d, c in late]
        left = sorted(waiting)
        n, last, *rest = means
        state.update((n, ready[-1] if ready else day, last, *rest, left, [waiting[d] for d in left], clock))
        yield pd.DataFrame(made, columns=["symbol", "date", "close", "macd", "macd_signal", "rsi", "late"])

    return (
        bar_stream.select("symbol", "date", "close")
        .groupBy("symbol")
        .applyInPandasWithState(advance, ORDERED, HELD, "append", GroupStateTimeout.NoTimeout)
    )


def replay(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into a file sink and return what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    job = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def replay_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], label: str) -> None:
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    job = stream.writeStream.foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start()
    job.awaitTermination()
