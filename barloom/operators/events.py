"""Point-in-time events, sentiment and option features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.scalar import call_greeks

# Market close on the local clock, and the clock's offset from UTC.
CUTOFF_SECONDS = 15 * 3600 + 30 * 60
LOCAL_OFFSET = "INTERVAL 5 HOURS 30 MINUTES"


def local_time(utc) -> Column:
    """Local wall clock of a UTC instant."""
    return w.col(utc).cast("timestamp_ntz") + F.expr(LOCAL_OFFSET)


def effective_day(local: Column, explicit: Column | None = None, strict: bool = False) -> Column:
    """First day an event may be used: its own day up to the close, else the next.

    With ``strict`` an event without any time stops the job instead of being NULL. Use
    it on raw events only: the check may run before later filters.
    """
    day = local.cast("date")
    late = (
        F.hour(local) * 3600 + F.minute(local) * 60 + F.date_part(F.lit("SECOND"), local).cast("double")
        > CUTOFF_SECONDS
    )
    known = F.date_add(day, F.when(late, 1).otherwise(0))
    if explicit is not None:
        known = F.coalesce(explicit.cast("date"), known)
    if not strict:
        return known
    missing = F.raise_error(F.lit("event carries no timestamp and no effective date"))
    return F.coalesce(known, missing.cast("date"))


def visible(events: DataFrame, as_of) -> DataFrame:
    return events.where(F.col("effective_date") <= F.lit(as_of).cast("date"))


def _calendar(panel: DataFrame, daily: DataFrame, fields: list[str], pad: int) -> DataFrame:
    """Panel days and daily event rows of the padded period in one table; ``_bar`` tells
    them apart. Both are one row per symbol and day."""
    span = panel.groupBy("symbol").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    inside = (
        daily.join(span, "symbol")
        .where((F.col("date") >= F.date_sub("_lo", pad)) & (F.col("date") <= F.col("_hi")))
        .select("symbol", "date", *fields, F.lit(0).alias("_bar"))
    )
    return panel.select("symbol", "date", F.lit(1).alias("_bar")).unionByName(inside, allowMissingColumns=True)


def event_features(panel: DataFrame, events: DataFrame, window: int = 5) -> DataFrame:
    """Events that became effective since ``window`` trading rows ago, and since the
    previous row. ``events`` needs ``symbol`` and ``effective_date``."""
    daily = events.groupBy("symbol", F.col("effective_date").alias("date")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    rows = _calendar(panel, daily, ["_n"], window)
    upto = Window.partitionBy("symbol").orderBy("date", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    bars = rows.withColumn("_cum", F.coalesce(F.sum("_n").over(upto), F.lit(0))).where("_bar = 1")
    own = Window.partitionBy("symbol").orderBy("date")
    made = bars.select(
        "symbol",
        "date",
        (F.col("_cum") - F.lag("_cum", window, 0).over(own)).alias(f"event_count_{window}d"),
        (F.col("_cum") > F.lag("_cum", 1, 0).over(own)).cast("int").alias("event_today"),
    )
    return panel.join(made, ["symbol", "date"])


def sentiment_features(panel: DataFrame, articles: DataFrame, window: int = 5) -> DataFrame:
    """Calendar-day sentiment windows. ``articles``: symbol, effective_date, score.

    Articles are folded to one row per symbol and day before anything is joined; the
    window then runs over day numbers, so no empty calendar days are generated.
    """
    s = F.col("score")
    daily = articles.groupBy("symbol", F.col("effective_date").alias("date")).agg(
        F.avg(s).alias("_mean"),
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.count_if(s > 0).cast("double").alias("_pos"),
    )
    rows = _calendar(panel, daily, ["_mean", "_n", "_pos"], window).withColumn(
        "_day", F.unix_date("date")
    )
    frame = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-(window - 1), 0)
    today = Window.partitionBy("symbol").orderBy("_day").rangeBetween(0, 0)
    count = F.coalesce(F.sum("_n").over(frame), F.lit(0.0))
    made = (
        rows.withColumns(
            {
                f"sent_score_{window}d": F.avg("_mean").over(frame),
                f"sent_count_{window}d": count,
                f"sent_pos_ratio_{window}d": F.try_divide(F.sum("_pos").over(frame), count),
                "sent_recent": F.max("_mean").over(today),
            }
        )
        .where("_bar = 1")
        .drop("_bar", "_day", "_mean", "_n", "_pos")
    )
    return panel.join(made, ["symbol", "date"])


def chain_metrics(chains: DataFrame, spots: DataFrame, days_to_expiry: int | None = None) -> DataFrame:
    """Put/call open interest, total interest and at-the-money volatility per chain.

    ``chains``: symbol, as_of, side, strike, open_interest, implied_vol, pos. On equal
    distance calls come before puts, then the given order. Greeks need an expiry.
    """
    quotes = chains.dropna(subset=["strike", "open_interest", "implied_vol"]).join(
        spots.select("symbol", "as_of", "spot"), ["symbol", "as_of"]
    )
    oi = F.col("open_interest")
    call, put = F.col("side") == "call", F.col("side") == "put"
    near = F.struct(
        F.abs(F.col("strike") - F.col("spot")), F.when(call, 0).otherwise(1), F.col("pos")
    )
    out = quotes.groupBy("symbol", "as_of").agg(
        F.sum(F.when(call, oi)).alias("_call"),
        F.sum(F.when(put, oi)).alias("_put"),
        F.sum(oi).alias("total_oi"),
        F.min_by(F.struct("implied_vol", "strike"), near).alias("_atm"),
        F.any_value("spot").alias("spot"),
    )
    out = out.select(
        "symbol",
        "as_of",
        "spot",
        F.when(F.col("_call") > 0, F.col("_put") / F.col("_call")).alias("pcr"),
        "total_oi",
        F.col("_atm.implied_vol").alias("atm_iv"),
        F.col("_atm.strike").alias("atm_strike"),
    )
    if days_to_expiry is None:
        return out
    return call_greeks(out, "spot", "atm_strike", max(days_to_expiry, 1) / 365.0, "atm_iv")
