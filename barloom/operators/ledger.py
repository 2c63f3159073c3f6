"""Backtest ledger: staggered positions marked to market without a row loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from . import metrics

# Default costs per side.
BROKERAGE, FEE_PERCENT, SLIPPAGE_BPS = 20.0, 0.01, 10.0
ANNUAL_DAYS = 252


def side_cost(price, brokerage=BROKERAGE, fee=FEE_PERCENT, bps=SLIPPAGE_BPS) -> Column:
    p = w.col(price)
    one = F.try_divide(brokerage + (fee / 100.0) * p + (bps / 10000.0) * p, p)
    return F.when(p > 0, one)


def round_trip(entry, exit_price=None, **costs) -> Column:
    return side_cost(entry, **costs) + side_cost(entry if exit_price is None else exit_price, **costs)


def first_signals(signals: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Non-zero signals, the first per key and date."""
    live = signals.where(F.col("direction").isNotNull() & (F.col("direction") != 0))
    seq = F.struct(*order)
    return live.groupBy(*keys, "date").agg(F.min_by("direction", seq).alias("direction"))


def book(
    bars: DataFrame, signals: DataFrame, horizon: int, capital: float, keys=("symbol",), costs: dict | None = None
) -> DataFrame:
    """One row per bar with the position opened there, if any.

    A signal is admitted when its bar exists, ``horizon`` more bars follow and the entry
    price is positive. Keys may include a model; bars then repeat per model.
    """
    keys = list(keys)
    spec = Window.partitionBy(*keys).orderBy("date")
    out = bars.where(F.col("close").isNotNull()).join(
        signals.select(*keys, "date", F.col("direction").cast("double").alias("direction")),
        [*keys, "date"],
        "left",
    )
    size = capital / max(int(horizon), 1)
    out = out.withColumns(
        {"exit": F.lead("close", horizon).over(spec), "exit_date": F.lead("date", horizon).over(spec)}
    )
    ok = (
        F.coalesce(F.col("direction") != 0, F.lit(False))
        & F.col("exit_date").isNotNull()
        & (F.col("close") > 0)
    )
    cost = size * round_trip("close", **(costs or {}))
    d = F.col("direction")
    ret = F.try_divide(F.col("exit"), F.col("close")) - 1
    return out.withColumn("open_pos", ok).withColumns(
        {
            "direction": F.when(ok, d),
            "notional": F.when(ok, F.lit(size)),
            "cost": F.when(ok, cost),
            "ret": F.when(ok, ret),
            "pl": F.when(ok, d * size * ret - cost),
        }
    )


def trades(ledger: DataFrame, keys=("symbol",)) -> DataFrame:
    return ledger.where("open_pos").select(
        *keys,
        F.col("date").alias("entry_date"),
        "exit_date",
        "direction",
        F.col("close").alias("entry"),
        "exit",
        "notional",
        "cost",
        "ret",
        "pl",
    )


def equity(ledger: DataFrame, horizon: int, capital: float, keys=("symbol",)) -> DataFrame:
    """Mark-to-market equity per bar.

    Cash paid and received so far are running sums; open positions are the sum of shares
    opened in the last ``horizon`` rows at today's price.
    """
    spec = Window.partitionBy(*keys).orderBy("date")
    so_far = spec.rowsBetween(Window.unboundedPreceding, 0)
    alive = spec.rowsBetween(-(horizon - 1), 0)
    shares = F.coalesce(F.col("direction") * F.col("notional") / F.col("close"), F.lit(0.0))
    out = ledger.withColumns(
        {
            "_shares": shares,
            "_paid": F.coalesce(F.col("direction") * F.col("notional") + F.col("cost"), F.lit(0.0)),
        }
    )
    # Shares opened ``horizon`` rows ago are settled at today's close.
    out = out.withColumn(
        "_settled", F.coalesce(F.lag("_shares", horizon).over(spec), F.lit(0.0)) * F.col("close")
    )
    cash = capital - F.sum("_paid").over(so_far) + F.sum("_settled").over(so_far)
    marked = F.sum("_shares").over(alive) * F.col("close")
    n_open = F.sum(F.col("open_pos").cast("int")).over(alive)
    return out.withColumns(
        {
            "equity": cash + marked,
            "concurrent": n_open,
            "committed": n_open * F.lit(capital / max(horizon, 1)),
        }
    ).drop("_shares", "_paid", "_settled")


def leverage_check(curve: DataFrame, horizon: int, capital: float, keys=("symbol",)) -> DataFrame:
    return curve.groupBy(*keys).agg(
        F.max("concurrent").alias("max_concurrent"),
        (
            (F.max("concurrent") <= max(int(horizon), 1)) & (F.max("committed") <= capital + 1e-6)
        ).alias("no_leverage_ok"),
    )


def require_no_leverage(curve: DataFrame, capital: float) -> DataFrame:
    bad = F.raise_error(F.lit("committed notional exceeds capital")).cast("boolean")
    return curve.where(F.when(F.col("committed") > capital + 1e-6, bad).otherwise(True))


def equity_metrics(curve: DataFrame, keys=("symbol",), value: str = "equity") -> DataFrame:
    """Return, drawdown and risk ratios of an equity curve per key."""
    keys = list(keys)
    spec = Window.partitionBy(*keys).orderBy("date")
    e = F.col(value)
    out = curve.where(e.isNotNull()).withColumns(
        {
            "_day": F.try_divide(e, F.lag(value).over(spec)) - 1,
            "_peak": F.max(value).over(spec.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    day = F.col("_day")
    agg = out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min_by(value, "date").alias("_first"),
        F.max_by(value, "date").alias("_last"),
        F.min(F.try_divide(e, F.col("_peak")) - 1).alias("max_dd"),
        F.avg(day).alias("avg_daily_return"),
        F.stddev_pop(day).alias("_std"),
        F.coalesce(F.stddev_pop(F.when(day < 0, day)), F.lit(0.0)).alias("_down"),
    )
    ok = (F.col("n_days") >= 2) & (F.col("_first") > 0)
    root = ANNUAL_DAYS**0.5
    mean = F.col("avg_daily_return")
    cum = F.col("_last") / F.col("_first") - 1
    agg = agg.withColumn("cum_return", F.when(ok, cum))
    annual = F.pow(1 + F.col("cum_return"), ANNUAL_DAYS / F.greatest(F.col("n_days") - 1, F.lit(1))) - 1
    agg = agg.withColumns(
        {
            "max_dd": F.when(ok, F.col("max_dd")),
            "sharpe": F.when(ok & (F.col("_std") > 0), mean / F.col("_std") * root),
            "sortino": F.when(ok & (F.col("_down") > 0), mean / F.col("_down") * root),
            "annualized_return": F.when(ok & (F.col("cum_return") > -1), annual),
            "annualized_volatility": F.when(ok, F.col("_std") * root),
        }
    )
    return agg.withColumn(
        "calmar", F.when(F.col("max_dd") < 0, F.col("annualized_return") / F.abs("max_dd"))
    ).drop("_first", "_last", "_std", "_down")


def strategy_metrics(
    bars: DataFrame, signals: DataFrame, horizon: int, capital: float, keys=("symbol",), costs: dict | None = None
) -> DataFrame:
    """Ledger, trade and classification metrics of one row per key and date signals.

    The curve starts at each key's first signal. Signals may carry ``p``, ``y`` and
    ``ret`` for the classification part.
    """
    keys = list(keys)
    known = signals.where(F.col("direction").isNotNull())
    start = known.groupBy(*keys).agg(F.min("date").alias("_start"))
    common = [k for k in keys if k in bars.columns]
    window = bars.join(start, common).where(F.col("date") >= F.col("_start")).select(
        *keys, "date", "close"
    )
    ledger = book(window, known, horizon, capital, keys, costs)
    curve = equity(ledger, horizon, capital, keys)
    out = equity_metrics(curve, keys).join(leverage_check(curve, horizon, capital, keys), keys)
    out = out.join(metrics.trade_metrics(trades(ledger, keys), keys), keys, "left")
    out = out.withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))
    if "ret" in signals.columns:
        active = (F.col("direction") != 0) & F.col("ret").isNotNull()
        hit = F.avg(F.when(active, (F.col("ret") * F.col("direction") > 0).cast("double")))
        out = out.join(known.groupBy(*keys).agg(hit.alias("trade_accuracy")), keys, "left")
    if {"p", "y"} <= set(signals.columns):
        fired = F.when(F.col("direction") > 0, 1).otherwise(0)
        y = F.col("y")
        seen = known.where(F.col("p").isNotNull() & y.isNotNull())
        tp, fp = F.count_if((fired == 1) & (y == 1)), F.count_if((fired == 1) & (y == 0))
        fn, tn = F.count_if((fired == 0) & (y == 1)), F.count_if((fired == 0) & (y == 0))
        cls = seen.groupBy(*keys).agg(
            F.try_divide((tp + tn).cast("double"), F.count(F.lit(1))).alias("accuracy"),
            F.try_divide(tp.cast("double"), tp + fp).alias("precision"),
            F.try_divide(tp.cast("double"), tp + fn).alias("recall"),
            F.avg(F.pow(F.col("p") - y, 2)).alias("calibration_brier"),
        )
        area = metrics.auc_of_levels(metrics.levels(seen, keys), keys).withColumnRenamed("auc", "roc_auc")
        out = out.join(cls, keys, "left").join(area, keys, "left")
    return out


def buy_and_hold(bars: DataFrame, horizon: int, capital: float, keys=("symbol",)) -> DataFrame:
    """One long position over the whole window, and the hit rate of forward windows."""
    keys = list(keys)
    spec = Window.partitionBy(*keys).orderBy("date")
    rows = bars.where(F.col("close").isNotNull()).withColumns(
        {
            "equity": capital * F.try_divide(F.col("close"), F.first("close").over(spec)),
            "_ahead": F.try_divide(F.lead("close", horizon).over(spec), F.col("close")) - 1,
        }
    )
    hits = rows.groupBy(*keys).agg(F.avg((F.col("_ahead") > 0).cast("double")).alias("accuracy"))
    return equity_metrics(rows, keys).join(hits, keys)
