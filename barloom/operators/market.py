"""Risk and market-relative features, rolling beta, regimes, macro, alpha factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from . import joins
from .joins import PAIR

REL_HORIZONS = (1, 5, 20)


def risk_block(df: DataFrame) -> DataFrame:
    """Volatility and risk of the symbol itself."""
    before = w.lag("close")
    gap = w.ratio(F.abs(F.col("open") - before), before)
    out = df.withColumns(
        {
            "_r": w.pct_change("close"),
            "_hl": w.ratio(F.col("high") - F.col("low"), "close"),
            "_gap": F.when(w.is_true(gap > 0.01), 1.0).otherwise(0.0),
        }
    )
    negative = F.when(w.is_true(F.col("_r") < 0), F.col("_r")).otherwise(0.0)
    out = out.withColumns(
        {
            "vol_20d": w.annual(w.roll_std("_r", 20)),
            "vol_60d": w.annual(w.roll_std("_r", 60)),
            "_neg2": negative * negative,
            "hl_range_20d": w.sma("_hl", 20),
            "gap_freq_20d": w.sma("_gap", 20),
            "max_dd_60d": w.max_drawdown("close", 60),
        }
    )
    out = out.withColumns(
        {
            "down_vol_20d": w.annual(F.sqrt(w.sma("_neg2", 20))),
            "vol_exp_5d": w.ratio("vol_20d", w.lag("vol_20d", 5)),
            "vol_pctile_252d": w.percentile_of_last("vol_20d", 252),
        }
    )
    return out.drop("_r", "_hl", "_gap", "_neg2")


def relative_block(df: DataFrame, bench: str, label: str, horizons=REL_HORIZONS) -> DataFrame:
    """Stock against a benchmark column, windows counted on their common days.

    Partitioning by "both present" as well as by symbol keeps the common calendar apart
    without a join back.
    """
    k = {"keys": PAIR}
    out = joins.common_rows(df, bench)
    pair = F.col("_pair")
    stage = {"_rs": w.pct_change("close", 1, **k), "_rm": w.pct_change(bench, 1, **k)}
    for n in {*horizons, 20}:
        stage[f"_s{n}"] = w.pct_change("close", n, **k)
        stage[f"_m{n}"] = w.pct_change(bench, n, **k)
    out = out.withColumns(stage)
    made = {f"rel_ret_{label}_{n}d": F.when(pair, F.col(f"_s{n}") - F.col(f"_m{n}")) for n in horizons}
    rs = w.ratio(1 + F.col("_s20"), 1 + F.col("_m20")) - 1
    made[f"rel_rs_ratio_{label}_20d"] = F.when(pair, rs)
    corr = F.when(
        F.count(F.when(F.col("_rs").isNotNull() & F.col("_rm").isNotNull(), 1)).over(w.trailing(60, **k)) == 60,
        w.correlation("_rs", "_rm", w.trailing(60, **k)),
    )
    made[f"rel_corr_{label}_60d"] = F.when(pair, corr)
    vol = w.ratio(w.roll_std("_rs", 20, **k), w.roll_std("_rm", 20, **k))
    made[f"rel_vol_ratio_{label}_20d"] = F.when(pair, vol)
    out = out.withColumns(made).drop("_pair", *stage)
    ratio = f"rel_rs_ratio_{label}_20d"
    return out.withColumn(f"rel_rs_slope_{label}_20d", w.ratio(ratio, w.lag(ratio, 5)) - 1)


def market_features(panel: DataFrame, market: DataFrame) -> DataFrame:
    out = joins.attach_series(panel, market, "_mkt")
    return relative_block(risk_block(out), "_mkt", "nifty").drop("_mkt")


def sector_features(panel: DataFrame, sector_closes: DataFrame, label: str = "sector") -> DataFrame:
    """Relative family against each symbol's own sector index ``(sector, date, close)``."""
    s = sector_closes.select("sector", "date", F.col("close").alias("_sec"))
    out = panel.join(s, ["sector", "date"], "left")
    return relative_block(out, "_sec", label).drop("_sec")


def beta_block(panel: DataFrame, market: DataFrame, n: int = 60, vol: int = 20) -> DataFrame:
    """Rolling regression of symbol on market returns over common days."""
    out = joins.common_rows(joins.attach_series(panel, market, "_mkt"), "_mkt")
    k = {"keys": PAIR}
    out = out.withColumns(
        {
            "_rs": F.when(F.col("_pair"), w.pct_change("close", 1, **k)),
            "_rm": F.when(F.col("_pair"), w.pct_change("_mkt", 1, **k)),
        }
    )
    out = out.withColumn("_both", F.col("_rs").isNotNull() & F.col("_rm").isNotNull())
    k = {"keys": ("symbol", "_both")}
    frame = w.trailing(n, **k)
    ready = F.col("_both") & (F.count("_rs").over(frame) == n)
    spread = F.var_pop("_rm").over(frame)

    def fit(c: Column) -> Column:
        return F.when(ready & (spread > 0), c.over(frame))

    out = out.withColumns(
        {
            "beta": fit(F.regr_slope("_rs", "_rm")),
            "beta_alpha": fit(F.regr_intercept("_rs", "_rm")),
            "beta_r2": F.when(F.var_pop("_rs").over(frame) > 0, fit(F.regr_r2("_rs", "_rm"))),
        }
    )
    out = out.withColumn("residual_ret", F.when(F.col("_both"), F.col("_rs") - F.col("beta") * F.col("_rm")))
    out = out.withColumn("residual_vol", w.roll_std("residual_ret", vol))
    return out.withColumn("residual_vol_pctile", w.percentile_of_last("residual_vol", 252)).drop(
        "_mkt", "_pair", "_rs", "_rm", "_both"
    )


# ---- regimes -------------------------------------------------------------------

ALONE = {"keys": ("_one",)}


def trend_regime(series: DataFrame) -> DataFrame:
    """+1 above both averages, -1 below both, 0 between, NULL in warm-up.

    A benchmark series has one row per day, so its single window partition is the
    calendar itself.
    """
    out = series.withColumn("_one", F.lit(1))
    out = out.withColumns({"_f": w.sma("close", 50, **ALONE), "_s": w.sma("close", 200, **ALONE)})
    c = F.col("close")
    known = F.col("_f").isNotNull() & F.col("_s").isNotNull()
    value = (
        F.when((c > F.col("_f")) & (c > F.col("_s")), 1.0)
        .when((c < F.col("_f")) & (c < F.col("_s")), -1.0)
        .otherwise(0.0)
    )
    return out.withColumn("regime_trend", F.when(known, value)).drop("_one", "_f", "_s")


def vol_regime(series: DataFrame) -> DataFrame:
    out = series.withColumn("_one", F.lit(1))
    out = out.withColumn("_r", w.pct_change("close", 1, **ALONE))
    out = out.withColumn("_v", w.roll_std("_r", 20, **ALONE))
    out = out.withColumn("regime_nifty_vol_pctile", w.percentile_of_last("_v", 252, **ALONE))
    p = F.col("regime_nifty_vol_pctile")
    bucket = F.when(p >= 0.7, 1.0).when(p <= 0.3, -1.0).when(p.isNotNull(), 0.0)
    return out.withColumn("regime_vol", bucket).drop("_one", "_r", "_v")


def vix_percentile(vix: DataFrame) -> DataFrame:
    out = vix.withColumn("_one", F.lit(1))
    return out.select("date", w.percentile_of_last("close", 252, **ALONE).alias("regime_vix_pctile"))


def risk_regime(market: DataFrame, vix: DataFrame) -> DataFrame:
    out = trend_regime(market).join(vix_percentile(vix), "date", "left")
    t, p = F.col("regime_trend"), F.col("regime_vix_pctile")
    value = F.when((t == 1) & (p <= 0.5), 1.0).when((t == -1) & (p > 0.5), -1.0).otherwise(0.0)
    return out.withColumn("regime_risk", F.when(t.isNotNull() & p.isNotNull(), value))


def breadth(panel: DataFrame, n: int = 20) -> DataFrame:
    """Share of all symbols above the mean of their last ``n`` calendar rows.

    Windows run over day numbers of the panel's whole calendar, so a missing day uses up
    its place without a row being made for it; a symbol without a price that day is not
    above but counts in the denominator.
    """
    days = panel.select("date").distinct().withColumn("_one", F.lit(1))
    number = F.row_number().over(w.ordered(("_one",)))
    days = days.select("date", number.alias("_day"))
    everyone = panel.agg(F.count_distinct("symbol").alias("n")).scalar()
    frame = w.Window.partitionBy("symbol").orderBy("_day").rangeBetween(-(n - 1), 0)
    above = F.col("close") > F.avg("close").over(frame)
    return (
        panel.join(days, "date")
        .withColumn("_above", above)
        .groupBy("date")
        .agg(F.count_if("_above").alias("_above"))
        .select("date", (F.col("_above") / everyone).alias("regime_breadth"))
    )


def regime_features(
    panel: DataFrame,
    market: DataFrame | None = None,
    vix: DataFrame | None = None,
    breadth_series: DataFrame | None = None,
) -> DataFrame:
    """Attach regimes classified on their own calendars; an absent source adds nothing."""
    out = panel
    if market is not None:
        table = vol_regime(market).drop("close")
        trend = risk_regime(market, vix) if vix is not None else trend_regime(market)
        out = out.join(table.join(trend.drop("close"), "date"), "date", "left")
    if breadth_series is not None:
        out = out.join(breadth_series, "date", "left")
    return out


def macro_features(panel: DataFrame, series: DataFrame, ids: list[str]) -> DataFrame:
    """Macro returns, volatility and drawdown on the symbol's calendar; a day without a
    value blanks the windows that cover it."""
    out = panel
    for sid in sorted(ids):
        one = series.where(F.col("series_id") == sid)
        out = joins.attach_series(out, one, f"_m_{sid}")
    out = out.withColumns({f"_r_{s}": w.pct_change(f"_m_{s}") for s in ids})
    made = {}
    for s in ids:
        for h in (5, 20, 60):
            made[f"mac_{s}_ret_{h}d"] = w.pct_change(f"_m_{s}", h)
        made[f"mac_{s}_vol_60d"] = w.annual(w.roll_std(f"_r_{s}", 60))
        full = F.count(f"_m_{s}").over(w.trailing(60)) == 60
        made[f"mac_{s}_dd_60d"] = F.when(full, w.max_drawdown(f"_m_{s}", 60))
    return out.withColumns(made).drop(*[f"_m_{s}" for s in ids], *[f"_r_{s}" for s in ids])


# ---- alpha factors ---------------------------------------------------------------


def _mean_of_ranks(parts: list[tuple[Column, Column]]) -> Column:
    """Mean over components present for the symbol; an unknown rank counts as 0.5."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for rank, present in parts:
        total = total + F.when(present, F.coalesce(rank, F.lit(0.5))).otherwise(0.0)
        weight = weight + F.when(present, 1.0).otherwise(0.0)
    return F.try_divide(total, weight)


def alpha_factors(panel: DataFrame, rsi: str = "rsi", rank: int = 252) -> DataFrame:
    """Momentum, mean-reversion, volatility and (given pe/pb/dividend_yield) value scores."""
    whole = w.Window.partitionBy("symbol")
    rows = F.count(F.lit(1)).over(whole)
    stage = {f"_mom{h}": w.pct_change("close", h) for h in (20, 60, 120)}
    stage["_dist"] = w.ratio("close", w.sma("close", 20)) - 1
    stage["_r"] = w.pct_change("close")
    stage["_rows"] = rows
    out = panel.withColumns(stage).withColumn("_vol", w.roll_std("_r", 60))
    value = [c for c in ("pe_ratio", "pb_ratio", "dividend_yield") if c in panel.columns]
    ranked = ["_mom20", "_mom60", "_mom120", "_dist", rsi, "_vol", *value]
    out = out.withColumns(
        {f"_k_{c}": w.percentile_of_last(c, rank) for c in ranked}
        | {f"_any_{c}": F.max(F.col(c).isNotNull()).over(whole) for c in ["_dist", rsi, *value]}
    )

    def low(c: str) -> Column:
        return 1 - F.col(f"_k_{c}")

    made = {
        "alpha_momentum": _mean_of_ranks(
            [(F.col(f"_k__mom{h}"), F.col("_rows") >= h + 1) for h in (20, 60, 120)]
        ),
        "alpha_mean_reversion": _mean_of_ranks(
            [
                (low("_dist"), F.col("_any__dist")),
                (low(rsi), F.col(f"_any_{rsi}")),
                (low("_mom20"), F.col("_rows") >= 21),
            ]
        ),
        "alpha_volatility": low("_vol"),
    }
    if value:
        made["alpha_value"] = _mean_of_ranks(
            [
                (F.col(f"_k_{c}") if c == "dividend_yield" else low(c), F.col(f"_any_{c}"))
                for c in value
            ]
        )
    out = out.withColumns(made)
    return out.drop(*[c for c in out.columns if c.startswith("_")])
