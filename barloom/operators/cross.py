"""Cross-sectional operators: ranks, peers, sectors, universe, relative features.

A cross-section is the set of symbols of one day (and sector). Its windows hold one row
per listed symbol, and only scalars are kept per group, never arrays of its members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from . import joins, quality

MIN_GROUP = 3  # fixed value


def midrank(value: str, groups: list[str], min_size: int = MIN_GROUP) -> Column:
    """Average-tie percentile in the group; NULL for thin groups and NULL values.

    The average rank is the mean of the rank and of the rows up to the value, both on the
    same sort.
    """
    x = F.col(value)
    known = Window.partitionBy(*groups, x.isNotNull())
    by_value = known.orderBy(x)
    upto = F.count(x).over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.count(x).over(known)
    ok = x.isNotNull() & (size >= min_size)
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    return F.when(ok, (F.rank().over(by_value) + upto) / 2.0 / size)


def peer_rank(value: str, groups: list[str], min_size: int = MIN_GROUP) -> Column:
    """Rank against the other members, own row in the denominator. With at least one
    peer this equals the midrank of the group."""
    return midrank(value, groups, max(min_size, 2))


def loo_median_divergence(df: DataFrame, value: str, groups: list[str], name: str, min_size: int = MIN_GROUP) -> DataFrame:
    """Value minus the median of the other members of its group.

    Leaving one member out of ``n`` sorted values only ever selects among the three
    values around the middle, so three scalars per group are enough.
    """
    x = F.col(value)
    whole = Window.partitionBy(*groups, x.isNotNull())
    out = df.withColumns(
        {
            "_pos": F.row_number().over(whole.orderBy(x, "symbol")) - 1,
            "_n": F.count(x).over(whole),
        }
    )
    low = F.floor((F.col("_n") - 2) / 2)
    high = F.floor((F.col("_n") - 1) / 2)
    out = out.withColumns({"_low": low, "_high": high})
    out = out.withColumns(
        {f"_s{i}": F.max(F.when(F.col("_pos") == F.col("_low") + i, x)).over(whole) for i in range(3)}
    )

    def kept(k: Column) -> Column:
        at = k + F.when(k < F.col("_pos"), 0).otherwise(1) - F.col("_low")
        return F.when(at == 0, F.col("_s0")).when(at == 1, F.col("_s1")).otherwise(F.col("_s2"))

    median = (kept(F.col("_low")) + kept(F.col("_high"))) / 2
    ok = x.isNotNull() & (F.col("_n") >= max(min_size, 2))
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    return out.withColumn(name, F.when(ok, x - median)).drop("_pos", "_n", "_low", "_high", "_s0", "_s1", "_s2")


def group_mean(value: str, groups: list[str], min_size: int = MIN_GROUP) -> Column:
    spec = Window.partitionBy(*groups)
    ok = F.count(value).over(spec) >= min_size
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    return F.when(ok, F.avg(value).over(spec))


def compounded_rank(panel: DataFrame, n: int = 20) -> DataFrame:
    """Percentile rank per day of the return compounded over ``n`` rows."""
    out = panel.withColumn("_g", F.log1p(w.pct_change("close")))
    out = out.withColumn("cum_ret", F.expm1(w.roll_sum("_g", n))).drop("_g")
    return out.withColumn("cs_rank", midrank("cum_ret", ["date"], 1))


def universe_block(panel: DataFrame, horizons=(10, 20, 60)) -> DataFrame:
    """Symbol against an equal-weight universe that it is a member of.

    Universe returns step over the shared calendar (``h`` days with any trade), the
    symbol's own over its rows; the symbol ranks against the universe including its own
    entry there.
    """
    days = panel.select("date").distinct().withColumn("_one", F.lit(1))
    days = days.withColumn("_day", F.row_number().over(Window.partitionBy("_one").orderBy("date"))).drop("_one")
    out = panel.join(days, "date")
    by_day = Window.partitionBy("date")
    out = out.withColumn(
        "cs_rs_ratio_20d", w.ratio("close", F.avg("close").over(by_day)) - 1
    )
    for h in horizons:
        back = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-h, -h)
        out = out.withColumns(
            {
                f"_t{h}": w.pct_change("close", h),
                f"_u{h}": w.ratio("close", F.first("close").over(back)) - 1,
            }
        )
    keep = ["symbol", "date"]
    for h in horizons:
        t, u = f"_t{h}", f"_u{h}"
        out = out.withColumn(f"cs_rel_ret_vs_median_{h}d", F.col(t) - F.median(u).over(by_day))
        # Values of both roles meet per day; ranks count universe entries only.
        both = out.select(
            *keep,
            F.inline(
                F.array(
                    F.struct(F.col(t).alias("_x"), F.lit(0).alias("_uni")),
                    F.struct(F.col(u).alias("_x"), F.lit(1).alias("_uni")),
                )
            ),
        ).where(F.col("_x").isNotNull())
        upto = Window.partitionBy("date").orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
        ties = F.sum("_uni").over(Window.partitionBy("date", "_x"))
        less = F.sum("_uni").over(upto) - ties
        size = F.sum("_uni").over(by_day) + 1
        ranked = (
            both.withColumn(f"cs_mom_rank_{h}d", (less + (ties + 2) / 2.0) / size)
            .where("_uni = 0")
            .select(*keep, f"cs_mom_rank_{h}d")
        )
        out = out.join(ranked, keep, "left")
    return out.drop("_day", *[f"_{k}{h}" for k in "tu" for h in horizons])


RELATIVE = [
    "market_excess_return", "market_relative_strength", "sector_return", "sector_excess_return",
    "cross_sectional_return_rank", "sector_return_rank", "peer_return_rank", "peer_median_divergence",
]


def relative_columns(horizons=(1, 5, 20)) -> list[str]:
    return [f"{name}_{h}d" for h in horizons for name in RELATIVE]


def relative_features(
    panel: DataFrame,
    market: DataFrame | None = None,
    universe: DataFrame | None = None,
    horizons=(1, 5, 20),
    min_size: int = MIN_GROUP,
    peer: str | None = None,
) -> DataFrame:
    """Market, sector, peer and whole-market relative returns.

    Rows outside their member's validity stay with NULL features. Without a sector
    column everything is one group.
    """
    out = panel if "sector" in panel.columns else panel.withColumn("sector", F.lit("__all__"))
    if universe is not None:
        out = joins.interval_sector(out, universe)
        out = quality.with_eligibility(out, universe)
    else:
        out = out.withColumn("eligible", F.lit(True))
    on = F.col("eligible")
    out = out.withColumns({f"_ret{h}": F.when(on, w.pct_change("close", h)) for h in horizons})
    if market is not None:
        out = joins.common_rows(joins.attach_series(out, market, "_mkt"), "_mkt")
        k = {"keys": joins.PAIR}
        seen = on & F.col("_pair")
        made = {}
        for h in horizons:
            s, m = w.pct_change("close", h, **k), w.pct_change("_mkt", h, **k)
            made[f"market_excess_return_{h}d"] = F.when(seen, s - m)
            made[f"market_relative_strength_{h}d"] = F.when(seen, w.ratio(1 + s, 1 + m) - 1)
        out = out.withColumns(made).drop("_pair", "_mkt")
    else:
        out = out.withColumns(
            {f"{n}_{h}d": F.lit(None).cast("double") for n in RELATIVE[:2] for h in horizons}
        )
    group = peer or "sector"
    # From here on everything groups by date and something finer: one exchange serves all.
    # The sort by (date, group, value, symbol) of the peer median also serves the sector
    # windows that follow it.
    out = out.repartition("date")
    for h in horizons:
        x = f"_ret{h}"
        out = loo_median_divergence(out, x, ["date", group], f"peer_median_divergence_{h}d", min_size)
        out = out.withColumns(
            {
                f"sector_return_rank_{h}d": midrank(x, ["date", "sector"], min_size),
                f"peer_return_rank_{h}d": peer_rank(x, ["date", group], min_size),
                "_mean": group_mean(x, ["date", "sector"], min_size),
            }
        )
        out = out.withColumns(
            {
                f"sector_return_{h}d": F.when(on, F.col("_mean")),
                f"sector_excess_return_{h}d": F.when(on, F.col(x) - F.col("_mean")),
                f"cross_sectional_return_rank_{h}d": midrank(x, ["date"], min_size),
            }
        )
    return out.drop("_mean", *[f"_ret{h}" for h in horizons])
