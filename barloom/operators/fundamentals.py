"""Fundamental scoring and quarterly ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w

FILING_LAG_DAYS = 45
# Sectors whose leverage is structural.
FINANCIAL = ["bank", "financial", "nbfc", "insurance", "capital market"]


def ladder(x: Column, steps: list[tuple[str, float, float]], default: float) -> Column:
    """First matching step of ``(comparison, bound, points)``."""
    out = None
    for op, bound, points in steps:
        cond = x <= bound if op == "<=" else x >= bound if op == ">=" else x > bound
        out = F.when(cond, points) if out is None else out.when(cond, points)
    return out.otherwise(default)


def debt_category(de="de", sector="sector") -> tuple[Column, Column]:
    """(label, points out of 100) of the debt/equity ratio."""
    d = w.col(de)
    financial = F.lower(F.coalesce(w.col(sector), F.lit("Unknown"))).rlike("|".join(FINANCIAL))
    label = (
        F.when(financial, "N/A").when(d.isNull(), "Low").when(d <= 0.8, "Low").when(d <= 1.5, "Medium").otherwise("High")
    )
    points = (
        F.when(financial, 85.0)
        .when(d.isNull(), 80.0)
        .when(d <= 0.3, 100.0)
        .when(d <= 0.8, 85.0)
        .when(d <= 1.5, F.greatest(F.lit(50.0), F.round(85.0 - (d - 0.8) / 0.7 * 35.0, 1)))
        .otherwise(F.greatest(F.lit(20.0), F.round(50.0 - (d - 1.5) * 20.0, 1)))
    )
    return label, points


def fundamental_score(df: DataFrame) -> DataFrame:
    """Category scores, total and rating from pe, roe, roce, de, growth and sector."""
    c = F.col
    label, debt = debt_category()
    valuation = F.when(
        c("pe") > 0,
        ladder(c("pe"), [("<=", 10, 24.0), ("<=", 18, 21.0), ("<=", 28, 17.0), ("<=", 40, 12.0), ("<=", 60, 7.0)], 4.0),
    ).otherwise(14.0)
    roe = F.when(c("roe").isNull(), 8.0).otherwise(
        ladder(c("roe") * 100, [(">=", 20, 15.0), (">=", 14, 12.0), (">=", 10, 9.0), (">", 0, 6.0)], 2.0)
    )
    roce = F.when(c("roce").isNull(), 5.0).otherwise(
        ladder(c("roce") * 100, [(">=", 20, 10.0), (">=", 12, 8.0), (">=", 6, 6.0), (">", 0, 4.0)], 1.0)
    )

    def growth(x: str) -> Column:
        return F.when(c(x).isNull(), 7.0).otherwise(
            ladder(c(x) * 100, [(">=", 15, 12.5), (">=", 8, 10.0), (">=", 0, 7.0)], 3.5)
        )

    out = df.withColumns(
        {
            "debt_label": label,
            "valuation_score": valuation,
            "profitability_score": F.round(roe + roce, 1),
            "health_score": F.round(debt / 100.0 * 25.0, 1),
            "growth_score": F.round(growth("rev_growth") + growth("profit_growth"), 1),
        }
    )
    total = F.round(c("valuation_score") + c("profitability_score") + c("health_score") + c("growth_score"), 1)
    out = out.withColumn("fundamental_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    s = c("fundamental_score")
    rating = (
        F.when(s >= 75, "Strong Buy").when(s >= 65, "Buy").when(s >= 48, "Hold").when(s >= 35, "Sell")
        .otherwise("Strong Sell")
    )

    def metric(name: str, value: Column, best: float) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(best).alias("max_score"))

    def category(name: str, score: str, items: list[Column]) -> Column:
        return F.struct(
            F.lit(name).alias("name"), c(score).alias("score"), F.lit(25.0).alias("weight"), F.array(*items).alias("metrics")
        )

    pct = lambda x: F.round(c(x) * 100, 2)
    return out.withColumns(
        {
            "rating": rating,
            "score_color": F.when(s >= 65, "green").when(s >= 45, "gold").otherwise("red"),
            "categories": F.array(
                category("Valuation", "valuation_score", [metric("P/E Ratio", c("pe").cast("double"), 25.0)]),
                category("Profitability", "profitability_score", [metric("ROE", pct("roe"), 15.0), metric("ROCE", pct("roce"), 10.0)]),
                category("Financial Health", "health_score", [metric("Debt to Equity", c("de").cast("double"), 25.0)]),
                category("Growth", "growth_score", [metric("Revenue Growth", pct("rev_growth"), 12.5), metric("Profit Growth", pct("profit_growth"), 12.5)]),
            ),
        }
    )


ITEMS = [
    "total_revenue", "net_income", "operating_income", "total_equity", "total_debt", "total_assets",
    "current_liabilities", "diluted_eps",
]


def quarterly_ratios(statements: DataFrame, quarter_closes: DataFrame) -> DataFrame:
    """Ratios per symbol and quarter from long ``(symbol, quarter_end, item, amount)``.

    Each figure is read from the latest statement on or before the quarter end, growth
    against the latest one on or before twelve months earlier. A filed quarter whose item
    is missing stays unknown. Available 45 days after the quarter end.
    """
    wide = statements.groupBy("symbol", "quarter_end").pivot("item", ITEMS).agg(F.max("amount"))
    year_ago = F.add_months("quarter_end", -12)
    # Latest filing at or before a year ago: a range window over month numbers.
    month = F.year("quarter_end") * 12 + F.month("quarter_end")
    old = Window.partitionBy("symbol").orderBy("_month").rangeBetween(Window.unboundedPreceding, -12)
    wide = wide.withColumn("_month", month)
    out = wide.withColumn(
        "_old", F.last(F.struct("total_revenue", "net_income")).over(old)
    )
    c = F.col
    capital = (
        F.when(c("operating_income").isNull(), None)
        .when(
            c("total_assets").isNotNull() & c("current_liabilities").isNotNull(),
            c("total_assets") - c("current_liabilities"),
        )
        .otherwise(c("total_equity") + c("total_debt"))
    )
    out = out.join(quarter_closes.select("symbol", "quarter_end", F.col("close").alias("_px")), ["symbol", "quarter_end"], "left")
    eps = c("diluted_eps")
    return out.select(
        "symbol",
        "quarter_end",
        F.date_add("quarter_end", FILING_LAG_DAYS).alias("available_at"),
        F.when((eps > 0) & (c("_px") > 0), c("_px") / eps).alias("pe"),
        eps.alias("eps"),
        F.try_divide("net_income", "total_equity").alias("roe"),
        F.when(capital > 0, c("operating_income") / capital).alias("roce"),
        F.try_divide("total_debt", "total_equity").alias("de"),
        F.try_divide("operating_income", "total_revenue").alias("opm"),
        (F.try_divide(c("total_revenue"), c("_old.total_revenue")) - 1).alias("rev_growth"),
        (F.try_divide(c("net_income"), c("_old.net_income")) - 1).alias("profit_growth"),
        F.lit("Unknown").alias("sector"),
    )


def quarter_end_closes(bars: DataFrame) -> DataFrame:
    """Close of the last bar on or before each quarter end that a later bar rolls back to."""
    rows = bars.where(F.col("close").isNotNull())
    ends = F.last_day(F.add_months(F.trunc("date", "quarter"), 2))
    rolled = F.when(F.col("date") == ends, ends).otherwise(F.date_sub(F.trunc("date", "quarter"), 1))
    traded = rows.groupBy("symbol", ends.alias("quarter_end")).agg(F.max_by("close", "date").alias("close"))
    asked = rows.select("symbol", rolled.alias("quarter_end")).distinct().withColumn("_ask", F.lit(True))
    known = F.last("close", ignorenulls=True).over(
        Window.partitionBy("symbol").orderBy("quarter_end").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        traded.join(asked, ["symbol", "quarter_end"], "full")
        .withColumn("close", known)
        .where(F.col("_ask") & F.col("close").isNotNull())
        .drop("_ask")
    )
