"""Latest-row cards, rule-based signals, screener, baskets and analyst score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from . import technical

RETURN_DAYS = (3, 5, 7, 10, 15, 20)

# Category order of the screener.
CATEGORIES = [
    "strong-buy", "buy", "hold", "sell", "strong-sell", "rsi-oversold", "rsi-overbought",
    "macd-bullish", "macd-bearish", "bullish-trend", "bearish-trend",
]
SIGNAL_ORDER = {"BUY": 0, "HOLD": 1, "SELL": 2, "NEUTRAL": 3}


def votes(sma20, sma50, rsi, macd, signal, prediction=None, sentiment=None) -> tuple[Column, Column]:
    """(bullish, bearish) votes; an unknown input abstains, an equal average is bearish."""
    a, b, r, m, s = (w.col(x) for x in (sma20, sma50, rsi, macd, signal))
    pro = [a > b, r < 30, m > s]
    con = [a <= b, r > 70, m <= s]
    if prediction is not None:
        text = w.col(prediction)
        pro.append(F.contains(text, F.lit("Bullish")))
        con.append(F.contains(text, F.lit("Bearish")) & ~F.contains(text, F.lit("Bullish")))
    if sentiment is not None:
        x = w.col(sentiment)
        pro.append(x > 0.3)
        con.append(x < -0.3)

    def total(conds: list[Column]) -> Column:
        out = F.lit(0)
        for c in conds:
            out = out + F.when(c, 1).otherwise(0)
        return out

    return total(pro), total(con)


def reasons(sma20, sma50, rsi, macd, signal) -> Column:
    """Explanation per factor as ``array<struct<factor, impact, detail>>``."""
    a, b, r, m, s = (w.col(x) for x in (sma20, sma50, rsi, macd, signal))

    def row(factor: str, cases: list[tuple[Column, str, Column]], missing: str) -> Column:
        out = None
        for cond, impact, detail in cases:
            item = F.struct(F.lit(factor).alias("factor"), F.lit(impact).alias("impact"), detail.alias("detail"))
            out = F.when(cond, item) if out is None else out.when(cond, item)
        return out.otherwise(
            F.struct(F.lit(factor).alias("factor"), F.lit("neutral").alias("impact"), F.lit(missing).alias("detail"))
        )

    return F.array(
        row(
            "Trend",
            [
                (a > b, "bullish", F.format_string("SMA20 (%.1f) above SMA50 (%.1f) — uptrend", a, b)),
                (a <= b, "bearish", F.format_string("SMA20 (%.1f) below SMA50 (%.1f) — downtrend", a, b)),
            ],
            "SMA data not available",
        ),
        row(
            "RSI",
            [
                (r < 30, "bullish", F.format_string("RSI at %.1f — oversold territory (< 30)", r)),
                (r > 70, "bearish", F.format_string("RSI at %.1f — overbought territory (> 70)", r)),
                (r.isNotNull(), "neutral", F.format_string("RSI at %.1f — neutral zone (30-70)", r)),
            ],
            "RSI data not available",
        ),
        row(
            "MACD",
            [
                (m > s, "bullish", F.format_string("MACD (%.2f) above signal line (%.2f)", m, s)),
                (m <= s, "bearish", F.format_string("MACD (%.2f) below signal line (%.2f)", m, s)),
            ],
            "MACD data not available",
        ),
    )


def trade_signal(df: DataFrame, prediction=None, sentiment=None) -> DataFrame:
    """Action, direction and confidence from the votes of the indicator columns."""
    bull, bear = votes("sma20", "sma50", "rsi", "macd", "macd_signal", prediction, sentiment)
    out = df.withColumns({"bull_votes": bull, "bear_votes": bear})
    up, down = F.col("bull_votes"), F.col("bear_votes")
    share = F.when(up + down > 0, F.greatest(up, down) / (up + down) * 100).otherwise(50.0)
    return out.withColumns(
        {
            "signal": F.when(up > down, "BUY").when(down > up, "SELL").otherwise("HOLD"),
            "direction": F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral"),
            "confidence": F.round(share, 1),
            "reasons": reasons("sma20", "sma50", "rsi", "macd", "macd_signal"),
        }
    )


def voting_probability(df: DataFrame, prediction=None, sentiment=None) -> DataFrame:
    """P(up) of the votes: 0.6 bullish, 0.4 bearish, 0.5 otherwise."""
    bull, bear = votes("sma20", "sma50", "rsi", "macd", "macd_signal", prediction, sentiment)
    return df.withColumn("prob", F.when(bull > bear, 0.6).when(bull < bear, 0.4).otherwise(0.5))


def recent(bars: DataFrame, months: int = 3) -> DataFrame:
    """The last ``months`` of each symbol's history."""
    last = F.max("date").over(Window.partitionBy("symbol"))
    return bars.withColumn("_last", last).where(F.col("date") > F.add_months("_last", -months)).drop("_last")


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n).drop("_k")


def streak() -> Column:
    """Consecutive strictly rising closes ending at the row."""
    spec = w.ordered()
    rn = F.row_number().over(spec)
    return rn, F.when(~w.is_true(F.col("close") > w.lag("close")), rn)


def latest_quotes(bars: DataFrame) -> DataFrame:
    """Last price, change and change percent per symbol."""
    out = bars.withColumn("_prev", F.coalesce(w.lag("close"), F.col("close")))
    last = out.groupBy("symbol").agg(F.max_by(F.struct("date", "close", "_prev"), "date").alias("_r"))
    c, p = F.col("_r.close"), F.col("_r._prev")
    return last.select(
        "symbol",
        F.col("_r.date").alias("date"),
        F.round(c, 2).alias("current_price"),
        F.round(c - p, 2).alias("change"),
        F.round(w.ratio(c - p, p) * 100, 2).alias("change_percent"),
    )


def stock_cards(bars: DataFrame, months: int = 3) -> DataFrame:
    """One card per symbol: quote, gated indicators, signal, trailing returns, sparkline.

    Indicators need 15 (RSI), 35 (MACD), 20 and 50 (averages) rows of history. All of it
    runs on windows of one symbol's recent rows; only the newest row leaves the stage.
    """
    base = recent(bars, months)
    out = technical.macd(technical.rsi(base))
    rn, fell = streak()
    out = out.withColumns({"_rn": rn, "_fell": fell})
    whole = Window.partitionBy("symbol")
    made = {
        "_n": F.count(F.lit(1)).over(whole),
        "sma20": w.sma("close", 20),
        "sma50": w.sma("close", 50),
        "_prev": w.lag("close"),
        "up_days": F.col("_rn") - F.max("_fell").over(w.running()),
        "sparkline": F.collect_list(F.round("close", 2)).over(w.trailing(30)),
        "_back": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))),
    }
    for n in RETURN_DAYS:
        made[f"ret{n}d"] = F.round((w.ratio("close", w.lag("close", n)) - 1) * 100, 2)
    last = out.withColumns(made).where("_back = 1")
    n = F.col("_n")
    prev = F.coalesce("_prev", "close")
    last = last.withColumns(
        {
            "rsi": F.when(n >= 15, F.col("rsi")),
            "macd": F.when(n >= 35, F.col("macd")),
            "macd_signal": F.when(n >= 35, F.col("macd_signal")),
            "current_price": F.round("close", 2),
            "change": F.round(F.col("close") - prev, 2),
            "change_percent": F.round(w.ratio(F.col("close") - prev, prev) * 100, 2),
        }
    )
    strong = F.coalesce("sma20", F.lit(0.0)) > F.coalesce("sma50", F.lit(0.0))
    last = trade_signal(last).withColumn("trend", F.when(strong, "Strong Trend").otherwise("Weak Trend"))
    return last.select(
        "symbol", "date", "current_price", "change", "change_percent", "signal", "direction", "confidence",
        "rsi", "macd", "macd_signal", "sma20", "sma50", "trend", "sparkline", "reasons", "up_days",
        *[f"ret{k}d" for k in RETURN_DAYS],
    )


def with_categories(cards: DataFrame) -> DataFrame:
    """Overlapping categories of each card, in the screener's order."""
    c = F.col
    buy, sell = c("signal") == "BUY", c("signal") == "SELL"
    rules = [
        buy & (c("confidence") >= 85) & (c("trend") == "Strong Trend"),
        buy & (c("confidence") >= 70),
        c("signal") == "HOLD",
        sell,
        sell & (c("confidence") >= 85),
        c("rsi") < 30,
        c("rsi") > 70,
        c("macd") > c("macd_signal"),
        c("macd") < c("macd_signal"),
        c("sma20") > c("sma50"),
        c("sma20") < c("sma50"),
    ]
    found = F.array(*[F.when(rule, F.lit(name)) for rule, name in zip(rules, CATEGORIES)])
    return cards.withColumn("categories", F.array_compact(found))


def category_lists(cards: DataFrame, spark) -> DataFrame:
    """Rank of every member inside its category; empty categories stay, without members."""
    order = spark.range(len(CATEGORIES)).select(
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("id") + 1).cast("int")).alias("category"),
        F.col("id").alias("position"),
    )
    member = cards.select("symbol", "confidence", F.explode("categories").alias("category"))
    by = Window.partitionBy("category")
    ranked = member.withColumns(
        {
            "rank": F.row_number().over(by.orderBy(F.desc("confidence"), "symbol")),
            "count": F.count(F.lit(1)).over(by),
        }
    )
    return order.join(ranked, "category", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def membership(flat: DataFrame) -> DataFrame:
    """``(symbol, category)`` rows to one row per symbol with its sorted categories."""
    return flat.groupBy("symbol").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def signal_rank(signal="signal") -> Column:
    out = F.lit(3)
    for name, k in SIGNAL_ORDER.items():
        out = F.when(w.col(signal) == name, k).otherwise(out)
    return out


def screen(intents: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards matching each intent, ranked and cut to the requested number.

    Equal intents are screened once. Each card is listed under the action classes it
    belongs to, so intents and cards meet in an equality join on the action.
    """
    fields = ["max_price", "min_price", "action", "bullish_days", "top"]
    wanted = intents.select(*fields).distinct()
    # Spelled out because hashes skip NULLs and would confuse a lower with an upper bound.
    ident = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in fields])
    wanted = wanted.withColumns({"_id": ident, "_act": F.coalesce("action", F.lit("any"))})
    s = F.col("signal")
    acts = F.array_compact(
        F.array(
            F.lit("any"),
            F.when(s == "BUY", "buy"),
            F.when(s == "SELL", "sell"),
            F.when(s == "HOLD", "hold"),
            F.when(F.array_contains("categories", "strong-buy"), "strong_buy"),
            F.when(F.array_contains("categories", "strong-sell"), "strong_sell"),
        )
    )
    ret = F.lit(None).cast("double")
    for k in RETURN_DAYS:
        ret = F.when(F.col("bullish_days") == k, F.col(f"ret{k}d")).otherwise(ret)
    price = F.col("current_price")
    rising = F.coalesce(ret > 0, F.col("up_days") >= F.col("bullish_days"))
    ok = (
        (F.col("max_price").isNull() | (price <= F.col("max_price")))
        & (F.col("min_price").isNull() | (price >= F.col("min_price")))
        & (F.col("bullish_days").isNull() | F.coalesce(rising, F.lit(False)))
    )
    listed = cards.where(price.isNotNull()).withColumn("_act", F.explode(acts))
    hits = wanted.join(listed, "_act").where(ok)
    order = Window.partitionBy("_id").orderBy(signal_rank(), F.desc("confidence"), "symbol")
    best = (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("top"))
        .select("_id", "symbol", "signal", "confidence", "current_price", "rank")
    )
    return intents.withColumn("_id", ident).join(best, "_id").drop("_id")


def top_movers(cards: DataFrame, limit: int = 10) -> DataFrame:
    """Strongest bullish and bearish symbols by signed confidence."""
    score = F.when(F.col("direction") == "bullish", F.col("confidence")).when(
        F.col("direction") == "bearish", -F.col("confidence")
    )
    out = cards.withColumn("score", F.coalesce(score, F.lit(0.0))).where("score <> 0")
    out = out.withColumn("side", F.when(F.col("score") > 0, "bullish").otherwise("bearish"))
    by = Window.partitionBy("side").orderBy(F.desc(F.abs("score")), "symbol")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


BASKETS = ["ai-growth", "momentum", "strong-buy", "default"]


def momentum_score() -> Column:
    c = F.col
    return (
        c("confidence")
        + F.abs(c("change_percent")) * 2
        + F.when(c("signal") == "BUY", 20).when(c("signal") == "SELL", -10).otherwise(0)
        + F.when(c("trend") == "Strong Trend", 15).otherwise(0)
    )


def baskets(cards: DataFrame) -> DataFrame:
    """Members of each rule basket with their rank."""
    c = F.col
    strong = c("trend") == "Strong Trend"
    growth = (c("rsi") >= 50) & (c("rsi") <= 70) & (c("macd") > 0) & strong
    # (basket, rule, score, size) of every basket, as an array on each card.
    rules = [
        ("ai-growth", growth, c("confidence"), 10),
        ("momentum", F.lit(True), momentum_score(), 10),
        ("strong-buy", c("signal") == "BUY", c("confidence"), 12),
        ("default", F.lit(True), c("confidence"), 12),
    ]
    slots = F.array_compact(
        F.array(
            *[
                F.when(rule, F.struct(F.lit(b).alias("basket"), s.cast("double").alias("score"), F.lit(k).alias("size")))
                for b, rule, s, k in rules
            ]
        )
    )
    flat = cards.select("*", F.explode(slots).alias("_s")).select("*", "_s.*").drop("_s")
    by = Window.partitionBy("basket").orderBy(F.desc("score"), "symbol")
    # The literal bound lets every task drop the rest before the shuffle.
    ranked = flat.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 12)
    return ranked.where(F.col("rank") <= F.col("size"))


def basket_summary(members: DataFrame) -> DataFrame:
    """Mood and mean change per basket."""
    share = F.avg((F.col("signal") == "BUY").cast("double"))
    return members.groupBy("basket").agg(
        F.count(F.lit(1)).alias("total_stocks"),
        F.when(share >= 0.5, "bullish").when(share < 0.3, "bearish").otherwise("neutral").alias("sentiment"),
        F.avg("change_percent").alias("average_return"),
    )


def baskets_overview(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("total_baskets"),
        F.sum("total_stocks").alias("total_stocks"),
        F.count_if(F.col("sentiment") == "bullish").alias("bullish_baskets"),
        F.count_if(F.col("sentiment") == "bearish").alias("bearish_baskets"),
    )


def analyst_score(df: DataFrame) -> DataFrame:
    """Composite 0-100 score of price, indicators, fundamentals, sentiment and model.

    Reads price, sma20, sma50, rsi, macd, macd_signal, roe, opm, revenue_growth,
    profit_growth, debt_equity, sentiment and probability; unknown inputs are skipped.
    """
    c = F.col

    def part(*cases: tuple[Column, int]) -> Column:
        out = None
        for cond, points in cases:
            out = F.when(cond, points) if out is None else out.when(cond, points)
        return out.otherwise(0)

    score = (
        F.lit(50)
        + part((c("sma20") > c("sma50"), 20), (c("sma20") <= c("sma50"), -20))
        + part((c("price") > c("sma20"), 10), (c("price") <= c("sma20"), -10))
        + part((c("rsi") < 30, 0), (c("rsi") > 70, -10), (c("rsi").between(40, 60), 5))
        + part((c("macd") > c("macd_signal"), 10), (c("macd") <= c("macd_signal"), -10))
        + part((c("roe") >= 15, 10), (c("roe") >= 10, 5), (c("roe") < 0, -5))
        + part((c("opm") >= 20, 5), (c("opm") < 5, -5))
        + part((c("revenue_growth") > 0, 5), (c("revenue_growth") <= 0, -5))
        + part((c("profit_growth") > 0, 5), (c("profit_growth") <= 0, -5))
        + part((c("debt_equity") > 2, -5), ((c("debt_equity") < 1) & (c("debt_equity") >= 0), 5))
        + part((c("sentiment") > 0.2, 10), (c("sentiment") < -0.2, -10))
    )
    blended = (0.4 * score + 0.6 * (c("probability") * 100)).cast("int")
    total = F.when(c("probability").isNotNull(), blended).otherwise(score)
    out = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    s = c("score")
    action = (
        F.when(s >= 75, "STRONG BUY").when(s >= 60, "BUY").when(s >= 45, "HOLD").when(s >= 30, "SELL")
        .otherwise("STRONG SELL")
    )
    return out.withColumn("action", action)
