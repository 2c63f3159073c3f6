"""Catalogue: cards, screener, baskets, fundamentals, intents, policies, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import bootstrap, fundamentals as fu
from ..operators import holdings, intents, joins, labels, metrics, policy, quality, screen, technical
from . import views as v
from .catalog_metrics import H, q_auc, q_score, regimed
from .catalog_technical import LAG, q_ewm, q_full, q_sma, win
from ..functions.ewm import span
from .registry import query, sql_view

MONTHS = 36

# ---- flagship ------------------------------------------------------------------------


@query(
    "trend_screen",
    "side, rank:i, symbol, date:d, close:4, sma20:4, sma50:4, vol_20:6, gap:6",
    f"""SELECT side, rank, symbol, date, close, sma20, sma50, vol_20, gap FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(gap) DESC, symbol) AS rank FROM (
  SELECT *, CASE WHEN sma20 > sma50 THEN 'up' ELSE 'down' END AS side, sma20 / sma50 - 1 AS gap FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM (
      SELECT symbol, date, close, {q_sma('close', 20)} AS sma20, {q_sma('close', 50)} AS sma50, {q_full('stddev_pop', 'r', 20)} AS vol_20
      FROM (SELECT *, close / lag(close) {LAG} - 1 AS r FROM weekly))) WHERE k = 1 AND sma50 IS NOT NULL)) WHERE rank <= 10""",
)
def _(spark, sf):
    out = v.weekly(spark, sf).withColumn("r", w.pct_change("close"))
    out = out.withColumns({"sma20": w.sma("close", 20), "sma50": w.sma("close", 50), "vol_20": w.roll_std("r", 20)})
    last = out.groupBy("symbol").agg(
        F.max_by(F.struct("date", "close", "sma20", "sma50", "vol_20"), "date").alias("_r")
    ).select("symbol", "_r.*").where("sma50 IS NOT NULL")
    last = last.withColumns(
        {
            "side": F.when(F.col("sma20") > F.col("sma50"), "up").otherwise("down"),
            "gap": w.ratio("sma20", "sma50") - 1,
        }
    )
    by = w.Window.partitionBy("side").orderBy(F.desc(F.abs("gap")), "symbol")
    return last.withColumn("rank", F.row_number().over(by)).where("rank <= 10")


# ---- cards ---------------------------------------------------------------------------

_WR = "(PARTITION BY symbol ORDER BY date ROWS {0} PRECEDING)"
sql_view(
    "q_recent",
    f"""SELECT * EXCLUDE (l) FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS l FROM weekly) WHERE date > l - INTERVAL {MONTHS} MONTH""",
)
sql_view(
    "q_ind",
    f"""SELECT *, {q_ewm('macd0', span(9))} AS msig0 FROM (SELECT *, {q_ewm('close', span(12))} - {q_ewm('close', span(26))} AS macd0,
  {q_ewm('up', 1 / 14)} AS g, {q_ewm('dn', 1 / 14)} AS l FROM (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0::DOUBLE END AS up, CASE WHEN d < 0 THEN -d ELSE 0.0::DOUBLE END AS dn
  FROM (SELECT *, close - lag(close) {LAG} AS d FROM q_recent)))""",
)
sql_view(
    "q_cards",
    f"""SELECT *, CASE WHEN bull > bear THEN 'BUY' WHEN bear > bull THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN bull > bear THEN 'bullish' WHEN bear > bull THEN 'bearish' ELSE 'neutral' END AS direction,
  CASE WHEN bull + bear > 0 THEN round(greatest(bull, bear) / CAST(bull + bear AS DOUBLE) * 100, 1) ELSE 50.0::DOUBLE END AS confidence FROM (
  SELECT *, CASE WHEN sma20 > sma50 THEN 1 ELSE 0 END + CASE WHEN rsi < 30 THEN 1 ELSE 0 END + CASE WHEN macd > macd_signal THEN 1 ELSE 0 END AS bull,
    CASE WHEN sma20 <= sma50 THEN 1 ELSE 0 END + CASE WHEN rsi > 70 THEN 1 ELSE 0 END + CASE WHEN macd <= macd_signal THEN 1 ELSE 0 END AS bear,
    CASE WHEN coalesce(sma20, 0) > coalesce(sma50, 0) THEN 'Strong Trend' ELSE 'Weak Trend' END AS trend FROM (
    SELECT symbol, date, round(close, 2) AS current_price, round(close - prev, 2) AS change, round((close - prev) / prev * 100, 2) AS change_percent,
      CASE WHEN n >= 15 AND l > 0 THEN 100 - 100 / (1 + g / l) END AS rsi, CASE WHEN n >= 35 THEN macd0 END AS macd, CASE WHEN n >= 35 THEN msig0 END AS macd_signal,
      sma20, sma50, rn - fell AS up_days, {', '.join(f'round((close / p{k} - 1) * 100, 2) AS ret{k}d' for k in screen.RETURN_DAYS)}, spark FROM (
      SELECT *, coalesce(lag(close) {LAG}, close) AS prev, count(*) OVER (PARTITION BY symbol) AS n, {q_sma('close', 20)} AS sma20, {q_sma('close', 50)} AS sma50, row_number() {LAG} AS rn,
        max(CASE WHEN NOT coalesce(d > 0, false) THEN rn0 END) {LAG} AS fell, {', '.join(f'lag(close, {k}) {LAG} AS p{k}' for k in screen.RETURN_DAYS)},
        list(round(close, 2)) OVER {win(30)} AS spark, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back
      FROM (SELECT *, row_number() {LAG} AS rn0 FROM q_ind)) WHERE back = 1))""",
)


def cards(spark, sf):
    return screen.stock_cards(v.weekly(spark, sf), MONTHS)


@query(
    "stock_cards",
    """symbol, date:d, current_price:2, change:2, change_percent:2, signal, direction, confidence:1, rsi:4, macd:4, macd_signal:4, sma20:4, sma50:4, trend,
    up_days:i, """ + ", ".join(f"ret{k}d:2" for k in screen.RETURN_DAYS),
    "SELECT * FROM q_cards",
)
def _(spark, sf):
    return cards(spark, sf)


@query(
    "sparklines",
    "symbol, n:i, first:2, last:2, total:1",
    "SELECT symbol, len(spark) AS n, spark[1] AS first, spark[len(spark)] AS last, list_sum(spark) AS total FROM q_cards",
)
def _(spark, sf):
    s = F.col("sparkline")
    return cards(spark, sf).select(
        "symbol",
        F.size(s).alias("n"),
        F.element_at(s, 1).alias("first"),
        F.element_at(s, -1).alias("last"),
        F.aggregate(s, F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    "signal_reasons",
    "symbol, reasons",
    """SELECT symbol, string_agg(r, '; ' ORDER BY k) AS reasons FROM (SELECT symbol, 1 AS k, CASE WHEN sma20 > sma50 THEN 'Trend:bullish' WHEN sma20 <= sma50 THEN 'Trend:bearish' ELSE 'Trend:neutral' END AS r FROM q_cards
UNION ALL SELECT symbol, 2, CASE WHEN rsi < 30 THEN 'RSI:bullish' WHEN rsi > 70 THEN 'RSI:bearish' ELSE 'RSI:neutral' END FROM q_cards
UNION ALL SELECT symbol, 3, CASE WHEN macd > macd_signal THEN 'MACD:bullish' WHEN macd <= macd_signal THEN 'MACD:bearish' ELSE 'MACD:neutral' END FROM q_cards) GROUP BY symbol""",
)
def _(spark, sf):
    joined = F.array_join(F.transform("reasons", lambda r: F.concat(r["factor"], F.lit(":"), r["impact"])), "; ")
    return cards(spark, sf).select("symbol", joined.alias("reasons"))


@query(
    "latest_quotes",
    "symbol, date:d, current_price:2, change:2, change_percent:2",
    f"""SELECT symbol, date, round(close, 2) AS current_price, round(close - p, 2) AS change, round((close - p) / p * 100, 2) AS change_percent FROM (
  SELECT *, lag(close) {LAG} AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k = 1""",
)
def _(spark, sf):
    return screen.latest_quotes(v.bars(spark, sf))


@query(
    "streaks",
    "symbol, date:d, up_days:i",
    f"""SELECT symbol, date, rn - max(CASE WHEN NOT coalesce(up, false) THEN rn END) {LAG} AS up_days FROM (SELECT symbol, date, close > lag(close) {LAG} AS up, row_number() {LAG} AS rn FROM bars)""",
)
def _(spark, sf):
    rn, fell = screen.streak()
    out = v.bars(spark, sf).withColumns({"rn": rn, "fell": fell})
    return out.withColumn("up_days", F.col("rn") - F.max("fell").over(w.running()))


@query(
    "last_n_rows",
    "symbol, date:d, close:6",
    "SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k <= 30",
)
def _(spark, sf):
    return screen.last_rows(v.bars(spark, sf), 30)


@query("canonical_order", "pos:i, symbol, date:d", "SELECT row_number() OVER (ORDER BY date, symbol) AS pos, symbol, date FROM weekly")
def _(spark, sf):
    # Position inside a day plus the rows of earlier days: no single-partition sort of all rows.
    panel = v.weekly(spark, sf).select("symbol", "date")
    per_day = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    before = F.coalesce(F.sum("n").over(w.ordered(("_one",)).rowsBetween(w.Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_day.select("date", before.alias("before"))
    inside = F.row_number().over(w.Window.partitionBy("date").orderBy("symbol"))
    return panel.join(offsets, "date").withColumn("pos", F.col("before") + inside)


_CATS = {
    "strong-buy": "signal = 'BUY' AND confidence >= 85 AND trend = 'Strong Trend'",
    "buy": "signal = 'BUY' AND confidence >= 70",
    "hold": "signal = 'HOLD'",
    "sell": "signal = 'SELL'",
    "strong-sell": "signal = 'SELL' AND confidence >= 85",
    "rsi-oversold": "rsi < 30",
    "rsi-overbought": "rsi > 70",
    "macd-bullish": "macd > macd_signal",
    "macd-bearish": "macd < macd_signal",
    "bullish-trend": "sma20 > sma50",
    "bearish-trend": "sma20 < sma50",
}
sql_view(
    "q_cats",
    " UNION ALL ".join(f"SELECT *, '{c}' AS category, {i} AS position FROM q_cards WHERE {cond}" for i, (c, cond) in enumerate(_CATS.items())),
)


@query(
    "category_lists",
    "category, position:i, symbol, rank:i, count:i",
    f"""SELECT o.c AS category, o.i AS position, symbol, CASE WHEN symbol IS NOT NULL THEN row_number() OVER (PARTITION BY o.c ORDER BY confidence DESC, symbol) END AS rank,
  count(symbol) OVER (PARTITION BY o.c) AS count FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(_CATS))}) o(c, i) LEFT JOIN q_cats q ON q.category = o.c""",
)
def _(spark, sf):
    return screen.category_lists(screen.with_categories(cards(spark, sf)), spark)


@query(
    "category_membership",
    "symbol, categories",
    "SELECT symbol, string_agg(category, ',' ORDER BY category) AS categories FROM q_cats GROUP BY symbol",
)
def _(spark, sf):
    flat = screen.with_categories(cards(spark, sf)).select("symbol", F.explode("categories").alias("category"))
    return screen.membership(flat).withColumn("categories", F.array_join("categories", ","))


@query(
    "top_movers",
    "side, rank:i, symbol, score:1",
    """SELECT side, rank, symbol, score FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(score) DESC, symbol) AS rank FROM (
  SELECT symbol, CASE WHEN direction = 'bullish' THEN confidence ELSE -confidence END AS score, direction AS side FROM q_cards WHERE direction <> 'neutral')) WHERE rank <= 10""",
)
def _(spark, sf):
    return screen.top_movers(cards(spark, sf))


_MOM = "confidence + abs(change_percent) * 2 + CASE signal WHEN 'BUY' THEN 20 WHEN 'SELL' THEN -10 ELSE 0 END + CASE WHEN trend = 'Strong Trend' THEN 15 ELSE 0 END"
sql_view(
    "q_baskets",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY score DESC, symbol) AS rank FROM (
  SELECT *, 'ai-growth' AS basket, confidence AS score, 10 AS size FROM q_cards WHERE rsi BETWEEN 50 AND 70 AND macd > 0 AND trend = 'Strong Trend'
  UNION ALL SELECT *, 'momentum', {_MOM}, 10 FROM q_cards UNION ALL SELECT *, 'strong-buy', confidence, 12 FROM q_cards WHERE signal = 'BUY'
  UNION ALL SELECT *, 'default', confidence, 12 FROM q_cards)) WHERE rank <= size""",
)


@query("baskets", "basket, rank:i, symbol, score:2", "SELECT * FROM q_baskets")
def _(spark, sf):
    return screen.baskets(cards(spark, sf))


sql_view(
    "q_bsum",
    """SELECT basket, count(*) AS total_stocks, CASE WHEN avg(CASE WHEN signal = 'BUY' THEN 1.0::DOUBLE ELSE 0 END) >= 0.5 THEN 'bullish'
  WHEN avg(CASE WHEN signal = 'BUY' THEN 1.0::DOUBLE ELSE 0 END) < 0.3 THEN 'bearish' ELSE 'neutral' END AS sentiment, avg(change_percent) AS average_return FROM q_baskets GROUP BY basket""",
)


@query("basket_summary", "basket, total_stocks:i, sentiment, average_return:4", "SELECT * FROM q_bsum")
def _(spark, sf):
    return screen.basket_summary(screen.baskets(cards(spark, sf)))


@query(
    "baskets_overview",
    "total_baskets:i, total_stocks:i, bullish_baskets:i, bearish_baskets:i",
    """SELECT count(*) AS total_baskets, sum(total_stocks) AS total_stocks, count(*) FILTER (sentiment = 'bullish') AS bullish_baskets, count(*) FILTER (sentiment = 'bearish') AS bearish_baskets FROM q_bsum""",
)
def _(spark, sf):
    return screen.baskets_overview(screen.basket_summary(screen.baskets(cards(spark, sf))))


@query(
    "voting_probability",
    "symbol, date:d, prob:2",
    f"""SELECT symbol, date, CASE WHEN s > 0 THEN 0.6 WHEN s < 0 THEN 0.4 ELSE 0.5 END AS prob FROM (SELECT symbol, date, CASE WHEN a > b THEN 1 WHEN a <= b THEN -1 ELSE 0 END
  + CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END + CASE WHEN macd > macd_signal THEN 1 WHEN macd <= macd_signal THEN -1 ELSE 0 END AS s FROM (
  SELECT b.symbol, b.date, r.rsi, m.macd, m.macd_signal, b.a, b.b FROM (SELECT *, {q_sma('close', 20)} AS a, {q_sma('close', 50)} AS b FROM bars) b
  JOIN q_rsi r ON r.symbol = b.symbol AND r.date = b.date JOIN q_macd m ON m.symbol = b.symbol AND m.date = b.date))""",
)
def _(spark, sf):
    out = technical.macd(technical.rsi(v.bars(spark, sf)))
    out = out.withColumns({"sma20": w.sma("close", 20), "sma50": w.sma("close", 50)})
    return screen.voting_probability(out)


# ---- intents -------------------------------------------------------------------------

_TEMPLATES = [
    "stocks under {n}", "{n} se kam wale", "above {n} rupees", "{n}/- se niche ke stock do",
    "strong bullish wale stock do", "{d} din se bullish stock do", "top {d} buy signal", "{n} wale stocks do",
    "{d}% growth wale", "penny stocks bullish", "{d} din ka BUY signal do", "price < {n} and > {d}",
    "best of {d} sell picks above {d}", "hold stocks", "{n},500.50 rupaye se zyada", "bearish stocks less than {n}",
]


def messages(spark, sf):
    o = v.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    n = (k % 37 * 25 + 100).cast("string")
    d = (F.col("o_custkey") % 70 + 1).cast("string")
    text = F.element_at(F.array(*[F.lit(t) for t in _TEMPLATES]), (k % 16 + 1).cast("int"))
    return o.select(k.alias("id"), F.replace(F.replace(text, F.lit("{n}"), n), F.lit("{d}"), d).alias("text"))


_QT = "[" + ", ".join("'" + t + "'" for t in _TEMPLATES) + "]"
sql_view(
    "q_msgs",
    f"""SELECT o_orderkey AS id, replace(replace({_QT}[1 + CAST(o_orderkey % 16 AS INTEGER)], '{{n}}', CAST(o_orderkey % 37 * 25 + 100 AS VARCHAR)),
  '{{d}}', CAST(o_custkey % 70 + 1 AS VARCHAR)) AS text FROM orders""",
)


def _lit(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def _qnum(p):
    return f"TRY_CAST(replace(regexp_extract(text, {_lit(p)}, 1), ',', '') AS DOUBLE)"


_ACT = " ".join(f"WHEN regexp_matches(text, {_lit(p)}) THEN '{a}'" for a, p in intents.ACTIONS.items())
sql_view(
    "q_intents",
    f"""SELECT id, text, coalesce(mx, CASE WHEN mx IS NULL AND mn IS NULL AND NOT regexp_matches(text, {_lit(intents.NOT_A_PRICE)}) THEN round({_qnum(intents.BARE)}, 2) END,
  CASE WHEN regexp_matches(text, {_lit(intents.PENNY)}) THEN 100.0::DOUBLE END) AS max_price, mn AS min_price, CASE {_ACT} END AS action,
  CASE WHEN regexp_extract(text, {_lit(intents.DAYS)}, 1) <> '' THEN least(TRY_CAST(regexp_extract(text, {_lit(intents.DAYS)}, 1) AS INTEGER), 60) END AS bullish_days, CASE WHEN {_qnum(intents.TOP)} IS NULL THEN 10 ELSE least(greatest(CAST(trunc({_qnum(intents.TOP)}) AS INTEGER), 1), 50) END AS top
FROM (SELECT *, round(coalesce({', '.join(_qnum(p) for p in intents.MAX_PRICE)}), 2) AS mx, round(coalesce({', '.join(_qnum(p) for p in intents.MIN_PRICE)}), 2) AS mn FROM q_msgs)""",
)


@query("screen_intents", "id:i, max_price:2, min_price:2, action, bullish_days:i, top:i", "SELECT * FROM q_intents")
def _(spark, sf):
    return intents.parse_intent(messages(spark, sf))


@query(
    "screen_results",
    "id:i, symbol, rank:i, confidence:1",
    """SELECT id, symbol, rank, confidence FROM (SELECT i.id, i.top, c.symbol, c.confidence, row_number() OVER (PARTITION BY i.id ORDER BY CASE signal WHEN 'BUY' THEN 0 WHEN 'HOLD' THEN 1 WHEN 'SELL' THEN 2 ELSE 3 END, confidence DESC, c.symbol) AS rank
  FROM q_intents i JOIN q_cards c ON (max_price IS NULL OR current_price <= max_price) AND (min_price IS NULL OR current_price >= min_price)
    AND (action IS NULL OR action = lower(signal) OR (action = 'strong_buy' AND signal = 'BUY' AND confidence >= 85 AND trend = 'Strong Trend') OR (action = 'strong_sell' AND signal = 'SELL' AND confidence >= 85))
    AND (bullish_days IS NULL OR CASE bullish_days WHEN 3 THEN coalesce(ret3d > 0, up_days >= 3) WHEN 5 THEN coalesce(ret5d > 0, up_days >= 5) WHEN 7 THEN coalesce(ret7d > 0, up_days >= 7)
      WHEN 10 THEN coalesce(ret10d > 0, up_days >= 10) WHEN 15 THEN coalesce(ret15d > 0, up_days >= 15) WHEN 20 THEN coalesce(ret20d > 0, up_days >= 20) ELSE up_days >= bullish_days END)) WHERE rank <= top""",
)
def _(spark, sf):
    return screen.screen(intents.parse_intent(messages(spark, sf)), screen.with_categories(cards(spark, sf)))


sql_view("q_brands", "SELECT DISTINCT replace(upper(p_brand), '#', '') AS symbol FROM part")
sql_view("q_names", "SELECT p_name AS phrase, min(replace(upper(p_brand), '#', '')) AS symbol FROM part GROUP BY p_name")
sql_view(
    "q_chat",
    """SELECT o_orderkey AS id, 'Compare ' || lower(replace(b.p_brand, '#', '')) || '.ns with ' || upper(a.p_name) || ', or BRAND' || CAST(o_custkey % 30 AS VARCHAR) || ' please?' AS text
FROM orders JOIN part a ON a.p_partkey = o_orderkey % (SELECT count(*) FROM part) JOIN part b ON b.p_partkey = o_custkey % (SELECT count(*) FROM part)""",
)


@query(
    "symbol_mentions",
    "id:i, symbols",
    """SELECT id, string_agg(symbol, ',' ORDER BY place.k, place.s, place.p, symbol) AS symbols FROM (SELECT id, symbol, min(struct_pack(k := kind, s := seq, p := phrase)) AS place FROM (
  SELECT id, b.symbol, 0 AS kind, t.pos AS seq, '' AS phrase FROM (SELECT id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[a-z]+)?') AS l FROM q_chat)) t
    JOIN q_brands b ON b.symbol = upper(split_part(tok, '.', 1))
  UNION ALL SELECT id, n.symbol, 1, -length(phrase), phrase FROM q_chat JOIN q_names n ON regexp_matches(lower(text), '\\b' || phrase || '\\b')) GROUP BY id, symbol) GROUP BY id""",
)
def _(spark, sf):
    part = v.table(spark, sf, "part")
    tick = F.replace(F.upper("p_brand"), F.lit("#"), F.lit(""))
    n = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    a = part.select(F.col("p_partkey").alias("ka"), F.col("p_name").alias("name"))
    b = part.select(F.col("p_partkey").alias("kb"), F.lower(tick).alias("brand"))
    o = v.table(spark, sf, "orders").withColumns({"ka": F.col("o_orderkey") % n, "kb": F.col("o_custkey") % n})
    text = F.concat(
        F.lit("Compare "), "brand", F.lit(".ns with "), F.upper("name"), F.lit(", or BRAND"),
        (F.col("o_custkey") % 30).cast("string"), F.lit(" please?"),
    )
    chat = o.join(a, "ka").join(b, "kb").select(F.col("o_orderkey").alias("id"), text.alias("text"))
    symbols = part.select(tick.alias("symbol")).distinct()
    names = part.groupBy(F.col("p_name").alias("phrase")).agg(F.min(tick).alias("symbol"))
    return intents.mention_lists(intents.mentions(chat, symbols, names)).withColumn("symbols", F.array_join("symbols", ","))


sql_view(
    "q_lexicon",
    """SELECT DISTINCT word, len(word) % 5 - 2 AS weight FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM benchmark) WHERE word <> ''""",
)


@query(
    "lexicon_sentiment",
    "doc_id:i, score:4, label",
    """SELECT doc_id, score, CASE WHEN score >= 0.35 THEN 'positive' WHEN score <= -0.35 THEN 'negative' ELSE 'neutral' END AS label FROM (
  SELECT d.doc_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 4) AS score FROM documents d LEFT JOIN (
    SELECT doc_id, CAST(sum(weight) AS DOUBLE) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM documents) JOIN q_lexicon USING (word) GROUP BY doc_id) x ON x.doc_id = d.doc_id)""",
)
def _(spark, sf):
    return lexicon(spark, sf)


def lexicon(spark, sf):
    words = (
        v.table(spark, sf, "benchmark")
        .select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
        .where("word <> ''")
        .distinct()
        .withColumn("weight", F.length("word") % 5 - 2)
    )
    return intents.lexicon_sentiment(v.table(spark, sf, "documents"), words, "doc_id", "text")


@query(
    "average_sentiment",
    "symbol, score:4",
    """SELECT symbol, coalesce(avg(CASE WHEN abs(score) > 0.35 THEN score END), 0) AS score FROM news GROUP BY symbol""",
)
def _(spark, sf):
    n = v.news(spark, sf).withColumn("label", F.when(F.coalesce(F.abs("score") > 0.35, F.lit(False)), "loud").otherwise("neutral"))
    return intents.average_sentiment(n, ["symbol"])


# ---- fundamentals --------------------------------------------------------------------

_DEBT = """CASE WHEN regexp_matches(lower(coalesce(sector, 'Unknown')), 'bank|financial|nbfc|insurance|capital market') THEN 85.0::DOUBLE WHEN de IS NULL THEN 80 WHEN de <= 0.3 THEN 100 WHEN de <= 0.8 THEN 85
  WHEN de <= 1.5 THEN greatest(50.0::DOUBLE, round(85.0::DOUBLE - (de - 0.8::DOUBLE) / 0.7::DOUBLE * 35, 1)) ELSE greatest(20.0::DOUBLE, round(50.0::DOUBLE - (de - 1.5::DOUBLE) * 20, 1)) END"""


def q_fund(src):
    g = lambda x: f"CASE WHEN {x} IS NULL THEN 7.0::DOUBLE WHEN {x} * 100 >= 15 THEN 12.5 WHEN {x} * 100 >= 8 THEN 10 WHEN {x} * 100 >= 0 THEN 7 ELSE 3.5 END"
    return f"""SELECT *, CASE WHEN t >= 75 THEN 'Strong Buy' WHEN t >= 65 THEN 'Buy' WHEN t >= 48 THEN 'Hold' WHEN t >= 35 THEN 'Sell' ELSE 'Strong Sell' END AS rating, t AS fundamental_score FROM (
  SELECT *, greatest(0, least(100, round(v + p + h + g, 1))) AS t FROM (SELECT *, CASE WHEN pe > 0 THEN CASE WHEN pe <= 10 THEN 24.0::DOUBLE WHEN pe <= 18 THEN 21 WHEN pe <= 28 THEN 17 WHEN pe <= 40 THEN 12 WHEN pe <= 60 THEN 7 ELSE 4 END ELSE 14 END AS v,
    CASE WHEN roe IS NULL THEN 8.0::DOUBLE WHEN roe * 100 >= 20 THEN 15 WHEN roe * 100 >= 14 THEN 12 WHEN roe * 100 >= 10 THEN 9 WHEN roe * 100 > 0 THEN 6 ELSE 2 END
      + CASE WHEN roce IS NULL THEN 5.0::DOUBLE WHEN roce * 100 >= 20 THEN 10 WHEN roce * 100 >= 12 THEN 8 WHEN roce * 100 >= 6 THEN 6 WHEN roce * 100 > 0 THEN 4 ELSE 1 END AS p,
    round({_DEBT} / 100 * 25 * 1.000000000001::DOUBLE, 1) AS h, {g('rev_growth')} + {g('profit_growth')} AS g FROM {src}))"""


@query(
    "fundamental_score",
    "symbol, valuation_score:1, profitability_score:1, health_score:1, growth_score:1, fundamental_score:1, rating",
    f"SELECT *, v AS valuation_score, p AS profitability_score, h AS health_score, g AS growth_score FROM ({q_fund('funda')})",
)
def _(spark, sf):
    return fu.fundamental_score(v.funda(spark, sf))


sql_view(
    "supbars",
    """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close
FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""",
)


def supbars(spark, sf):
    from ..sources.bars import bars_from_trades

    li = v.table(spark, sf, "lineitem").where("l_quantity > 0").withColumns(
        {
            "symbol": F.col("l_suppkey").cast("string"),
            "date": F.col("l_shipdate").cast("date"),
            "price": F.col("l_extendedprice") / F.col("l_quantity"),
        }
    )
    return bars_from_trades(li, qty="l_quantity", order=("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


_QEND = "CAST(last_day(CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 2 MONTH) AS DATE)"
sql_view(
    "q_qclose",
    f"""SELECT a.symbol, a.quarter_end, arg_max(b.close, b.date) AS close FROM (SELECT DISTINCT symbol, CASE WHEN date = {_QEND} THEN date ELSE CAST(date_trunc('quarter', date) AS DATE) - 1 END AS quarter_end FROM supbars) a
JOIN supbars b ON b.symbol = a.symbol AND b.date <= a.quarter_end GROUP BY 1, 2""",
)


@query("quarter_end_closes", "symbol, quarter_end:d, close:6", "SELECT * FROM q_qclose")
def _(spark, sf):
    return fu.quarter_end_closes(supbars(spark, sf))


sql_view(
    "q_ratios",
    """WITH w AS (SELECT symbol, quarter_end, """
    + ", ".join(f"max(amount) FILTER (item = '{i}') AS {i}" for i in fu.ITEMS)
    + """ FROM statements GROUP BY 1, 2)
SELECT w.symbol, w.quarter_end, w.quarter_end + 45 AS available_at, CASE WHEN w.diluted_eps > 0 AND c.close > 0 THEN c.close / w.diluted_eps END AS pe, w.diluted_eps AS eps, w.net_income / nullif(w.total_equity, 0) AS roe,
  CASE WHEN w.total_assets IS NOT NULL AND w.current_liabilities IS NOT NULL THEN CASE WHEN w.total_assets - w.current_liabilities > 0 THEN w.operating_income / (w.total_assets - w.current_liabilities) END
    WHEN w.total_equity + w.total_debt > 0 THEN w.operating_income / (w.total_equity + w.total_debt) END AS roce, w.total_debt / nullif(w.total_equity, 0) AS de, w.operating_income / nullif(w.total_revenue, 0) AS opm,
  w.total_revenue / nullif(o.total_revenue, 0) - 1 AS rev_growth, w.net_income / nullif(o.net_income, 0) - 1 AS profit_growth, 'Unknown' AS sector
FROM w LEFT JOIN q_qclose c ON c.symbol = w.symbol AND c.quarter_end = w.quarter_end
LEFT JOIN (SELECT a.symbol, a.quarter_end, max(b.quarter_end) AS oq FROM w a JOIN w b ON b.symbol = a.symbol AND b.quarter_end <= last_day(a.quarter_end - INTERVAL 12 MONTH) GROUP BY 1, 2) k ON k.symbol = w.symbol AND k.quarter_end = w.quarter_end
LEFT JOIN w o ON o.symbol = w.symbol AND o.quarter_end = k.oq""",
)
RATIOS = "symbol, quarter_end:d, available_at:d, pe:4, eps:4, roe:6, roce:6, de:6, opm:6, rev_growth:6, profit_growth:6"


def ratios(spark, sf):
    return fu.quarterly_ratios(v.statements(spark, sf), fu.quarter_end_closes(supbars(spark, sf)))


@query("quarterly_ratios", RATIOS, "SELECT * FROM q_ratios")
def _(spark, sf):
    return ratios(spark, sf)


@query("quarterly_fundamental_score", "symbol, quarter_end:d, fundamental_score:1, rating", q_fund("q_ratios"))
def _(spark, sf):
    return fu.fundamental_score(ratios(spark, sf))


@query(
    "coalesced_sources",
    "symbol, pe:2, roe:4, price:2",
    """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.pe, b.pe) AS pe, coalesce(a.roe, b.roe) AS roe, coalesce(a.price, b.price) AS price
FROM (SELECT * FROM funda WHERE price < 1500) a FULL JOIN (SELECT symbol, de * 5 AS pe, opm AS roe, price + 1 AS price FROM funda WHERE price > 1000) b ON a.symbol = b.symbol""",
)
def _(spark, sf):
    f = v.funda(spark, sf)
    second = f.where("price > 1000").select(
        "symbol", (F.col("de") * 5).alias("pe"), F.col("opm").alias("roe"), (F.col("price") + 1).alias("price")
    )
    return holdings.fill_from(f.where("price < 1500").select("symbol", "pe", "roe", "price"), second)


@query(
    "first_source",
    "symbol, priority:i, n:i",
    """SELECT symbol, priority, count(*) AS n FROM (SELECT *, min(priority) OVER (PARTITION BY symbol) AS best FROM (
  SELECT CAST(c_custkey % 601 AS VARCHAR) AS symbol, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS priority FROM customer)) WHERE priority = best GROUP BY 1, 2""",
)
def _(spark, sf):
    seg = F.col("c_mktsegment")
    rows = v.table(spark, sf, "customer").select(
        (F.col("c_custkey") % 601).cast("string").alias("symbol"),
        F.when(seg == "BUILDING", 1).when(seg == "MACHINERY", 2).otherwise(3).alias("priority"),
    )
    return holdings.first_source(rows).groupBy("symbol", "priority").agg(F.count(F.lit(1)).alias("n"))


sql_view(
    "q_card_parts",
    """SELECT c.*, q.close AS px FROM q_cards c JOIN (SELECT symbol, arg_max(close, date) AS close FROM weekly GROUP BY symbol) q ON q.symbol = c.symbol""",
)


@query(
    "symbol_card",
    "symbol, current_price:2, signal, roe_pct:4, sentiment:4, prob:6",
    """SELECT c.symbol, c.current_price, c.signal, f.roe * 100 AS roe_pct, n.s AS sentiment, p.p AS prob FROM q_cards c
LEFT JOIN (SELECT 'Brand#' || substr(symbol, 2) AS symbol, roe FROM funda) f ON f.symbol = c.symbol
LEFT JOIN (SELECT 'Brand#' || CAST(user_id % 20 AS VARCHAR) AS symbol, coalesce(avg(CASE WHEN event_type <> 'error' THEN (value - 245) / 245 END), 0) AS s FROM events GROUP BY 1) n ON n.symbol = c.symbol
LEFT JOIN (SELECT 'Brand#' || CAST(id % 15 AS VARCHAR) AS symbol, avg(p) AS p FROM preds GROUP BY 1) p ON p.symbol = c.symbol""",
)
def _(spark, sf):
    brand = lambda c: F.concat(F.lit("Brand#"), c)
    f = v.funda(spark, sf).select(brand(F.expr("substring(symbol, 2)")).alias("symbol"), (F.col("roe") * 100).alias("roe_pct"))
    e = v.table(spark, sf, "events")
    n = e.groupBy(brand((F.col("user_id") % 20).cast("string")).alias("symbol")).agg(
        F.coalesce(F.avg(F.when(F.col("event_type") != "error", (F.col("value") - 245) / 245)), F.lit(0.0)).alias("sentiment")
    )
    p = v.preds(spark, sf).groupBy(brand((F.col("id") % 15).cast("string")).alias("symbol")).agg(F.avg("p").alias("prob"))
    return joins.latest_card({"card": cards(spark, sf), "fundamentals": f, "news": n, "forecast": p})


_AN = """CASE WHEN sma20 > sma50 THEN 20 WHEN sma20 <= sma50 THEN -20 ELSE 0 END + CASE WHEN price > sma20 THEN 10 WHEN price <= sma20 THEN -10 ELSE 0 END
  + CASE WHEN rsi < 30 THEN 0 WHEN rsi > 70 THEN -10 WHEN rsi BETWEEN 40 AND 60 THEN 5 ELSE 0 END + CASE WHEN macd > macd_signal THEN 10 WHEN macd <= macd_signal THEN -10 ELSE 0 END
  + CASE WHEN roe >= 15 THEN 10 WHEN roe >= 10 THEN 5 WHEN roe < 0 THEN -5 ELSE 0 END + CASE WHEN opm >= 20 THEN 5 WHEN opm < 5 THEN -5 ELSE 0 END
  + CASE WHEN rg > 0 THEN 5 WHEN rg <= 0 THEN -5 ELSE 0 END + CASE WHEN pg > 0 THEN 5 WHEN pg <= 0 THEN -5 ELSE 0 END
  + CASE WHEN de > 2 THEN -5 WHEN de >= 0 AND de < 1 THEN 5 ELSE 0 END + CASE WHEN s > 0.2 THEN 10 WHEN s < -0.2 THEN -10 ELSE 0 END"""


@query(
    "analyst_score",
    "symbol, score:i, action",
    f"""SELECT symbol, score, CASE WHEN score >= 75 THEN 'STRONG BUY' WHEN score >= 60 THEN 'BUY' WHEN score >= 45 THEN 'HOLD' WHEN score >= 30 THEN 'SELL' ELSE 'STRONG SELL' END AS action FROM (
  SELECT symbol, greatest(0, least(100, CASE WHEN prob IS NOT NULL THEN CAST(trunc(0.4::DOUBLE * sc + 0.6::DOUBLE * (prob * 100)) AS INTEGER) ELSE sc END)) AS score FROM (SELECT symbol, prob, 50 + {_AN} AS sc FROM (
    SELECT f.symbol, f.price, f.price * (0.9::DOUBLE + k % 5 * 0.05::DOUBLE) AS sma20, f.price * (0.92::DOUBLE + k % 7 * 0.03::DOUBLE) AS sma50, CASE WHEN k % 5 <> 0 THEN k % 101 END AS rsi, k % 11 - 5 AS macd, k % 7 - 3 AS macd_signal,
      roe * 100 AS roe, opm * 100 AS opm, rev_growth AS rg, profit_growth AS pg, de, CASE WHEN k % 3 <> 0 THEN (k % 21 - 10) / 10.0::DOUBLE END AS s, CASE WHEN k % 4 <> 0 THEN k % 100 / 100.0::DOUBLE END AS prob
    FROM (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS k FROM funda) f)))""",
)
def _(spark, sf):
    k = F.substring("symbol", 2, 12).cast("bigint")
    f = v.funda(spark, sf).select(
        "symbol", "price",
        (F.col("price") * (0.9 + k % 5 * 0.05)).alias("sma20"),
        (F.col("price") * (0.92 + k % 7 * 0.03)).alias("sma50"),
        F.when(k % 5 != 0, k % 101).alias("rsi"),
        (k % 11 - 5).alias("macd"),
        (k % 7 - 3).alias("macd_signal"),
        (F.col("roe") * 100).alias("roe"),
        (F.col("opm") * 100).alias("opm"),
        F.col("rev_growth").alias("revenue_growth"),
        "profit_growth",
        F.col("de").alias("debt_equity"),
        F.when(k % 3 != 0, (k % 21 - 10) / 10.0).alias("sentiment"),
        F.when(k % 4 != 0, k % 100 / 100.0).alias("probability"),
    )
    return screen.analyst_score(f)


# ---- policies ------------------------------------------------------------------------


@query(
    "signal_policy",
    "id:i, signal, direction:i, confidence:6, effective_buy:2",
    """SELECT id, CASE WHEN c < 0.08 THEN 'HOLD' WHEN p >= tb THEN 'BUY' WHEN p <= 0.4 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN c < 0.08 THEN 0 WHEN p >= tb THEN 1 WHEN p <= 0.4 THEN -1 ELSE 0 END AS direction, c AS confidence, tb AS effective_buy FROM (
  SELECT p.id, p.p, abs(p.p - 0.5) * 2 AS c, CASE WHEN regime_trend = -1 THEN greatest(b, 0.62::DOUBLE) ELSE b END AS tb FROM (SELECT *, CASE symbol WHEN 'A' THEN 0.66::DOUBLE WHEN 'N' THEN 0.55::DOUBLE ELSE 0.6::DOUBLE END AS b FROM preds) p LEFT JOIN q_trend t ON t.date = p.date)""",
)
def _(spark, sf):
    own = spark.createDataFrame([("A", 0.66), ("N", 0.55)], "symbol string, buy double")
    return policy.decide(regimed(spark, sf), thresholds=own, trend="regime_trend", allow_short=True)


@query(
    "quality_gate",
    "id:i, signal, p:6, gated:b",
    f"""SELECT id, CASE WHEN g THEN 'HOLD' WHEN abs(p - 0.5) * 2 < 0.08 THEN 'HOLD' WHEN p >= 0.6 THEN 'BUY' WHEN p <= 0.4 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN g THEN base ELSE p END AS p, g AS gated
FROM (SELECT x.id, x.p, a.auc < 0.5 AS g, r.base FROM preds x JOIN ({q_auc('symbol')}) a ON a.symbol = x.symbol JOIN (SELECT symbol, avg(y) AS base FROM preds WHERE fold = 3 GROUP BY symbol) r ON r.symbol = x.symbol)""",
)
def _(spark, sf):
    p = v.preds(spark, sf)
    auc = metrics.scorecard(p, ["symbol"]).select("symbol", "auc")
    base = p.where("fold = 3").groupBy("symbol").agg(F.avg("y").alias("base_rate"))
    return policy.quality_gate(policy.decide(p), auc, base, 0.5)


_W = {"1-URGENT": 0.4, "2-HIGH": 0.2, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.1, "5-LOW": 0.1}


@query(
    "ensemble_average",
    "symbol, date:d, prob:6, disagreement:6, n_models:i",
    f"""SELECT symbol, date, sum(w * p) / sum(w) AS prob, stddev_pop(p) AS disagreement, count(p) AS n_models FROM (
  SELECT *, CASE model {' '.join(f"WHEN '{m}' THEN {x}::DOUBLE" for m, x in _W.items())} END AS w FROM (SELECT symbol, date, model, avg(p) AS p FROM preds GROUP BY 1, 2, 3)) GROUP BY symbol, date""",
)
def _(spark, sf):
    long = metrics.average_seeds(v.preds(spark, sf), ["symbol", "date", "model"])
    return policy.ensemble(long, ["symbol", "date"], weights=_W)


sql_view("q_own", "SELECT symbol, date, avg(p) AS p, min(y) AS y FROM preds WHERE model < '3' GROUP BY 1, 2")
sql_view("q_pool", "SELECT symbol, date, avg(q) AS p, min(y) AS y FROM preds WHERE model > '2' GROUP BY 1, 2")


@query(
    "blended_auc",
    "weight:2, auc:6, n:i",
    f"""SELECT w AS weight, auc, n FROM ({q_auc('w', src='(SELECT x.w, x.w * b.p + (1 - x.w) * a.p AS p, a.y FROM q_own a JOIN q_pool b ON a.symbol = b.symbol AND a.date = b.date, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) x(w))')})""",
)
def _(spark, sf):
    p = v.preds(spark, sf)
    own = metrics.average_seeds(p.where("model < '3'"), ["symbol", "date"])
    pool = metrics.average_seeds(p.where("model > '2'").drop("p").withColumnRenamed("q", "p"), ["symbol", "date"])
    return metrics.scorecard(policy.blend(pool, own, ["symbol", "date"]), ["weight"])


sql_view(
    "q_unc",
    """SELECT *, abs(probability - 0.5) AS margin, -(probability * ln(greatest(probability, 1e-12)) + (1 - probability) * ln(greatest(1 - probability, 1e-12))) AS entropy FROM (
  SELECT id, symbol, fold, seed, y, ret, p, CASE WHEN r IS NULL THEN (p + q) / 2 ELSE (p + q + r) / 3 END AS probability,
    CASE WHEN r IS NULL THEN sqrt((power(p - (p + q) / 2, 2) + power(q - (p + q) / 2, 2)) / 2) ELSE sqrt((power(p - (p + q + r) / 3, 2) + power(q - (p + q + r) / 3, 2) + power(r - (p + q + r) / 3, 2)) / 3) END AS disagreement
  FROM (SELECT *, CASE WHEN id % 5 <> 0 THEN (id * 31 % 101) / 100.0::DOUBLE END AS r FROM preds))""",
)


def uncertain(spark, sf):
    p = v.preds(spark, sf).withColumn("r", F.when(F.col("id") % 5 != 0, (F.col("id") * 31 % 101) / 100.0))
    return policy.uncertainty(p, ["p", "q", "r"])


@query("uncertainty", "id:i, probability:6, disagreement:6, margin:6, entropy:6", "SELECT * FROM q_unc")
def _(spark, sf):
    return uncertain(spark, sf)


def q_class_q(src, keys):
    """Order statistic at ceil(q(n-1)) of each class."""
    return f"""SELECT {keys}, max(s) FILTER (y = 0 AND k = r) AS q0, max(s) FILTER (y = 1 AND k = r) AS q1 FROM (SELECT *, CAST(ceil(least(1.0::DOUBLE, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1)) AS BIGINT) + 1 AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys}, y ORDER BY s) AS k, count(*) OVER (PARTITION BY {keys}, y) AS n FROM (SELECT *, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM {src}))) GROUP BY {keys}"""


sql_view("q_foldq", q_class_q("(SELECT f.f AS fold, p.p, p.y FROM preds p JOIN (VALUES (0), (1), (2), (3)) f(f) ON p.fold < f.f)", "fold"))


@query("conformal_class_quantiles", "symbol, q0:6, q1:6", q_class_q("preds", "symbol"))
def _(spark, sf):
    return policy.class_quantiles(v.preds(spark, sf), ["symbol"])


@query("conformal_fold_quantiles", "fold:i, q0:6, q1:6", "SELECT * FROM q_foldq")
def _(spark, sf):
    return policy.earlier_fold_quantiles(v.preds(spark, sf), [0, 1, 2, 3])


_RULE_SQL = []
for _n, _k, _t in policy.RULES:
    _ok = {"always": "true", "margin": f"margin >= {_t}", "disagreement": f"disagreement <= {_t}", "entropy": f"entropy <= {_t}",
           "conformal": "coalesce((p <= q0) <> (1 - p <= q1), false)"}[_k]
    _ch = "CASE WHEN 1 - p <= q1 THEN 1 ELSE 0 END" if _k == "conformal" else "CASE WHEN p >= 0.5 THEN 1 ELSE 0 END"
    _RULE_SQL.append(f"SELECT *, '{_n}' AS policy, {_ok} AS accepted, CASE WHEN {_ok} THEN {_ch} ELSE -1 END AS decision FROM (SELECT u.*, q0, q1 FROM q_unc u LEFT JOIN q_foldq f ON f.fold = u.fold)")
sql_view("q_sel", " UNION ALL ".join(_RULE_SQL))


def selected(spark, sf):
    return policy.selective(uncertain(spark, sf), policy.earlier_fold_quantiles(v.preds(spark, sf), [0, 1, 2, 3]))


@query("selective_policies", "id:i, policy, accepted:b, decision:i", "SELECT * FROM q_sel")
def _(spark, sf):
    return selected(spark, sf)


def q_selm(keys):
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""SELECT a.*, b.accuracy, 1 - b.accuracy AS selective_risk, b.auc AS roc_auc, b.brier, b.ece FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (accepted) / CAST(count(*) AS DOUBLE) AS coverage,
  avg(CASE WHEN p >= 0.5 THEN ret ELSE -ret END) FILTER (accepted) AS mean_signed_return, avg(CASE WHEN CASE WHEN p >= 0.5 THEN ret ELSE -ret END > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (accepted) AS win_rate_return
  FROM q_sel GROUP BY {keys}) a LEFT JOIN ({q_score(keys, '(SELECT * FROM q_sel WHERE accepted)')}) b ON {on}"""


@query(
    "selective_metrics",
    "policy, n:i, n_accepted:i, coverage:6, accuracy:6, selective_risk:6, roc_auc:6, brier:6, ece:6, mean_signed_return:6, win_rate_return:6",
    q_selm("policy"),
)
def _(spark, sf):
    return policy.selective_metrics(selected(spark, sf), ["policy"], ret="ret")


sql_view("q_selp", q_selm("policy"))
sql_view("q_sels", q_selm("policy, seed"))


@query(
    "selective_verdict",
    "policy, accuracy_uplift:6, risk_reduction:6, seed_robust:b, verdict",
    """SELECT *, CASE WHEN coverage >= 0.3 AND accuracy_uplift >= 0.02 AND risk_reduction >= 0.02 AND seed_robust THEN 'PROMISING_RESEARCH_ONLY' ELSE 'NOT_SUPPORTED' END AS verdict FROM (
  SELECT p.policy, p.coverage, p.accuracy - b.accuracy AS accuracy_uplift, b.selective_risk - p.selective_risk AS risk_reduction, (SELECT bool_and(coalesce(s.coverage >= 0.2 AND s.selective_risk <= b.selective_risk, false)) FROM q_sels s WHERE s.policy = p.policy) AS seed_robust
  FROM q_selp p, (SELECT * FROM q_selp WHERE policy = 'always_accept') b WHERE p.policy <> 'always_accept')""",
)
def _(spark, sf):
    s = selected(spark, sf)
    return policy.selective_verdict(policy.selective_metrics(s, ["policy"]), policy.selective_metrics(s, ["policy", "seed"]))


_WEIGHT = " + ".join(f"CASE WHEN u > CAST({x!r} AS DOUBLE) THEN 1 ELSE 0 END" for x in bootstrap.POISSON)
sql_view(
    "q_paired",
    """SELECT brand, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) FILTER (accepted) - avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS delta
FROM (SELECT *, symbol || '/' || CAST(id % 40 AS VARCHAR) AS brand FROM q_sel WHERE policy = 'candidate_a_entropy') GROUP BY brand""",
)


@query(
    "entropy_verdict",
    "policy, n:i, n_retained:i, coverage:6, accuracy_uplift:6, risk_reduction:6, n_symbols:i, delta:6, ci_lower:6, ci_upper:6, se:6, classification",
    f"""SELECT *, CASE WHEN coverage IS NOT NULL AND NOT (coverage >= 0.3 AND coalesce(accuracy_uplift >= 0.02 AND risk_reduction >= 0.02, false)) THEN 'REJECTED' ELSE 'EVIDENCE STILL INSUFFICIENT' END AS classification FROM (
  SELECT p.policy, p.n, p.n_accepted AS n_retained, p.coverage, p.accuracy - b.accuracy AS accuracy_uplift, b.selective_risk - p.selective_risk AS risk_reduction,
    (SELECT count(delta) FROM q_paired) AS n_symbols, (SELECT avg(delta) FROM q_paired) AS delta, ci_lower, ci_upper, se
  FROM q_selp p, (SELECT * FROM q_selp WHERE policy = 'always_accept') b, (SELECT quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper, stddev_samp(m) AS se FROM (
    SELECT b, sum(w * delta) / sum(w) AS m FROM (SELECT b, delta, {_WEIGHT} AS w FROM (
      SELECT b, delta, CAST(CAST('0x' || substr(md5('17:' || b || ':' || brand), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM q_paired, range(1, 2001) r(b) WHERE delta IS NOT NULL)) GROUP BY b))
  WHERE p.policy = 'candidate_a_entropy')""",
)
def _(spark, sf):
    # The orders' three flags are too few to resample; each is dealt into forty accounts.
    rows = selected(spark, sf).withColumn("brand", F.concat_ws("/", "symbol", (F.col("id") % 40).cast("string")))
    return bootstrap.entropy_validation(rows, "brand")


@query(
    "pooled_verdict",
    "median_delta:6, wins:i, n_symbols:i, verdict",
    """SELECT *, CASE WHEN median_delta > 0.02 AND wins / n_symbols >= 0.7 THEN 'IMPLEMENT POOLED V2' WHEN median_delta <= 0 OR wins / n_symbols < 0.5 THEN 'KEEP FROZEN V1' ELSE 'EVIDENCE STILL INSUFFICIENT' END AS verdict FROM (
  SELECT (SELECT median(delta) FROM q_deltas) AS median_delta, CAST(count(*) FILTER (d > 0) AS DOUBLE) AS wins, count(*) AS n_symbols FROM (SELECT symbol, median(delta) AS d FROM q_deltas GROUP BY symbol))""",
)
def _(spark, sf):
    from ..functions import ranking
    from ..functions.tables import one_row

    p = v.preds(spark, sf)
    d = metrics.auc_deltas(p, ["symbol", "fold"], "q", "p")
    folds = metrics.auc_deltas(p, ["fold"], "q", "p")
    seeds = metrics.auc_deltas(p, ["seed"], "q", "p")
    row = one_row(ranking.median(d, [], "delta", "median_delta"), metrics.win_loss(d), metrics.robustness(folds, seeds))
    return policy.pooled_verdict(row)


@query(
    "conformal_band",
    "symbol, n_calibration:i, half_width:6, is_wide:b, status",
    """SELECT symbol, n AS n_calibration, max(s) FILTER (k = r) AS half_width, max(s) FILTER (k = r) >= 0.5 AS is_wide, 'ok' AS status FROM (SELECT *, least(ceil((n + 1) * 0.9::DOUBLE), n) AS r FROM (
  SELECT symbol, abs(p - y) AS s, row_number() OVER (PARTITION BY symbol ORDER BY abs(p - y)) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM preds WHERE fold < 3)) GROUP BY symbol, n""",
)
def _(spark, sf):
    return policy.conformal_band(v.preds(spark, sf).where("fold < 3"), ["symbol"])


sql_view(
    "q_band",
    """SELECT symbol, max(s) FILTER (k = r) AS half_width FROM (SELECT *, least(ceil((n + 1) * 0.9::DOUBLE), n) AS r FROM (
  SELECT symbol, abs(p - y) AS s, row_number() OVER (PARTITION BY symbol ORDER BY abs(p - y)) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM preds WHERE fold < 3)) GROUP BY symbol""",
)


@query(
    "conformal_intervals",
    "id:i, lower:4, upper:4",
    "SELECT id, greatest(p - half_width, 0) AS lower, least(p + half_width, 1) AS upper FROM preds p JOIN q_band b ON b.symbol = p.symbol WHERE fold = 3",
)
def _(spark, sf):
    p = v.preds(spark, sf)
    return policy.apply_band(p.where("fold = 3"), policy.conformal_band(p.where("fold < 3"), ["symbol"]), ["symbol"])


@query(
    "conformal_coverage",
    "symbol, n:i, coverage:4",
    "SELECT p.symbol, count(*) AS n, avg(CASE WHEN abs(p - y) <= half_width THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM preds p JOIN q_band b ON b.symbol = p.symbol WHERE fold = 3 GROUP BY 1",
)
def _(spark, sf):
    p = v.preds(spark, sf)
    return policy.band_coverage(p.where("fold = 3"), policy.conformal_band(p.where("fold < 3"), ["symbol"]), ["symbol"])


@query(
    "null_controls",
    "policy, control, n:i, n_accepted:i, accuracy:6",
    """SELECT policy, control, count(*) AS n, count(*) FILTER (taken) AS n_accepted, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) FILTER (taken) AS accuracy FROM (
  SELECT policy, p, y, control, CASE control WHEN 'always_accept' THEN true WHEN 'always_abstain' THEN false
    ELSE CAST(CAST('0x' || substr(md5('17:' || policy || ':' || id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < coverage END AS taken
  FROM q_sel JOIN (SELECT policy, coverage FROM q_selp) USING (policy), (VALUES ('always_accept'), ('always_abstain'), ('random_accept')) k(control)) GROUP BY policy, control""",
)
def _(spark, sf):
    rows = selected(spark, sf)
    cover = policy.selective_metrics(rows, ["policy"]).select("policy", "coverage")
    return policy.null_controls(rows.drop("accepted", "decision"), cover, "policy", "id")


@query(
    "constant_controls",
    "symbol, control, accuracy:6, brier:6",
    """SELECT symbol, control, avg(CASE WHEN (c >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg((c - y) * (c - y)) AS brier FROM (
  SELECT t.symbol, t.y, unnest(['train_prior', 'always_up', 'always_down']) AS control, unnest([a.prior, 1.0::DOUBLE, 0.0::DOUBLE]) AS c FROM preds t JOIN (SELECT symbol, avg(y) AS prior FROM preds WHERE fold < 3 GROUP BY symbol) a ON a.symbol = t.symbol WHERE fold = 3) GROUP BY 1, 2""",
)
def _(spark, sf):
    p = v.preds(spark, sf)
    return policy.prior_controls(p.where("fold < 3"), p.where("fold = 3"), "symbol")


@query(
    "threshold_search",
    "symbol, buy:2, n_long:i, accuracy:4",
    f"""SELECT symbol, b.buy, b.n_long, b.accuracy FROM (SELECT symbol, max(struct_pack(accuracy := accuracy, n_long := n_long, nb := -buy, buy := buy)) AS b FROM (
  SELECT symbol, g AS buy, count(*) AS n_long, round(avg(y), 4) AS accuracy FROM preds, (VALUES {', '.join(f'({g}::DOUBLE)' for g in policy.GRID)}) v(g) WHERE p >= g AND abs(p - 0.5) * 2 >= 0.08 GROUP BY 1, 2 HAVING count(*) >= 50) GROUP BY symbol)""",
)
def _(spark, sf):
    return policy.best_thresholds(v.preds(spark, sf), ["symbol"])


@query(
    "threshold_search_by_regime",
    "bear:b, buy:2, n_long:i, accuracy:4",
    f"""SELECT bear, b.buy, b.n_long, b.accuracy FROM (SELECT bear, max(struct_pack(accuracy := accuracy, n_long := n_long, nb := -buy, buy := buy)) AS b FROM (
  SELECT bear, g AS buy, count(*) AS n_long, round(avg(y), 4) AS accuracy FROM (SELECT p.*, coalesce(regime_trend = -1, false) AS bear FROM preds p LEFT JOIN q_trend t ON t.date = p.date), (VALUES {', '.join(f'({g}::DOUBLE)' for g in policy.GRID)}) v(g)
  WHERE p >= CASE WHEN bear THEN greatest(g, 0.62::DOUBLE) ELSE g END AND abs(p - 0.5) * 2 >= 0.08 GROUP BY 1, 2 HAVING count(*) >= 50) GROUP BY bear)""",
)
def _(spark, sf):
    rows = regimed(spark, sf).withColumn("bear", F.coalesce(F.col("regime_trend") == -1, F.lit(False)))
    return policy.best_thresholds(rows, ["bear"], bear="bear")
