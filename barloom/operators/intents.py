"""Free-text screening requests and symbol mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import col

# Patterns of the accepted phrases (English and Hinglish).
NUMBER = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
_PRICE = (
    r"[₹\s]*" + NUMBER + r"\s*(?:[-/]*\s*)?(?:rupees?|rupay\w*|rp|rps|rs\.?|inr)?\s*(?:ke|ka|ki|wale)?\s*"
)
MAX_PRICE = [
    r"(?i)(?:under|below|less(?:er)?\s+than|cheaper\s+than|upto|up\s+to|max(?:imum)?|at\s+most|matlab)\s*[₹\s]*" + NUMBER,
    r"(?i)" + _PRICE + r"(?:se\s+)?(?:kam|neeche|niche|below|under|less\s+than)\b",
    r"<\s*" + NUMBER,
]
MIN_PRICE = [
    r"(?i)(?:above|over|more\s+than|greater\s+than|min(?:imum)?|at\s+least)\s*[₹\s]*" + NUMBER,
    r"(?i)" + _PRICE + r"(?:se\s+)?(?:zyada|upar|ooper|bada|badaa|above|over|more\s+than)\b",
    r">\s*" + NUMBER,
]
ACTIONS = {
    "strong_buy": r"(?i)\b(strong\s*buy|strong\s*bullish|strongly\s+bullish|very\s+bullish|super\s+bullish|bahut\s+bullish)\b",
    "buy": r"(?i)\b(buy|bullish|bull|bullish-keeda|positive|kharid|khareed|kharido|le\s+sak)\b",
    "strong_sell": r"(?i)\b(strong\s*sell|strong\s*bearish|strongly\s+bearish|very\s+bearish|super\s+bearish|bahut\s+bearish)\b",
    "sell": r"(?i)\b(sell|bearish|bear|bearish-keeda|negative|becho|bech)\b",
    "hold": r"(?i)\b(hold|neutral|sideways)\b",
}
TOP = r"(?i)(?:top|best|pehle|sabse|list)\s*[of]?\s*" + NUMBER
DAYS = (
    r"(?i)(\d{1,2})\s*(?:din|dino|dinon|days?|dives)\s*(?:se|ka|ke)?\s*"
    r"(?:bullish|upar|ooper|badh\s*raha|up\s*trend|chadh)"
)
NOT_A_PRICE = (
    r"(?i)" + NUMBER
    + r"\s*(?:(?:din|dino|dinon|dives|days?|saals?|salo|mohine|months?|years?|weeks?|percent)\b|%)"
)
BARE = r"[₹\s]*" + NUMBER + r"\s*(?:wale|ke|ka|ki|price|stocks)?\b"
PENNY = r"(?i)\bpenn(y|i)?\b"


def _number(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", F.replace(hit, F.lit(","), F.lit("")).cast("double"))


def _first(text: Column, patterns: list[str]) -> Column:
    return F.round(F.coalesce(*[_number(text, p) for p in patterns]), 2)


def parse_intent(messages: DataFrame, text: str = "text", longest: int | None = None) -> DataFrame:
    """Add max_price, min_price, action, bullish_days and top to each message.

    ``bullish_days`` is at most 60 and ``top`` from 1 to 50. A bare number counts as a price in
    messages of any length, or of less than ``longest`` characters.
    """
    t = F.col(text)
    action = F.lit(None).cast("string")
    for name, pattern in reversed(ACTIONS.items()):
        action = F.when(t.rlike(pattern), name).otherwise(action)
    days = F.regexp_extract(t, DAYS, 1)
    top = _number(t, TOP)
    out = messages.withColumns(
        {
            "_max": _first(t, MAX_PRICE),
            "min_price": _first(t, MIN_PRICE),
            "action": action,
            "bullish_days": F.when(days != "", F.least(days.try_cast("int"), F.lit(60))),
            "top": F.when(
                top.isNotNull(), F.least(F.greatest(top.cast("int"), F.lit(1)), F.lit(50))
            ).otherwise(10),
        }
    )
    bare = F.when(
        F.col("_max").isNull()
        & F.col("min_price").isNull()
        & ~t.rlike(NOT_A_PRICE)
        & (F.lit(True) if longest is None else F.length(t) < longest),
        F.round(_number(t, BARE), 2),
    )
    priced = F.coalesce("_max", bare)
    penny = F.when(t.rlike(PENNY), 100.0)
    return out.withColumn("max_price", F.coalesce(priced, penny)).drop("_max")


def mentions(messages: DataFrame, symbols: DataFrame, names: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Symbols named in each message: tickers in order of appearance, then company
    phrases, longest first. ``names`` is ``(phrase, symbol)``.

    Tokens are matched by an equality join. Phrases of any number of words meet a message
    at their first word and are then compared whole, so the dictionary is never scanned
    per message. An underscore is part of a word.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    tokens = messages.select(
        key, F.posexplode(F.regexp_extract_all(low, F.lit(r"([a-z0-9]+(?:\.[a-z]+)?)"), 1)).alias("pos", "tok")
    ).select(key, "pos", F.upper(F.substring_index("tok", ".", 1)).alias("symbol"))
    direct = tokens.join(symbols.select("symbol").distinct(), "symbol").select(
        key, "symbol", F.lit(0).alias("kind"), F.col("pos").alias("seq"), F.lit("").alias("phrase")
    )
    trim = r"^[^a-z0-9]+|[^a-z0-9]+$"
    words = messages.select(key, F.split(F.regexp_replace(low, r"[^a-z0-9_ .&-]", " "), " ").alias("ws"))
    starts = words.select(key, "ws", F.posexplode("ws").alias("at", "word")).select(
        key, F.regexp_replace("word", trim, "").alias("first"), "ws", "at"
    )
    known = names.select(
        "phrase", "symbol", F.size(F.split("phrase", " ")).alias("size"),
        F.regexp_replace(F.substring_index("phrase", " ", 1), trim, "").alias("first"),
    )
    group = F.array_join(F.slice("ws", F.col("at") + 1, F.col("size")), " ")
    phrase = (
        starts.where("first <> ''").join(known, "first").where(F.regexp_replace(group, trim, "") == F.col("phrase"))
        .select(key, "symbol", F.lit(1).alias("kind"), (-F.length("phrase")).alias("seq"), "phrase").distinct()
    )
    best = F.min(F.struct("kind", "seq", "phrase"))
    return direct.unionByName(phrase).groupBy(key, "symbol").agg(best.alias("at"))


def mention_lists(found: DataFrame, key: str = "id", limit: int | None = None) -> DataFrame:
    """Ordered symbols per message."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda s: s["symbol"]
    )
    if limit:
        ordered = F.slice(ordered, 1, limit)
    return found.groupBy(key).agg(ordered.alias("symbols"))


def lexicon_sentiment(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """Lexicon score in [-1, 1] of whole texts; blank or unmatched texts are neutral.

    Words are counted per text before they meet the lexicon, so one long text or one
    frequent word does not multiply rows.
    """
    words = texts.select(key, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    total = (
        counted.join(lexicon.select("word", "weight"), "word")
        .groupBy(key)
        .agg(F.sum(F.col("n") * F.col("weight")).cast("double").alias("_s"))
    )
    s = F.coalesce("_s", F.lit(0.0))
    score = F.round(s / F.sqrt(s * s + 15.0), 4)
    out = texts.select(key).join(total, key, "left").withColumn("score", score)
    label = F.when(F.col("score") >= 0.35, "positive").when(F.col("score") <= -0.35, "negative").otherwise("neutral")
    return out.select(key, "score", label.alias("label"))


def average_sentiment(articles: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of the non-neutral articles, 0 without any."""
    loud = F.when(F.col("label") != "neutral", F.col("score"))
    return articles.groupBy(*keys).agg(F.round(F.coalesce(F.avg(loud), F.lit(0.0)), 4).alias("score"))
