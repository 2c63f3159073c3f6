"""Panels derived from the driver tables; each has an SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as w
from ..sources.bars import bars_from_trades
from .registry import sql_view

TIES = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trades(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_quantity") > 0)
        .select(
            F.col("l_returnflag").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            F.col("l_shipdate").cast("date").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"),
            *TIES[1:],
        )
    )


sql_view(
    "trades",
    """SELECT l_returnflag AS symbol, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS date,
  l_extendedprice / l_quantity AS price, l_quantity AS qty,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem WHERE l_quantity > 0""",
)

_SQL_TIES = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def bars(spark, sf) -> DataFrame:
    """Daily bars of three symbols over the full shipping calendar."""
    return bars_from_trades(trades(spark, sf), order=TIES)


sql_view(
    "bars",
    f"""SELECT symbol, date, first(price ORDER BY {_SQL_TIES}) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY {_SQL_TIES}) AS close, sum(qty) AS volume
FROM trades GROUP BY symbol, date""",
)


def weekly(spark, sf) -> DataFrame:
    """Weekly bars by brand with a sector number; the cross-section panel."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    rows = (
        trades(spark, sf)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumns({"symbol": F.col("brand"), "date": F.trunc("date", "week")})
    )
    number = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    return bars_from_trades(rows, order=TIES).withColumn(
        "sector", F.concat(F.lit("S"), (number % 5).cast("string"))
    )


sql_view(
    "weekly",
    f"""SELECT symbol, date, open, high, low, close, volume,
  'S' || CAST(CAST(regexp_extract(symbol, '(\\d+)', 1) AS INTEGER) % 5 AS VARCHAR) AS sector
FROM (SELECT p_brand AS symbol, CAST(date_trunc('week', date) AS DATE) AS date,
  first(price ORDER BY {_SQL_TIES}) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY {_SQL_TIES}) AS close, sum(qty) AS volume
  FROM trades JOIN part ON l_partkey = p_partkey
  GROUP BY p_brand, CAST(date_trunc('week', date) AS DATE))""",
)


def _average_price(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg((F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("close"))


def market(spark, sf) -> DataFrame:
    """Volume-weighted price over all symbols on all days."""
    return _average_price(trades(spark, sf))


sql_view("market", "SELECT date, sum(price * qty) / sum(qty) AS close FROM trades GROUP BY date")


def ragged_market(spark, sf) -> DataFrame:
    """The market on a calendar of its own, which lacks three days a year; only for the alignment of calendars."""
    return market(spark, sf).where(~F.dayofyear("date").isin(44, 45, 47))


sql_view("ragged_market", "SELECT * FROM market WHERE dayofyear(date) NOT IN (44, 45, 47)")


def volx(spark, sf, average: DataFrame | None = None) -> DataFrame:
    """Volatility index on the market's own calendar."""
    m = (market(spark, sf) if average is None else average).withColumn("_one", F.lit(1))
    m = m.withColumn("r", w.pct_change("close", 1, keys=("_one",)))
    m = m.withColumn("v", w.roll_std("r", 20, keys=("_one",)) * 100)
    return m.where(F.col("v").isNotNull()).select("date", F.col("v").alias("close"))


sql_view(
    "volx",
    """SELECT date, v AS close FROM (
  SELECT date, CASE WHEN count(r) OVER q = 20 THEN stddev_pop(r) OVER q * 100 END AS v
  FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM market)
  WINDOW q AS (ORDER BY date ROWS 19 PRECEDING)) WHERE v IS NOT NULL""",
)


def series(spark, sf) -> DataFrame:
    """Two macro series: order totals and account flow, each on its own calendar."""
    orders = table(spark, sf, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        orders.withColumn("series_id", F.when(urgent, "demand").otherwise("supply"))
        .where(~((F.col("series_id") == "supply") & (F.dayofyear("date") % 90 == 0)))
        .groupBy("series_id", "date")
        .agg((F.sum((F.col("o_totalprice") * 100).cast("bigint")) / 100000.0).alias("close"))
    )


sql_view(
    "series",
    """SELECT series_id, date, sum(CAST(trunc(o_totalprice * 100) AS BIGINT)) / 100000.0::DOUBLE AS close FROM (
  SELECT *, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'demand' ELSE 'supply' END AS series_id
  FROM orders) WHERE NOT (series_id = 'supply' AND dayofyear(date) % 90 = 0)
GROUP BY series_id, date""",
)


def _flag(key):
    return F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (key % 3 + 1).cast("int"))


_SQL_FLAG = "['A', 'N', 'R'][1 + CAST({0} % 3 AS INTEGER)]"


def snaps(spark, sf) -> DataFrame:
    """Fundamental snapshots with NULL metrics, several per day."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        _flag(F.col("o_custkey")).alias("symbol"),
        F.col("o_orderdate").cast("date").alias("available_at"),
        key.alias("seq"),
        F.when(key % 7 != 0, F.col("o_totalprice") / 10000).alias("pe_ratio"),
        F.when(key % 11 != 0, (F.col("o_custkey") % 40) / 100.0).alias("roe"),
        ((key % 25) / 10.0).alias("debt_to_equity"),
    )


sql_view(
    "snaps",
    f"""SELECT {_SQL_FLAG.format('o_custkey')} AS symbol, CAST(o_orderdate AS DATE) AS available_at,
  o_orderkey AS seq, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 10000 END AS pe_ratio,
  CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 40) / 100.0::DOUBLE END AS roe,
  (o_orderkey % 25) / 10.0::DOUBLE AS debt_to_equity FROM orders""",
)


def preds(spark, sf) -> DataFrame:
    """Scored predictions, one row per order."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("model"),
        _flag(F.col("o_custkey")).alias("symbol"),
        F.col("o_orderdate").cast("date").alias("date"),
        ((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 31) % 997 / 996.0).alias("p"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
        ((F.col("o_totalprice") - 250000) / 1000000).alias("ret"),
        (F.col("o_orderkey") % 4).alias("fold"),
        (F.col("o_custkey") % 2).alias("seed"),
        ((F.col("o_orderkey") * 104729 + F.col("o_custkey") * 17) % 991 / 990.0).alias("q"),
    )


sql_view(
    "preds",
    f"""SELECT o_orderkey AS id, o_orderpriority AS model, {_SQL_FLAG.format('o_custkey')} AS symbol,
  CAST(o_orderdate AS DATE) AS date, (o_orderkey * 7919 + o_custkey * 31) % 997 / 996.0::DOUBLE AS p,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, (o_totalprice - 250000) / 1000000 AS ret,
  o_orderkey % 4 AS fold, o_custkey % 2 AS seed,
  (o_orderkey * 104729 + o_custkey * 17) % 991 / 990.0::DOUBLE AS q FROM orders""",
)


def news(spark, sf) -> DataFrame:
    """Articles with a publication instant (UTC) and a score unless they are errors."""
    e = table(spark, sf, "events")
    return e.select(
        _flag(F.col("user_id")).alias("symbol"),
        F.col("event_id").alias("id"),
        F.concat(F.lit("https://news/"), (F.col("event_id") % 4000).cast("string")).alias("link"),
        F.col("ts").cast("timestamp_ntz").alias("published"),
        F.when(F.col("event_type") != "error", (F.col("value") - 245) / 245).alias("score"),
        F.col("event_type").alias("category"),
    )


sql_view(
    "news",
    f"""SELECT {_SQL_FLAG.format('user_id')} AS symbol, event_id AS id,
  'https://news/' || CAST(event_id % 4000 AS VARCHAR) AS link, ts AS published,
  CASE WHEN event_type <> 'error' THEN (value - 245) / 245 END AS score, event_type AS category
FROM events""",
)


def newsbars(spark, sf) -> DataFrame:
    """Trading days of the news period: weekdays with activity."""
    return (
        news(spark, sf)
        .withColumn("date", F.col("published").cast("date"))
        .where(F.weekday("date") < 5)
        .groupBy("symbol", "date")
        .agg(F.count(F.lit(1)).cast("double").alias("close"))
    )


sql_view(
    "newsbars",
    """SELECT symbol, CAST(published AS DATE) AS date, CAST(count(*) AS DOUBLE) AS close FROM news
WHERE isodow(published) <= 5 GROUP BY symbol, CAST(published AS DATE)""",
)


def funda(spark, sf) -> DataFrame:
    """Fundamentals, one row per part."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("P"), k.cast("string")).alias("symbol"),
        F.col("p_type").alias("sector"),
        F.when(k % 9 != 0, (k % 90) - 5.0).alias("pe"),
        F.when(k % 8 != 0, (k % 37) / 100.0 - 0.05).alias("roe"),
        F.when(k % 6 != 0, (k % 31) / 100.0 - 0.04).alias("roce"),
        F.when(k % 7 != 0, (k % 40) / 10.0).alias("de"),
        F.when(k % 10 != 0, (k % 45) / 100.0 - 0.05).alias("opm"),
        F.when(k % 12 != 0, (k % 43) / 100.0 - 0.1).alias("rev_growth"),
        F.when(k % 13 != 0, (k % 47) / 100.0 - 0.15).alias("profit_growth"),
        F.col("p_retailprice").alias("price"),
    )


sql_view(
    "funda",
    """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, p_type AS sector,
  CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 90) - 5.0::DOUBLE END AS pe,
  CASE WHEN p_partkey % 8 <> 0 THEN (p_partkey % 37) / 100.0::DOUBLE - 0.05::DOUBLE END AS roe,
  CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 31) / 100.0::DOUBLE - 0.04::DOUBLE END AS roce,
  CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 40) / 10.0::DOUBLE END AS de,
  CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey % 45) / 100.0::DOUBLE - 0.05::DOUBLE END AS opm,
  CASE WHEN p_partkey % 12 <> 0 THEN (p_partkey % 43) / 100.0::DOUBLE - 0.1::DOUBLE END AS rev_growth,
  CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 47) / 100.0::DOUBLE - 0.15::DOUBLE END AS profit_growth,
  p_retailprice AS price FROM part""",
)


def universe(spark, sf) -> DataFrame:
    """Brands with validity windows taken from their parts; some excluded."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    start, end = F.lit("1995-01-02").cast("date"), F.lit("2001-12-31").cast("date")
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("symbol"))
        .agg(F.max(number).alias("n"))
        .where("n % 12 <> 7")
        .select(
            "symbol",
            F.concat(F.lit("S"), (F.col("n") % 5).cast("string")).alias("sector"),
            F.when(F.col("n") % 4 != 0, F.date_add(start, F.col("n") * 20)).alias("valid_from"),
            F.when(F.col("n") % 3 != 0, F.date_sub(end, F.col("n") * 15)).alias("valid_to"),
            F.when(F.col("n") % 11 == 5, "excluded").otherwise("included").alias("inclusion_status"),
            F.when(F.col("n") % 11 == 5, "thin history").alias("exclusion_reason"),
        )
    )


sql_view(
    "universe",
    """SELECT symbol, 'S' || CAST(n % 5 AS VARCHAR) AS sector,
  CASE WHEN n % 4 <> 0 THEN DATE '1995-01-02' + CAST(n * 20 AS INTEGER) END AS valid_from,
  CASE WHEN n % 3 <> 0 THEN DATE '2001-12-31' - CAST(n * 15 AS INTEGER) END AS valid_to,
  CASE WHEN n % 11 = 5 THEN 'excluded' ELSE 'included' END AS inclusion_status,
  CASE WHEN n % 11 = 5 THEN 'thin history' END AS exclusion_reason
FROM (SELECT p_brand AS symbol, max(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER)) AS n
  FROM part GROUP BY p_brand) WHERE n % 12 <> 7""",
)


def chains(spark, sf) -> DataFrame:
    """Option quotes: one per shipped line of a brand and month."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    li = table(spark, sf, "lineitem").where(F.col("l_quantity") > 0)
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol",
        F.trunc("l_shipdate", "month").alias("as_of"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("side"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0).alias("strike"),
        F.col("l_quantity").alias("open_interest"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 5).alias("implied_vol"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
    )


sql_view(
    "chains",
    """SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS as_of,
  CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS side,
  round(l_extendedprice / l_quantity, 0) AS strike, l_quantity AS open_interest,
  CASE WHEN l_discount > 0 THEN l_discount * 5 END AS implied_vol,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0""",
)


def statements(spark, sf) -> DataFrame:
    """Quarterly statement items in long form, per supplier."""
    li = table(spark, sf, "lineitem").where(F.col("l_quantity") > 0)
    cents = lambda c: F.sum(F.round(c * 100, 0).cast("bigint")) / 100.0
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    wide = li.groupBy(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("quarter_end"),
    ).agg(
        cents(price).alias("total_revenue"),
        cents(price * (disc - 0.03)).alias("net_income"),
        cents(price * (disc - 0.01)).alias("operating_income"),
        (cents(F.col("l_quantity")) * 500).alias("total_equity"),
        (cents(F.col("l_tax") * price) * 2).alias("total_debt"),
        (cents(price) * 3).alias("total_assets"),
        cents(price * F.col("l_tax")).alias("current_liabilities"),
        (cents(price * (disc - 0.03)) / 10000).alias("diluted_eps"),
    )
    items = wide.columns[2:]
    return wide.unpivot(["symbol", "quarter_end"], items, "item", "amount").where(
        # Holes in the filings, so that fallbacks and missing values occur.
        ~((F.col("item") == "total_assets") & (F.month("quarter_end") == 6))
        & ~((F.col("item") == "diluted_eps") & (F.month("quarter_end") == 9))
    )


_C = "sum(CAST(round(({0}) * 100, 0) AS BIGINT)) / 100.0::DOUBLE"
sql_view(
    "statements",
    f"""SELECT symbol, quarter_end, item, amount FROM (UNPIVOT (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol,
  CAST(last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS quarter_end,
  {_C.format('l_extendedprice')} AS total_revenue,
  {_C.format('l_extendedprice * (l_discount - 0.03::DOUBLE)')} AS net_income,
  {_C.format('l_extendedprice * (l_discount - 0.01::DOUBLE)')} AS operating_income,
  {_C.format('l_quantity')} * 500 AS total_equity,
  {_C.format('l_tax * l_extendedprice')} * 2 AS total_debt,
  {_C.format('l_extendedprice')} * 3 AS total_assets,
  {_C.format('l_extendedprice * l_tax')} AS current_liabilities,
  {_C.format('l_extendedprice * (l_discount - 0.03::DOUBLE)')} / 10000 AS diluted_eps
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)
  ON total_revenue, net_income, operating_income, total_equity, total_debt, total_assets,
    current_liabilities, diluted_eps INTO NAME item VALUE amount)
WHERE NOT (item = 'total_assets' AND month(quarter_end) = 6)
  AND NOT (item = 'diluted_eps' AND month(quarter_end) = 9)""",
)
