"""Catalogue: sources, sinks, projections and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions import windows as w
from ..operators import holdings, quality
from ..session import shared_folder
from ..sources import bars as src
from ..sources import fingerprint as fp
from ..sources import prediction_log as plog
from ..sources import tone as tn
from . import views as v
from .registry import query, sql_view

BAR = "symbol, date:d, open:4, high:4, low:4, close:4, volume:4"


def fresh(spark, label):
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("bars_from_trades", BAR, "SELECT * FROM bars")
def _(spark, sf):
    return v.bars(spark, sf)


@query("bars_weekly_by_brand", BAR + ", sector", "SELECT * FROM weekly")
def _(spark, sf):
    return v.weekly(spark, sf)


@query(
    "clean_bars",
    "symbol, date:d, open:4, close:4, adj_close:4, volume:4",
    """SELECT symbol, date, CASE WHEN l_linenumber = 3 THEN NULL ELSE price END AS open,
  price AS close, price AS adj_close, qty AS volume FROM trades WHERE l_orderkey % 50 <> 0""",
)
def _(spark, sf):
    text = F.col("price").cast("string")
    raw = v.trades(spark, sf).select(
        F.col("symbol"),
        F.col("ts").alias("Date"),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(text).alias("Open"),
        F.when(F.col("l_orderkey") % 50 == 0, "halted").otherwise(text).alias("Close"),
        F.col("qty").cast("string").alias("Volume"),
    )
    return src.clean_ohlcv(raw)


sql_view(
    "ticks",
    """SELECT ['A', 'N', 'R'][1 + CAST(user_id % 3 AS INTEGER)] AS symbol, ts, event_id,
  value AS price FROM events""",
)

for _name, _sql in {
    "1m": "SELECT * FROM (SELECT symbol, time_bucket(INTERVAL '1 minutes', ts) AS time, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)",
    "5m": "SELECT * FROM (SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS time, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)",
    "10m": "SELECT symbol, time_bucket(INTERVAL '10 minutes', ts) AS time, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2",
    "20m": "SELECT symbol, time_bucket(INTERVAL '20 minutes', ts) AS time, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2",
    "30m": "SELECT symbol, time_bucket(INTERVAL '30 minutes', ts) AS time, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2",
    "1h": "SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS time, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2",
}.items():

    @query(f"intraday_bars_{_name}", "symbol, time:t, open:4, high:4, low:4, close:4, volume:4", _sql)
    def _(spark, sf, interval=_name):
        return src.interval_bars(ticks(spark, sf), interval, "price", F.lit(1.0), ("ts", "event_id"))


def ticks(spark, sf):
    return v.table(spark, sf, "events").select(
        v._flag(F.col("user_id")).alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "event_id",
        F.col("value").alias("price"),
    )


@query(
    "bar_records",
    "symbol, date, open:4, close:4, volume:i",
    """SELECT symbol, date, CAST(CAST(open AS VARCHAR) AS DECIMAL(30, 4)) AS open,
  CAST(CAST(close AS VARCHAR) AS DECIMAL(30, 4)) AS close, floor(volume) AS volume FROM bars""",
)
def _(spark, sf):
    return src.to_records(v.bars(spark, sf))


@query("panel_csv_source", BAR, "SELECT * FROM bars")
def _(spark, sf):
    path = fresh(spark, "panel-csv")
    v.bars(spark, sf).select(*[f.name for f in src.BAR_SCHEMA]).write.option("header", True).csv(path)
    return src.read_panel_csv(spark, path)


@query(
    "panel_sink",
    "rows:i, n_symbols:i, date_start:d, date_end:d, columns",
    """SELECT count(*) AS rows, count(DISTINCT symbol) AS n_symbols, min(date) AS date_start,
  max(date) AS date_end, 'symbol,date,open,high,low,close,volume' AS columns FROM bars""",
)
def _(spark, sf):
    return src.write_panel(v.bars(spark, sf), fresh(spark, "panel"))


# Prediction log built from orders: one forecast per order; every ninth unusable.
sql_view(
    "forecasts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS prediction_id,
  ['A', 'N', 'R'][1 + CAST(o_custkey % 3 AS INTEGER)] AS symbol,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS as_of, 20 AS horizon,
  CASE WHEN o_orderkey % 9 <> 0 THEN (o_custkey % 97) / 97.0::DOUBLE END AS probability,
  CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'HOLD' END AS signal,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS direction, o_totalprice AS close,
  'fp' || CAST(o_custkey % 13 AS VARCHAR) AS data_fingerprint,
  o_orderkey % 17 <> 0 AS is_available, false AS scored FROM orders""",
)


def forecasts(spark, sf):
    return forecast_rows(v.table(spark, sf, "orders"))


def forecast_rows(o):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    filled = F.col("o_orderstatus") == "F"
    return o.select(
        k.cast("string").alias("prediction_id"),
        v._flag(c).alias("symbol"),
        F.col("o_orderdate").cast("date").cast("string").alias("as_of"),
        F.lit(20).alias("horizon"),
        F.when(k % 9 != 0, (c % 97) / 97.0).alias("probability"),
        F.when(filled, "BUY").otherwise("HOLD").alias("signal"),
        F.when(filled, 1).otherwise(0).alias("direction"),
        F.col("o_totalprice").alias("close"),
        F.concat(F.lit("fp"), (c % 13).cast("string")).alias("data_fingerprint"),
        (k % 17 != 0).alias("is_available"),
        F.lit(False).alias("scored"),
    )


@query(
    "prediction_log_source",
    "prediction_id, symbol, as_of, probability:6, signal, close:2",
    "SELECT * FROM forecasts WHERE symbol = 'N' AND CAST(prediction_id AS BIGINT) % 10 <> 4",
)
def _(spark, sf):
    rows = forecasts(spark, sf)
    line = F.to_json(F.struct(*[f.split()[0] for f in plog.LOG_SCHEMA.split(", ")]))
    broken = F.col("prediction_id").cast("bigint") % 10 == 4
    path = fresh(spark, "log")
    rows.select(F.when(broken, F.concat(F.lit("{oops "), line)).otherwise(line).alias("value")).write.text(path)
    return plog.read_log(spark, path, "n").where(F.col("prediction_id").isNotNull())


_LOGGED = "CAST(prediction_id AS BIGINT) % 5 = 1"


@query(
    "prediction_log_append",
    "prediction_id, symbol, as_of, data_fingerprint, probability:6",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, as_of, data_fingerprint
    ORDER BY prediction_id) AS k FROM forecasts WHERE is_available AND probability IS NOT NULL) f
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM forecasts g WHERE CAST(g.prediction_id AS BIGINT) % 5 = 1
  AND g.symbol = f.symbol AND g.as_of = f.as_of AND g.data_fingerprint = f.data_fingerprint)""",
)
def _(spark, sf):
    rows = forecasts(spark, sf)
    return plog.new_records(rows, rows.where(_LOGGED))


@query(
    "prediction_log_status",
    "status, n:i",
    """SELECT status, count(*) AS n FROM (SELECT CASE
    WHEN NOT (is_available AND probability IS NOT NULL) THEN 'skipped'
    WHEN EXISTS (SELECT 1 FROM forecasts g WHERE CAST(g.prediction_id AS BIGINT) % 5 = 1
      AND g.symbol = f.symbol AND g.as_of = f.as_of AND g.data_fingerprint = f.data_fingerprint)
      OR row_number() OVER (PARTITION BY symbol, as_of, data_fingerprint,
        is_available AND probability IS NOT NULL ORDER BY prediction_id) > 1 THEN 'duplicate'
    ELSE 'recorded' END AS status FROM forecasts f) GROUP BY status""",
)
def _(spark, sf):
    rows = forecasts(spark, sf)
    return (
        plog.classify_appends(rows, rows.where(_LOGGED)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    )


# Tone segments: daily mean event value per user group, two overlapping retrievals.
sql_view(
    "tone",
    """SELECT symbol, date, max_by(value, seg) * 0.01 AS tone FROM (
  SELECT ['A', 'N', 'R'][1 + CAST(user_id % 3 AS INTEGER)] AS symbol, event_id % 2 AS seg,
    CAST(ts AS DATE) AS date, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 - 245 AS value
  FROM events GROUP BY 1, 2, 3) WHERE NOT (seg = 1 AND day(date) % 3 = 0)
    AND NOT (seg = 0 AND day(date) % 4 = 0) GROUP BY symbol, date""",
)


def tone_segments(spark, sf):
    daily = (
        v.table(spark, sf, "events")
        .groupBy(
            v._flag(F.col("user_id")).alias("symbol"),
            (F.col("event_id") % 2).alias("segment"),
            F.col("ts").cast("date").alias("date"),
        )
        .agg(
            (
                F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double")
                / F.count(F.lit(1))
                / 100
                - 245
            ).alias("value")
        )
    )
    # Unreadable points: a bad value in segment 1, a bad date in segment 0.
    text = F.when((F.col("segment") == 1) & (F.dayofmonth("date") % 3 == 0), "n/a").otherwise(
        F.col("value").cast("string")
    )
    day = F.when((F.col("segment") == 0) & (F.dayofmonth("date") % 4 == 0), "soon").otherwise(
        F.col("date").cast("string")
    )
    return daily.groupBy("symbol", "segment").agg(
        F.collect_list(F.struct(day.alias("date"), text.alias("value"))).alias("points")
    )


def tone(spark, sf):
    return tn.daily_tone(tone_segments(spark, sf))


@query("tone_timeline", "symbol, date:d, tone:6", "SELECT * FROM tone")
def _(spark, sf):
    return tone(spark, sf)


@query(
    "tone_coverage",
    """symbol, n_days_with_news:i, n_trading_days:i, coverage_pct:2, first_news_day:d,
    last_news_day:d, n_distinct:i, tone_min:4, tone_max:4, tone_mean:4""",
    """SELECT symbol, count(tone) AS n_days_with_news, count(*) AS n_trading_days,
  100.0::DOUBLE * count(tone) / count(*) AS coverage_pct, min(date) FILTER (tone IS NOT NULL) AS first_news_day,
  max(date) FILTER (tone IS NOT NULL) AS last_news_day, count(DISTINCT tone) AS n_distinct,
  min(tone) AS tone_min, max(tone) AS tone_max, avg(tone) AS tone_mean
FROM newsbars LEFT JOIN tone USING (symbol, date) GROUP BY symbol""",
)
def _(spark, sf):
    return tn.tone_coverage(tone(spark, sf), v.newsbars(spark, sf).select("symbol", "date"))


_FP_ROW = """sha256(concat_ws(chr(31),
  'cents=' || coalesce('''' || CAST(cents AS VARCHAR), chr(0)),
  'date=' || coalesce('''' || CAST(date AS VARCHAR), chr(0)),
  'symbol=' || coalesce('''' || symbol, chr(0))))"""
sql_view(
    "fpgroups",
    f"""SELECT symbol, sha256('bars|' || symbol || '|' || string_agg(d, '' ORDER BY d)) AS digest FROM (
  SELECT symbol, sha256(string_agg(d, '' ORDER BY d)) AS d FROM (
    SELECT symbol, date_trunc('month', date) AS m, {_FP_ROW} AS d
    FROM (SELECT symbol, date, CAST(floor(close * 10) AS BIGINT) AS cents FROM bars)) GROUP BY symbol, m)
GROUP BY symbol""",
)


def fingerprints(spark, sf):
    rows = v.bars(spark, sf).select("symbol", "date", F.floor(F.col("close") * 10).cast("bigint").alias("cents"))
    return fp.fingerprint(
        rows.withColumn("_month", F.trunc("date", "month")), "bars", ["symbol", "date", "cents"], "symbol", ["_month"]
    )


@query("fingerprint_by_symbol", "symbol, digest", "SELECT * FROM fpgroups")
def _(spark, sf):
    return fingerprints(spark, sf)


@query(
    "fingerprint_composed",
    "digest, parts:i",
    """SELECT sha256('panel|' || string_agg(d, '' ORDER BY leaf, d)) AS digest, sum(n) AS parts FROM (
  SELECT substr(digest, 1, 2) AS leaf, count(*) AS n,
    sha256(string_agg(symbol || ':' || digest, ',' ORDER BY symbol || ':' || digest)) AS d
  FROM fpgroups GROUP BY 1)""",
)
def _(spark, sf):
    return fp.compose("panel", fingerprints(spark, sf), "symbol")


# ---- projections and filters ----------------------------------------------------

_RAW_SYMBOL = """CASE CAST(s_suppkey % 5 AS INTEGER) WHEN 0 THEN '.ns' WHEN 1 THEN '.NSE' WHEN 2 THEN '.bo'
  WHEN 3 THEN '.BSE' ELSE '' END"""


@query(
    "symbol_clean",
    "raw, symbol, valid:b, suffixed",
    f"""SELECT raw, symbol, regexp_full_match(symbol, '[A-Z0-9]{{1,10}}') AS valid, symbol || '.NS' AS suffixed
FROM (SELECT raw, trim(replace(replace(replace(replace(upper(raw), '.NS', ''), '.NSE', ''), '.BO', ''), '.BSE', '')) AS symbol
  FROM (SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_name ELSE ' s' || CAST(s_suppkey AS VARCHAR) END || {_RAW_SYMBOL} AS raw
  FROM supplier))""",
)
def _(spark, sf):
    k = F.col("s_suppkey")
    tail = F.element_at(F.array(*[F.lit(x) for x in [".ns", ".NSE", ".bo", ".BSE", ""]]), (k % 5 + 1).cast("int"))
    head = F.when(k % 7 == 0, F.col("s_name")).otherwise(F.concat(F.lit(" s"), k.cast("string")))
    return v.table(spark, sf, "supplier").select(F.concat(head, tail).alias("raw")).select(
        "raw",
        sc.clean_symbol("raw").alias("symbol"),
        sc.is_symbol(sc.clean_symbol("raw")).alias("valid"),
        sc.exchange_symbol("raw").alias("suffixed"),
    )


@query(
    "as_of_cutoff",
    "symbol, rows:i, last_date:d, labelled:i",
    """SELECT symbol, count(*) AS rows, max(date) AS last_date, count(r) AS labelled FROM (
  SELECT symbol, date, lead(close, 20) OVER (PARTITION BY symbol ORDER BY date) AS r
  FROM bars WHERE date <= DATE '1999-06-30') GROUP BY symbol""",
)
def _(spark, sf):
    cut = quality.as_of_cutoff(v.bars(spark, sf), "1999-06-30")
    return (
        cut.withColumn("r", w.lead("close", 20))
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("date").alias("last_date"), F.count("r").alias("labelled"))
    )


_INSIDE = "(valid_from IS NULL OR date >= valid_from) AND (valid_to IS NULL OR date <= valid_to)"


@query(
    "universe_eligible",
    "symbol, date:d, close:4",
    f"""SELECT w.symbol, date, close FROM weekly w JOIN universe u ON w.symbol = u.symbol
WHERE inclusion_status <> 'excluded' AND {_INSIDE}""",
)
def _(spark, sf):
    return quality.eligible_rows(v.weekly(spark, sf), v.universe(spark, sf))


@query(
    "eligibility_mask",
    "symbol, date:d, eligible:b, close:4",
    f"""SELECT symbol, date, eligible, CASE WHEN eligible THEN close END AS close FROM (
  SELECT w.symbol, date, close, coalesce(u.symbol IS NOT NULL AND {_INSIDE}, false) AS eligible
  FROM weekly w LEFT JOIN universe u ON w.symbol = u.symbol)""",
)
def _(spark, sf):
    marked = quality.with_eligibility(v.weekly(spark, sf), v.universe(spark, sf))
    return quality.mask(marked, ["close"])


@query(
    "skipped_symbols",
    "symbol, reason",
    f"""SELECT DISTINCT symbol, 'not in universe manifest' AS reason FROM weekly WHERE symbol NOT IN (SELECT symbol FROM universe)
UNION ALL SELECT symbol, coalesce(exclusion_reason, 'excluded') FROM universe
  WHERE inclusion_status = 'excluded' AND symbol IN (SELECT symbol FROM weekly)
UNION ALL SELECT symbol, 'no feature frame supplied' FROM universe WHERE symbol NOT IN (SELECT symbol FROM weekly)
UNION ALL SELECT symbol, 'no rows inside point-in-time universe window' FROM universe u WHERE inclusion_status <> 'excluded'
  AND symbol IN (SELECT symbol FROM weekly)
  AND NOT EXISTS (SELECT 1 FROM weekly w WHERE w.symbol = u.symbol AND {_INSIDE})""",
)
def _(spark, sf):
    return quality.skipped_symbols(v.weekly(spark, sf), v.universe(spark, sf))


def _prunable(spark, sf):
    return v.bars(spark, sf).withColumns(
        {
            "flat": F.lit(1.5),
            "hollow": F.lit(None).cast("double"),
            "target_ret_20d": w.lead("close", 20) / F.col("close") - 1,
        }
    )


@query(
    "column_profile",
    "column, filled:i, varies:b",
    """SELECT 'close' AS "column", count(close) AS filled, coalesce(min(close) <> max(close), false) AS varies FROM bars
UNION ALL SELECT 'volume', count(volume), coalesce(min(volume) <> max(volume), false) FROM bars
UNION ALL SELECT 'flat', count(*), false FROM bars UNION ALL SELECT 'hollow', 0, false""",
)
def _(spark, sf):
    return quality.column_profile(_prunable(spark, sf), ["close", "volume", "flat", "hollow"])


@query(
    "supervised_rows",
    "symbol, volume:4, target_ret_20d:6",
    """SELECT symbol, volume, r AS target_ret_20d FROM (SELECT *, lead(close, 20) OVER
  (PARTITION BY symbol ORDER BY date) / close - 1 AS r FROM bars) WHERE r IS NOT NULL""",
)
def _(spark, sf):
    panel = _prunable(spark, sf)
    keep = quality.model_columns(panel)
    return quality.supervised(panel, "target_ret_20d", ["symbol", *keep])


@query(
    "holder_rows_clean",
    "symbol, holder, pct:2, rank:i",
    """SELECT symbol, holder, pct, rank FROM (SELECT symbol, holder, pct,
  row_number() OVER (PARTITION BY symbol ORDER BY pct DESC, holder) AS rank FROM (
  SELECT symbol, holder, arg_min(pct, seq) AS pct FROM (
    SELECT c_mktsegment AS symbol, c_custkey AS seq, c_acctbal / 50 AS pct,
      CASE CAST(c_custkey % 12 AS INTEGER) WHEN 0 THEN 'Mutual Funds' WHEN 1 THEN 'Total Assets' WHEN 2 THEN '42'
        WHEN 3 THEN 'Jun 2024' WHEN 4 THEN 'ab' WHEN 5 THEN 'Promoters' ELSE 'Fund ' || CAST(c_custkey % 200 AS VARCHAR) END AS holder
    FROM customer) WHERE round(pct, 2) > 0 AND round(pct, 2) <= 100 AND holder LIKE 'Fund %' GROUP BY symbol, holder)) WHERE rank <= 10""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    odd = F.array(*[F.lit(x) for x in ["Mutual Funds", "Total Assets", "42", "Jun 2024", "ab", "Promoters"]])
    rows = v.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("symbol"),
        k.alias("seq"),
        F.when(k % 12 < 6, F.try_element_at(odd, (k % 12 + 1).cast("int"))).otherwise(F.concat(F.lit("Fund "), (k % 200).cast("string"))).alias("holder"),
        F.concat((F.col("c_acctbal") / 50).cast("decimal(20,12)").cast("string"), F.lit(" %")).alias("pct_text"),
    )
    return holdings.top_holders(rows)


_QUARTERS = ["Mar 2024", "Jun 2024", "Sep 2024"]


@query(
    "shareholding_by_quarter",
    "symbol, quarter, promoter, fii, dii, public",
    """SELECT symbol, quarter, max(t) FILTER (seg = 'AUTOMOBILE') AS promoter, max(t) FILTER (seg = 'BUILDING') AS fii,
  max(t) FILTER (seg = 'FURNITURE') AS dii, max(t) FILTER (seg = 'MACHINERY') AS "public" FROM (
  SELECT CAST(c_nationkey AS VARCHAR) AS symbol, c_mktsegment AS seg, q AS quarter,
    format('{:.2f}%', CAST(sum(CAST(c_custkey % (17 + i) AS BIGINT)) AS DOUBLE) / 8) AS t
  FROM customer, (VALUES (0, 'Mar 2024'), (1, 'Jun 2024'), (2, 'Sep 2024')) v(i, q)
  WHERE c_mktsegment <> 'HOUSEHOLD' GROUP BY 1, 2, 3) GROUP BY symbol, quarter""",
)
def _(spark, sf):
    label = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Promoters +")
        .when(F.col("c_mktsegment") == "BUILDING", "FIIs / FPI")
        .when(F.col("c_mktsegment") == "FURNITURE", "Domestic institutional")
        .when(F.col("c_mktsegment") == "MACHINERY", "Public")
        .otherwise("No. of shareholders")
    )
    wide = v.table(spark, sf, "customer").groupBy(
        F.col("c_nationkey").cast("string").alias("symbol"), label.alias("label")
    ).agg(
        *[
            F.concat((F.sum(F.col("c_custkey") % (17 + i)) / 8.0).cast("string"), F.lit("%")).alias(q)
            for i, q in enumerate(_QUARTERS)
        ]
    ).withColumn("row", F.lit(1))
    # A later row of a category already seen, alphabetically before it, must not count.
    later = wide.where("label LIKE 'Promoters%'").withColumns({"label": F.lit("Promoter Group (sub)"), "row": F.lit(2)} | {q: F.lit("10%") for q in _QUARTERS})
    return holdings.quarterly_shareholding(wide.unionByName(later), "label", _QUARTERS, "row")


@query(
    "percent_parsing",
    "raw, value:4, shown",
    """SELECT raw, CASE WHEN kind < 4 THEN value END AS value,
  CASE WHEN kind < 4 THEN format('{:.2f}%', value) ELSE 'N/A' END AS shown FROM (
  SELECT kind, CASE kind WHEN 0 THEN c || ' %' WHEN 1 THEN '  ' || c WHEN 2 THEN c || ' crore' WHEN 3 THEN 'up ' || c || '%'
    WHEN 4 THEN '-' WHEN 5 THEN 'n/a' WHEN 6 THEN '' ELSE 'abc' END AS raw, CAST(c AS DOUBLE) AS value
  FROM (SELECT CAST(c_custkey % 8 AS INTEGER) AS kind, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c FROM customer))""",
)
def _(spark, sf):
    kind = F.col("c_custkey") % 8
    c = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    raw = (
        F.when(kind == 0, F.concat(c, F.lit(" %")))
        .when(kind == 1, F.concat(F.lit("  "), c))
        .when(kind == 2, F.concat(c, F.lit(" crore")))
        .when(kind == 3, F.concat(F.lit("up "), c, F.lit("%")))
        .when(kind == 4, "-")
        .when(kind == 5, "n/a")
        .when(kind == 6, "")
        .otherwise("abc")
    )
    return v.table(spark, sf, "customer").select(raw.alias("raw")).select(
        "raw", sc.parse_percent("raw").alias("value"), sc.format_percent("raw").alias("shown")
    )


@query(
    "timestamp_parsing",
    "raw, parsed:t",
    """SELECT raw, CASE WHEN kind < 3 THEN date_trunc('second', ts) END AS parsed FROM (
  SELECT ts, kind, CASE kind WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%d/%m/%Y') END AS raw
  FROM (SELECT ts, CAST(event_id % 4 AS INTEGER) AS kind FROM events))""",
)
def _(spark, sf):
    kind, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp_ntz")
    raw = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )
    return v.table(spark, sf, "events").select(raw.alias("raw")).select("raw", sc.parse_when("raw").alias("parsed"))


@query(
    "finite_rounding",
    "symbol, date:d, ratio:4",
    """SELECT symbol, date, CASE WHEN high = low THEN NULL ELSE (close - low) / (high - low) END AS ratio FROM bars""",
)
def _(spark, sf):
    raw = v.bars(spark, sf).withColumn("span", F.col("high") - F.col("low"))
    hole = F.when(F.col("span") == 0, F.lit(float("inf"))).otherwise((F.col("close") - F.col("low")) / F.nullif("span", F.lit(0.0)))
    return raw.select("symbol", "date", sc.finite(hole, 4).alias("ratio"))
