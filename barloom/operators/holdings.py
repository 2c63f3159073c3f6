"""Shareholding tables: holder cleaning, top holders, quarterly reshape, priorities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import format_percent, parse_percent, squeeze

# Words and names that mark rows which are not holders.
SUMMARY_WORDS = [
    "promoter", "promoters", "fii", "fpi", "dii", "government", "govt", "public", "others",
    "no. of shareholders", "total", "total shareholding", "grand total",
]
BAD_WORDS = [
    "sales", "reserves", "fixed assets", "expenses", "borrowings", "cash from operating",
    "other assets", "other liabilities", "cwip", "total assets", "net profit", "operating profit",
    "revenue", "liabilities", "equity capital", "cash equivalents", "trade receivables",
    "inventories", "share capital", "balance sheet", "profit loss", "cash flow",
    "promoter and promoter group", "promoters and promoter group", "pledged", "locked",
    "individual share capital", "foreign portfolio investors category", "clearing members",
]
AGGREGATES = [
    "any other", "any other (specify)", "any others", "banks", "bodies corporate",
    "foreign portfolio investors category i", "foreign portfolio investors category ii",
    "insurance companies", "mutual funds", "non resident indians", "non resident indians (nris)",
    "other financial institutions", "trusts", "resident individuals", "hindu undivided family",
]
# Row labels of the shareholding summary, first match wins.
LABELS = {
    "promoter": ["promoter", "promoters"],
    "fii": ["fii", "fpi", "foreign institutional"],
    "dii": ["dii", "domestic institutional"],
    "government": ["government", "govt", "president of india"],
    "public": ["public", "others", "retail"],
}


def has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(word) for word in words))


def is_holder(name) -> Column:
    text = F.btrim(F.lower(squeeze(name)), F.lit(" -:|"))
    return (
        (F.length(text) >= 3)
        & ~text.isin(AGGREGATES)
        & ~has_any(text, BAD_WORDS)
        & ~text.rlike(r"^[\d\W_]+$")
        & ~text.rlike(r"\b(jun|sep|dec|mar)\s+\d{4}\b")
        & ~has_any(F.lower(squeeze(name)), SUMMARY_WORDS)
    )


def top_holders(rows: DataFrame, limit: int = 10) -> DataFrame:
    """``(symbol, seq, holder, pct_text)`` to the largest holders per symbol.

    The first row of a repeated holder counts. A symbol's holders are reduced by name
    before they meet, and only ranks up to ``limit`` survive the ranking.
    """
    clean = (
        rows.select("symbol", "seq", squeeze("holder").alias("holder"), parse_percent("pct_text").alias("pct"))
        .where(is_holder("holder") & (F.round("pct", 2) > 0) & (F.round("pct", 2) <= 100))
        .groupBy("symbol", "holder")
        .agg(F.min_by("pct", "seq").alias("pct"))
    )
    by_size = Window.partitionBy("symbol").orderBy(F.desc("pct"), "holder")
    return clean.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= limit)


def categories(label) -> Column:
    """All categories whose words a row's label holds."""
    text = F.lower(squeeze(label))
    return F.array_compact(F.array(*[F.when(has_any(text, words), name) for name, words in LABELS.items()]))


def quarterly_shareholding(wide: DataFrame, label: str, quarters: list[str], position: str) -> DataFrame:
    """Rows = categories, columns = quarters  ->  rows = quarters, columns = categories.

    A category takes the first row of the table, by ``position``, whose label names it; one row may
    serve several. Only symbols whose table carries promoter, FII, DII and public rows are kept.
    """
    tagged = wide.withColumn("category", F.explode(categories(label)))
    long = tagged.unpivot(["symbol", "category", position], quarters, "quarter", "text")
    table = (
        long.groupBy("symbol", "quarter")
        .pivot("category", list(LABELS))
        .agg(F.min_by(format_percent("text"), position))
    )
    needed = ["promoter", "fii", "dii", "public"]
    return table.dropna(subset=needed)


def fill_from(primary: DataFrame, secondary: DataFrame, key: str = "symbol") -> DataFrame:
    """Primary values, NULLs filled from the secondary source."""
    fields = [c for c in primary.columns if c != key]
    other = secondary.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return primary.join(other, key, "full").select(
        key, *[F.coalesce(c, f"_{c}").alias(c) for c in fields]
    )


def first_source(rows: DataFrame, priority: str = "priority", key: str = "symbol") -> DataFrame:
    """All rows of the best non-empty source per key."""
    best = rows.groupBy(key).agg(F.min(priority).alias(priority))
    return rows.join(best, [key, priority], "left_semi")
