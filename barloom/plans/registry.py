"""Catalogue of runnable queries with their SQL counterparts.

A query is registered with an output ``spec`` such as ``"symbol, date:d, sma20:6"``. The
same spec shapes the Spark result and the SQL text, so both sides expose equal names,
types and rounding. Suffixes: ``:d`` day, ``:t`` second, ``:i`` bigint, ``:b`` boolean,
``:a`` array shown as text, a digit for rounded doubles; bare names are text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None
    spec: str

    @property
    def sql(self) -> str | None:
        return oracle(self.body, self.spec) if self.body else None


# Engines break rounding ties differently; a hair above one lifts exact ties the same way.
TIE = 1.000000000001
SQL_TIE = "CAST(1.000000000001 AS DOUBLE)"

CATALOG: dict[str, Entry] = {}
SQL_VIEWS: dict[str, str] = {}


def sql_view(name: str, text: str) -> None:
    SQL_VIEWS[name] = text


def _fields(spec: str):
    for part in spec.replace("\n", " ").split(","):
        name, _, kind = part.strip().partition(":")
        yield name, kind


def _spark_field(name: str, kind: str):
    c = F.col(name)
    if kind == "d":
        c = c.cast("date").cast("string")
    elif kind == "t":
        c = F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "b":
        c = c.cast("boolean")
    elif kind == "a":
        c = F.array_join(c, "|")
    elif kind:
        c = c.cast("double")
        finite = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        c = F.round(finite * TIE, int(kind)) + F.lit(0.0)
    else:
        c = c.cast("string")
    return c.alias(name)


def _sql_field(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "d":
        c = f"CAST(CAST({c} AS DATE) AS VARCHAR)"
    elif kind == "t":
        c = f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    elif kind == "i":
        c = f"CAST({c} AS BIGINT)"
    elif kind == "b":
        c = f"CAST({c} AS BOOLEAN)"
    elif kind == "a":
        c = f"array_to_string({c}, '|')"
    elif kind:
        d = f"CAST({c} AS DOUBLE)"
        c = f"round(CASE WHEN isfinite({d}) THEN {d} END * {SQL_TIE}, {kind}) + CAST(0 AS DOUBLE)"
    else:
        c = f"CAST({c} AS VARCHAR)"
    return f'{c} AS "{name}"'


def shape(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_spark_field(n, k) for n, k in _fields(spec)])


def _needed(text: str) -> list[str]:
    """Views the text mentions, dependencies first."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name, inner in SQL_VIEWS.items():
            if name not in found and re.search(rf"\b(from|join)\s+{name}\b", body, re.I):
                visit(inner)
                found.append(name)

    visit(text)
    return found


def oracle(body: str, spec: str) -> str:
    views = [f"{n} AS (\n{SQL_VIEWS[n]}\n)" for n in _needed(body)]
    views.append(f"answer AS (\n{body.strip()}\n)")
    fields = ",\n  ".join(_sql_field(n, k) for n, k in _fields(spec))
    return "WITH " + ",\n".join(views) + f"\nSELECT {fields}\nFROM answer"


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(fn(spark, sf_dir), spec)

        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(name, run, sql, spec)
        return fn

    return keep
