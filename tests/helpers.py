import datetime as dt


def day(i, start=dt.date(2024, 1, 1)):
    return start + dt.timedelta(days=i)


def panel(spark, columns, symbol="A", start=dt.date(2024, 1, 1)):
    """One symbol's rows on consecutive days from lists of values."""
    names = list(columns)
    n = len(columns[names[0]])
    rows = [(symbol, day(i, start), *[columns[c][i] for c in names]) for i in range(n)]
    schema = "symbol string, date date, " + ", ".join(f"{c} double" for c in names)
    plain = [(s, d, *[None if x is None else float(x) for x in rest]) for s, d, *rest in rows]
    return spark.createDataFrame(plain, schema)


def values(df, *columns, order=("symbol", "date")):
    rows = df.orderBy(*order).select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]


SIX = {
    "open": [10.0, 10.5, 11.0, 10.8, 11.2, 11.5],
    "high": [11.0, 11.5, 11.6, 11.4, 11.8, 12.0],
    "low": [9.5, 10.2, 10.6, 10.5, 10.9, 11.2],
    "close": [10.8, 11.2, 11.1, 11.0, 11.6, 11.9],
    "volume": [1000.0, 1200.0, 1100.0, 900.0, 1300.0, 1500.0],
}
FOUR = {
    "open": [100.0, 102.0, 100.3, 100.6],
    "high": [101.0, 103.0, 101.5, 105.0],
    "low": [99.5, 101.8, 100.0, 100.0],
    "close": [100.0, 102.0, 100.98, 104.0094],
}
