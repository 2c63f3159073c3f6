"""Every registered query with SQL agrees with it on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# A cross-section of the catalogue; tools/check.py compares all of it.
SAMPLE = [
    "bars_from_trades", "clean_bars", "fingerprint_composed", "prediction_log_append", "macd", "adx", "market_relative",
    "as_of_join", "relative_features", "universe_relative", "event_features", "option_chain_metrics", "scorecard_by_model",
    "psi_drift", "forward_scorecard", "ledger_equity", "stock_cards", "screen_results", "quarterly_ratios",
    "selective_policies", "panel_folds_with_holdout", "stream_bars",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def norm(rows):
    return sorted(tuple("~" if v is None else (repr(float(v)) if isinstance(v, float) else str(v)) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    theirs = norm([tuple(r[i] for i in at) for r in cur.fetchall()])
    assert norm([tuple(r) for r in df.select(*cols).collect()]) == theirs


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["side", "rank", "symbol"]
    assert df.count() > 0


def test_plans_have_no_cartesian_products(spark):
    for name in SAMPLE:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_indicator_state_survives_batches(spark, tmp_path):
    """Two micro-batches give the result of one."""
    from pyspark.sql import functions as F

    from barloom.operators import technical
    from barloom.plans import views
    from barloom.streaming import jobs

    bars = views.bars(spark, SF).select("symbol", "date", "close").cache()
    folder = str(tmp_path / "bars")
    cut = F.col("date") < F.lit("1998-06-01").cast("date")
    bars.where(cut).coalesce(1).write.parquet(folder)
    stream = jobs.running_indicators(jobs.source(spark, folder, "*.parquet", bars.schema))
    sink = [str(tmp_path / "out"), str(tmp_path / "cp")]

    def run():
        stream.writeStream.format("parquet").option("path", sink[0]).option("checkpointLocation", sink[1]).trigger(
            availableNow=True
        ).start().awaitTermination()

    run()
    bars.where(~cut).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = {(r["symbol"], r["date"]): r["macd_signal"] for r in spark.read.parquet(sink[0]).collect()}
    want = {(r["symbol"], r["date"]): r["macd_signal"] for r in technical.macd(bars).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_bars_in_any_order_within_the_lateness(spark, tmp_path):
    """Shuffled files give the batch's values; what comes behind the clock is set aside; a repeated date too."""
    import datetime as dt
    import random

    from barloom.operators import technical
    from barloom.streaming import jobs

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rng = random.Random(3)
    rows = [("A", d, 100 + rng.random()) for d in days] + [("B", d, 50 + rng.random()) for d in days[::2]]
    schema = "symbol string, date date, close double"
    folder, sink = str(tmp_path / "bars"), [str(tmp_path / "out"), str(tmp_path / "cp")]
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = jobs.ordered_indicators(jobs.source(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema), 10)

    def send(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream.writeStream.format("parquet").option("path", sink[0]).option("checkpointLocation", sink[1]).trigger(availableNow=True).start().awaitTermination()

    # Days at most eight apart change places.
    order = sorted(rows, key=lambda r: (r[1].toordinal() // 8, rng.random()))
    for at in range(0, len(order), 13):
        send(order[at : at + 13])
    before = spark.read.parquet(sink[0])
    assert before.where("late").count() == 0 and before.where("symbol = 'A'").count() < 40
    send([("A", days[2], 1.0), ("A", days[-1], 7.0), ("C", days[0], 5.0)])
    send([("A", days[-1], None), ("B", days[-1], None), ("C", days[-1], None)])
    got = spark.read.parquet(sink[0]).collect()
    assert sorted((r["symbol"], r["date"], r["macd"]) for r in got if r["late"]) == [("A", days[2], None), ("A", days[-1], None)]
    kept = [r for r in rows if r[:2] != ("A", days[-1])] + [("A", days[-1], 7.0), ("C", days[0], 5.0)]
    want = {(r["symbol"], r["date"]): r["macd_signal"] for r in technical.macd(spark.createDataFrame(kept, schema)).collect()}
    found = {(r["symbol"], r["date"]): r["macd_signal"] for r in got if not r["late"]}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_modelling_panel_reads_trades_once_for_each_view(spark, monkeypatch):
    """Weekly bars and the market are written once and read by all that need them."""
    from barloom.plans import catalog_models, catalog_wide

    class Planned(Exception):
        pass

    def stop(*_):
        raise Planned

    calls = []
    for name in ("weekly", "market"):
        view = getattr(catalog_wide.v, name)
        monkeypatch.setattr(catalog_wide.v, name, lambda spark, sf, name=name, view=view: calls.append(name) or view(spark, sf))
    for module in (catalog_models, catalog_wide):
        monkeypatch.setattr(module, "materialize", lambda df, label: df)
    monkeypatch.setattr(catalog_wide.quality, "column_profile", stop)
    with pytest.raises(Planned):
        catalog_wide.modelling_panel(spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["market", "weekly"]
