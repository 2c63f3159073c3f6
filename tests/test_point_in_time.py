import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import cross, events, joins, labels
from barloom.sources.bars import clean_ohlcv, read_panel_csv

from helpers import day, panel, values


def test_newest_snapshot_wins_even_when_null(spark):
    bars = panel(spark, {"close": [1.0] * 6})
    snaps = spark.createDataFrame(
        [("A", day(1), 1, 5.0), ("A", day(3), 2, None), ("A", day(4), 3, 7.0), ("A", day(4), 4, 8.0)],
        "symbol string, available_at date, seq int, pe double",
    )
    assert values(joins.as_of(bars, snaps, ["pe"], seq="seq"), "pe") == [None, 5.0, 5.0, None, 8.0, 8.0]


def test_undated_snapshot_is_visible_on_the_last_bar_only(spark):
    bars = panel(spark, {"close": [1.0] * 3})
    snap = spark.createDataFrame([("A", None, 4.0)], "symbol string, available_at date, pe double")
    assert values(joins.as_of(bars, joins.default_visibility(snap, bars), ["pe"]), "pe") == [None, None, 4.0]


def test_effective_day_cutoff(spark):
    rows = [
        ("before", "2024-05-06 09:59:59"), ("at", "2024-05-06 10:00:00"), ("after", "2024-05-06 10:00:01"),
        ("friday", "2024-05-10 12:00:00"),
    ]
    df = spark.createDataFrame(rows, "id string, utc string").withColumn(
        "d", events.effective_day(events.local_time(F.to_timestamp_ntz(F.col("utc"), F.lit("yyyy-MM-dd HH:mm:ss"))))
    )
    got = {r["id"]: r["d"] for r in df.collect()}
    assert got == {
        "before": dt.date(2024, 5, 6), "at": dt.date(2024, 5, 6), "after": dt.date(2024, 5, 7), "friday": dt.date(2024, 5, 11),
    }


def test_strict_event_without_time_fails(spark):
    df = spark.createDataFrame([(None,)], "t timestamp_ntz")
    with pytest.raises(Exception, match="no timestamp"):
        df.select(events.effective_day(F.col("t"), strict=True)).collect()


def test_weekend_events_count_on_monday(spark):
    # Business days from Monday 2024-05-06.
    days = [dt.date(2024, 5, 6) + dt.timedelta(days=i) for i in (0, 1, 2, 3, 4, 7, 8, 9, 10)]
    bars = spark.createDataFrame([("A", d, 1.0) for d in days], "symbol string, date date, close double")
    ev = spark.createDataFrame([("A", dt.date(2024, 5, 11)), ("A", dt.date(2024, 5, 12))], "symbol string, effective_date date")
    rows = values(events.event_features(bars, ev, 5), "event_count_5d", "event_today")
    assert rows[4] == (0, 0) and rows[5] == (2, 1) and rows[6] == (2, 0)


def test_sentiment_window(spark):
    bars = spark.createDataFrame([("A", dt.date(2024, 5, 13), 1.0)], "symbol string, date date, close double")
    art = spark.createDataFrame(
        [("A", dt.date(2024, 5, 9), 0.4), ("A", dt.date(2024, 5, 10), -0.2), ("A", dt.date(2024, 5, 13), 0.4), ("A", dt.date(2024, 5, 8), 9.0)],
        "symbol string, effective_date date, score double",
    )
    r = events.sentiment_features(bars, art, 5).first()
    assert r["sent_count_5d"] == 3 and r["sent_score_5d"] == pytest.approx(0.2)
    assert r["sent_pos_ratio_5d"] == pytest.approx(2 / 3) and r["sent_recent"] == pytest.approx(0.4)


def test_midrank_and_thin_groups(spark):
    df = spark.createDataFrame(
        [("x", s, v) for s, v in zip("abcd", (1.0, 2.0, 2.0, 4.0))] + [("thin", "a", 1.0), ("thin", "b", 2.0)],
        "g string, symbol string, v double",
    )
    out = df.withColumn("r", cross.midrank("v", ["g"])).orderBy("g", "symbol")
    assert [r["r"] for r in out.collect()] == [None, None, 0.25, 0.625, 0.625, 1.0]


@pytest.mark.parametrize("n", [3, 4, 5, 6])
def test_leave_one_out_median(spark, n):
    import statistics

    vals = [float((7 * i * i) % 11) for i in range(n)]
    df = spark.createDataFrame([("g", f"s{i}", v) for i, v in enumerate(vals)], "g string, symbol string, v double")
    out = cross.loo_median_divergence(df, "v", ["g"], "d").orderBy("symbol").collect()
    for i, r in enumerate(out):
        assert r["d"] == pytest.approx(vals[i] - statistics.median(vals[:i] + vals[i + 1 :]))


def test_label_bounds(spark):
    df = panel(spark, {"ret": [-0.0101, -0.01, 0.0, 0.01, 0.0101, None], "past_vol": [0.01] * 6})
    rows = values(labels.candidate_labels(df, "ret"), "label_binary", "label_meaningful", "label_three")
    assert [r[0] for r in rows] == [0, 0, 0, 1, 1, None]
    assert [r[1] for r in rows] == [0, 0, 0, 0, 1, None]
    assert [r[2] for r in rows] == [-1, 0, 0, 0, 1, None]


def test_forward_outcome_waits_for_history(spark):
    bars = spark.createDataFrame([("A", day(i), 100.0 + i) for i in (0, 1, 3, 4, 5)], "symbol string, date date, close double")
    preds = spark.createDataFrame(
        [("A", str(day(1)), None), ("A", str(day(2)), 50.0), ("A", str(day(4)), None)], "symbol string, as_of string, close double"
    )
    rows = joins.forward_outcome(preds, bars, 2).orderBy("as_of").collect()
    assert rows[0]["exit_close"] == 104.0 and rows[0]["realised_return"] == pytest.approx(104 / 101 - 1, abs=1e-6)
    assert rows[1]["entry_close"] == 50.0 and rows[1]["exit_close"] == 105.0
    assert rows[2]["scored"] is False and rows[2]["realised_return"] is None


def test_bad_panel_date_fails(spark, tmp_path):
    (tmp_path / "p.csv").write_text("symbol,date,open,high,low,close,volume\nA,2024-01-01,1,1,1,1,1\nA,soon,1,1,1,1,1\n")
    with pytest.raises(Exception, match="invalid date"):
        read_panel_csv(spark, str(tmp_path / "p.csv")).collect()


def test_clean_bars(spark):
    raw = spark.createDataFrame(
        [("A", "2024-01-01", "1.5", "10"), ("A", "2024-01-02", "n/a", "10"), ("A", "2024-01-03", "NaN", "10")],
        "symbol string, Date string, Close string, Volume string",
    )
    rows = clean_ohlcv(raw).collect()
    assert len(rows) == 1 and rows[0]["adj_close"] == 1.5
