import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.functions.ewm import ewm, span
from barloom.operators import market, technical as t

from helpers import FOUR, SIX, panel, values


@pytest.fixture(scope="module")
def six(spark):
    return panel(spark, SIX).cache()


def test_ema_sma_roc(six):
    out = ewm(six, {"ema": ("close", span(2))}).withColumns({"sma": w.sma("close", 3), "roc": w.pct_change("close", 2) * 100})
    rows = values(out, "ema", "sma", "roc")
    assert rows[5][0] == pytest.approx(11.736626, abs=1e-6)
    assert rows[1][1] is None and rows[2][1] == pytest.approx(11.033333, abs=1e-6)
    assert rows[5][1] == pytest.approx(11.5)
    assert rows[2][2] == pytest.approx(2.7777777) and rows[5][2] == pytest.approx(8.1818181)


def test_true_range_atr_adx(six):
    rows = values(t.atr(six, 2), "true_range", "atr")
    assert [rows[i][0] for i in (0, 1, 4, 5)] == pytest.approx([1.5, 1.3, 0.9, 0.8])
    assert rows[1][1] == pytest.approx(1.4) and rows[5][1] == pytest.approx(0.8875)
    rows = values(t.adx(six, 2), "plus_di", "minus_di", "adx")
    assert rows[1][0] == pytest.approx(100 * 0.25 / 1.4)
    assert rows[3][1] == pytest.approx(100 * 0.05 / 1.05)
    assert rows[2][2] == pytest.approx(100)


def test_bollinger_cci_mfi_obv(six):
    rows = values(t.bollinger(six, 3), "bb_width", "bb_pctb")
    assert rows[2][0] == pytest.approx(0.06162, abs=1e-5) and rows[2][1] == pytest.approx(0.59804, abs=1e-4)
    assert values(t.cci(six, 3), "cci")[2] == pytest.approx(66.667, abs=1e-3)
    mfi = values(t.mfi(six, 3), "mfi")
    assert mfi[0] == 100.0 and mfi[4] == pytest.approx(73.2835, abs=1e-4)
    assert values(t.obv(six), "obv") == pytest.approx([0, 1200, 100, -800, 500, 2000])


def test_crossover_and_heikin_ashi(spark, six):
    pair = panel(spark, {"fast": [1, 2, 3, 4], "slow": [4, 3, 1, 6]})
    assert values(pair.withColumn("x", t.crossover("fast", "slow")), "x") == [0, 0, 1, -1]
    assert values(t.heikin_ashi(six), "ha_body_pct")[5] == pytest.approx(0.5234375 / 11.1265625)


def test_risk_hand_values(spark):
    out = panel(spark, FOUR).withColumn("r", w.pct_change("close"))
    vol = values(out.withColumn("v", w.annual(w.roll_std("r", 3))), "v")
    assert vol[2] is None and vol[3] == pytest.approx(0.016997 * math.sqrt(252), abs=1e-4)


def test_ewm_matches_pandas_across_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(100, 5, 700)
    x[:3] = np.nan
    gap = x.copy()
    gap[rng.random(700) < 0.2] = np.nan
    rows = [
        ("A", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), None if np.isnan(a) else float(a), None if np.isnan(b) else float(b))
        for i, (a, b) in enumerate(zip(x, gap))
    ]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, g double")
    for alpha in (2 / 13, 1 / 14, 0.5, 0.9):
        out = ewm(df, {"y": ("x", alpha)})
        out = ewm(out, {"z": ("g", alpha)}, gaps=True)
        got = out.orderBy("date").select("y", "z").toPandas()
        for col, src in (("y", x), ("z", gap)):
            want = pd.Series(src).ewm(alpha=alpha, adjust=False).mean()
            np.testing.assert_allclose(got[col].astype(float), want, rtol=1e-10)


def test_drawdown_and_percentile(spark):
    df = panel(spark, {"x": [10, 12, 9, 11, 8, 13]})
    out = values(df.withColumns({"dd": w.max_drawdown("x", 4), "p": w.percentile_of_last("x", 3)}), "dd", "p")
    assert out[2][0] is None and out[3][0] == pytest.approx(9 / 12 - 1) and out[4][0] == pytest.approx(8 / 12 - 1)
    assert out[5][0] == pytest.approx(8 / 11 - 1)
    assert out[1][1] is None and out[2][1] == pytest.approx(1 / 3) and out[5][1] == 1.0


def test_constant_prices_do_not_fail(spark):
    flat = panel(spark, {"open": [5.0] * 80, "high": [5.0] * 80, "low": [5.0] * 80, "close": [5.0] * 80, "volume": [1.0] * 80})
    mkt = flat.select("date", "close")
    out = market.beta_block(market.market_features(t.technical_features(flat), mkt), mkt)
    row = out.orderBy(F.desc("date")).first()
    assert row["bb_pctb"] is None and row["rel_corr_nifty_60d"] is None and row["beta"] is None


def test_features_never_look_ahead(spark):
    """Features of a prefix equal the prefix of the features."""
    rng = np.random.default_rng(0)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150)))
    cols = {
        "open": list(close * 1.001), "high": list(close * 1.01), "low": list(close * 0.99),
        "close": list(close), "volume": list(rng.integers(1000, 2000, 150).astype(float)),
    }
    full = panel(spark, cols)
    part = full.where(F.col("date") <= F.lit("2024-04-30").cast("date"))

    def build(df):
        out = market.risk_block(t.technical_features(df))
        return out.orderBy("date").toPandas().drop(columns=["symbol"]).set_index("date")

    a, b = build(full), build(part)
    pd.testing.assert_frame_equal(a.loc[b.index], b, rtol=1e-9)
