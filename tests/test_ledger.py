import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ledger, splits

from helpers import day, panel, values

FREE = {"brokerage": 0.0, "fee": 0.0, "bps": 0.0}


def signals(spark, directions, symbol="A"):
    return spark.createDataFrame([(symbol, day(i), float(d)) for i, d in enumerate(directions) if d], "symbol string, date date, direction double")


def test_hand_computed_equity(spark):
    bars = panel(spark, {"close": [100, 110, 121, 110, 100, 110, 121]})
    book = ledger.book(bars, signals(spark, [1, 1, 1, 1, 1]), 2, 200.0, costs=FREE)
    curve = ledger.equity(book, 2, 200.0)
    want = [200, 210, 231, 211.909091, 194.553719, 213.644628, 224.644628]
    assert values(curve, "equity") == pytest.approx(want, abs=1e-6)
    assert values(ledger.leverage_check(curve, 2, 200.0), "no_leverage_ok", order=["symbol"]) == [True]


def loop_equity(close, direction, h, capital, cost):
    """Settle, open, mark: one bar after the other."""
    size, cash, live, out = capital / h, capital, [], []
    for t, price in enumerate(close):
        for rec in [r for r in live if r[0] == t]:
            cash += rec[1] * price
        live = [r for r in live if r[0] != t]
        if direction[t] and t + h < len(close):
            cash -= direction[t] * size + size * 2 * cost(price)
            live.append((t + h, direction[t] * size / price))
        out.append(cash + sum(r[1] for r in live) * price)
    return out


def test_equity_equals_the_loop_with_costs_and_shorts(spark):
    rng = np.random.default_rng(2)
    close = list(100 * np.exp(np.cumsum(rng.normal(0, 0.03, 120))))
    direction = [int(x) for x in rng.integers(-1, 2, 120)]
    book = ledger.book(panel(spark, {"close": close}), signals(spark, direction), 5, 1000.0)
    cost = lambda p: (20 + 0.0001 * p + 0.001 * p) / p
    got = values(ledger.equity(book, 5, 1000.0), "equity")
    assert got == pytest.approx(loop_equity(close, direction, 5, 1000.0, cost), rel=1e-9)
    # Invariant: final equity is the capital plus all settled results.
    total = ledger.trades(book).agg(F.sum("pl")).first()[0]
    assert got[-1] == pytest.approx(1000.0 + total)


def test_equity_metrics(spark):
    eq = [100.0, 110.0, 99.0, 105.0]
    r = ledger.equity_metrics(panel(spark, {"equity": eq})).first()
    daily = np.diff(eq) / np.array(eq[:-1])
    assert r["cum_return"] == pytest.approx(0.05) and r["max_dd"] == pytest.approx(99 / 110 - 1)
    assert r["sharpe"] == pytest.approx(daily.mean() / daily.std() * np.sqrt(252))


def folds(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["fold"], r["role"]), []).append(r["date"])
    return {k: sorted(v) for k, v in out.items()}


def test_walk_forward_is_purged(spark):
    days = panel(spark, {"close": [float(i) for i in range(100)]})
    f = folds(splits.walk_forward(days, 10, 20, 30, embargo=5))
    assert {k for k, _ in f} == {0, 1, 2, 3}
    for k in range(4):
        start = 30 + 20 * k
        assert f[(k, "test")] == [day(i) for i in range(start, start + 10)]
        assert f[(k, "train")] == [day(i) for i in range(start - 5)]


def test_short_training_is_not_purged_away(spark):
    days = panel(spark, {"close": [1.0] * 30})
    f = folds(splits.walk_forward(days, 10, 10, 5, embargo=5))
    assert f[(0, "train")] == [day(i) for i in range(5)]


def test_panel_folds_leave_the_holdout_alone(spark):
    days = panel(spark, {"close": [1.0] * 200})
    f = folds(splits.panel_folds(days, 10, 4, 60))
    held = set(f[(-1, "test")])
    assert len(held) == 40
    for (fold, role), dates in f.items():
        if fold >= 0:
            assert not held & set(dates)
            if role == "train":
                gap = (min(f[(fold, "test")]) - max(dates)).days
                assert gap == 11
