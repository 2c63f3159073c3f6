import pytest

from barloom.operators import holdings, intents, policy
from barloom.functions import scalar as sc

CASES = [
    ("1000 se zyada wale", {"min_price": 1000.0}),
    ("20 din ka BUY signal do", {"max_price": None, "min_price": None, "action": "buy", "bullish_days": None}),
    ("5% growth wale", {"max_price": None}),
    ("200 wale stocks do", {"max_price": 200.0}),
    ("100 rupaye se niche wale stocks do", {"max_price": 100.0}),
    ("100/- se niche ke stock do", {"max_price": 100.0}),
    ("100 ke under stocks", {"max_price": 100.0}),
    ("2000 rupaye se zyada wale", {"min_price": 2000.0}),
    ("strong bullish wale stock do", {"action": "strong_buy"}),
    ("strong bearish stocks dikhao", {"action": "strong_sell"}),
    ("bullish signal wale stocks", {"action": "buy"}),
    ("bearish stocks", {"action": "sell"}),
    ("5 din se bullish stock do", {"bullish_days": 5, "max_price": None, "min_price": None}),
    ("10 din se upar wale stocks", {"bullish_days": 10}),
    ("3 din se badh raha stock", {"bullish_days": 3}),
    ("99 din se bullish", {"bullish_days": 60}),
    ("penny stocks", {"max_price": 100.0}),
    ("top 5 buy", {"top": 5}),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    got = {r["id"]: r for r in intents.parse_intent(df).collect()}
    for i, (text, want) in enumerate(CASES):
        for field, value in want.items():
            assert got[i][field] == value, (text, field, got[i][field])


def test_symbols_and_numbers(spark):
    df = spark.createDataFrame([("tcs.ns",), ("X.NSE",), ("infy.bo",)], "s string")
    assert [r[0] for r in df.select(sc.clean_symbol("s")).collect()] == ["TCS", "XE", "INFY"]
    df = spark.createDataFrame([("1,234.5 %",), ("-",), ("n/a",), ("up -3%",), ("",)], "s string")
    assert [r[0] for r in df.select(sc.parse_percent("s")).collect()] == [1234.5, None, None, -3.0, None]
    assert [r[0] for r in df.select(sc.format_percent("s")).collect()][0] == "1234.50%"


def test_greeks_against_erf(spark):
    import math

    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    df = spark.createDataFrame([(100.0, 110.0, 0.5, 0.3), (100.0, 100.0, 0.0, 0.3)], "s double, k double, t double, v double")
    ok, bad = sc.call_greeks(df, "s", "k", "t", "v").collect()
    d1 = (math.log(100 / 110) + (0.06 + 0.045) * 0.5) / (0.3 * math.sqrt(0.5))
    d2 = d1 - 0.3 * math.sqrt(0.5)
    assert ok["delta"] == pytest.approx(cdf(d1), abs=1e-12)
    assert ok["rho"] == pytest.approx(110 * 0.5 * math.exp(-0.03) * cdf(d2), abs=1e-10)
    assert bad["delta"] is None


def test_policy_bounds(spark):
    rows = [("a", 0.46, 0.0), ("b", 0.61, 0.0), ("c", 0.61, -1.0), ("d", 0.63, -1.0), ("e", 0.4, 0.0), ("f", 0.55, None)]
    df = spark.createDataFrame(rows, "symbol string, p double, trend double")
    got = {r["symbol"]: (r["signal"], r["direction"]) for r in policy.decide(df, trend="trend").collect()}
    assert got == {
        "a": ("HOLD", 0), "b": ("BUY", 1), "c": ("HOLD", 0), "d": ("BUY", 1), "e": ("SELL", 0), "f": ("HOLD", 0),
    }
    with pytest.raises(ValueError):
        policy.decide(df, buy=0.4, sell=0.6)


def test_uncertainty(spark):
    df = spark.createDataFrame([(0.4, 0.6), (0.8, 0.7)], "a double, b double")
    rows = policy.uncertainty(df, ["a", "b"]).collect()
    assert [r["probability"] for r in rows] == pytest.approx([0.5, 0.75])
    assert [r["margin"] for r in rows] == pytest.approx([0.0, 0.25])
    assert rows[0]["disagreement"] == pytest.approx(0.1)


def test_holder_names(spark):
    names = ["LIC of India", "Mutual Funds", "Total Assets", "42", "Jun 2024", "ab", "Promoters", "Axis Fund"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = [r["n"] for r in df.where(holdings.is_holder("n")).collect()]
    assert kept == ["LIC of India", "Axis Fund"]


def test_opposite_bounds_are_different_requests(spark):
    from barloom.operators import screen

    req = spark.createDataFrame(
        [(1, 100.0, None, None, None, 10), (2, None, 100.0, None, None, 10)],
        "id int, max_price double, min_price double, action string, bullish_days int, top int",
    )
    cards = spark.createDataFrame(
        [("cheap", 50.0, "BUY", 90.0, 1), ("dear", 500.0, "BUY", 80.0, 1)],
        "symbol string, current_price double, signal string, confidence double, up_days int",
    )
    from pyspark.sql import functions as F

    cards = cards.withColumns({f"ret{n}d": F.lit(1.0) for n in screen.RETURN_DAYS} | {"categories": F.array().cast("array<string>")})
    got = {(r["id"], r["symbol"]) for r in screen.screen(req, cards).collect()}
    assert got == {(1, "cheap"), (2, "dear")}


def test_phrases_of_any_length_and_underscores(spark):
    messages = spark.createDataFrame(
        [(1, "Is Bank of the Great Big North Limited a buy?"), (2, "what about acme_corp"), (3, "and Acme Corp, today")], "id long, text string"
    )
    names = spark.createDataFrame([("bank of the great big north limited", "BIG"), ("acme corp", "ACME")], "phrase string, symbol string")
    found = intents.mentions(messages, spark.createDataFrame([("ZZZ",)], "symbol string"), names)
    assert {r["id"]: r["symbols"] for r in intents.mention_lists(found).collect()} == {1: ["BIG"], 3: ["ACME"]}


def test_first_row_of_a_category_counts(spark):
    rows = [
        ("A", 1, "Promoters +", "50%"), ("A", 2, "Promoter Group (sub)", "10%"), ("A", 3, "FIIs / FPI", "20%"),
        ("A", 4, "DIIs", "15%"), ("A", 5, "Public", "15%"),
    ]
    wide = spark.createDataFrame(rows, "symbol string, row int, label string, `Mar 2024` string")
    got = holdings.quarterly_shareholding(wide, "label", ["Mar 2024"], "row").first()
    assert got["promoter"].startswith("50")
