"""Technical features of OHLCV bars; one exchange by symbol serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.ewm import ewm, span, wilder

RETURN_HORIZONS = (1, 3, 5, 10, 20, 60, 120)
DISTANCE_PERIODS = (20, 50, 200)
CROSS_PAIRS = ((20, 50), (20, 200))


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    out = ewm(df, {"_fast": (x, span(fast)), "_slow": (x, span(slow))})
    out = df_named(out, df, macd=F.col("_fast") - F.col("_slow"))
    out = ewm(out, {"macd_signal": ("macd", span(signal))})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def df_named(out: DataFrame, base: DataFrame, **named: Column) -> DataFrame:
    """Base columns of ``out`` plus the named ones."""
    return out.select(*[c for c in base.columns if c not in named], *[c.alias(n) for n, c in named.items()])


def rsi(df: DataFrame, n: int = 14, x: str = "close", name: str = "rsi") -> DataFrame:
    """Wilder RSI; the first row counts as no change, NULL while nothing ever fell."""
    step = w.diff(x)
    prepared = df.withColumns(
        {
            "_up": F.when(w.is_true(step > 0), step).otherwise(0.0),
            "_down": F.when(w.is_true(step < 0), -step).otherwise(0.0),
        }
    )
    out = ewm(prepared, {"_gain": ("_up", wilder(n)), "_loss": ("_down", wilder(n))})
    rs = w.ratio("_gain", "_loss")
    return df_named(out, df, **{name: 100 - 100 / (1 + rs)})


def rsi_simple(df: DataFrame, n: int = 14, x: str = "close", name: str = "rsi_simple") -> DataFrame:
    """Chart RSI: plain averages of the last ``n`` changes, 100 when nothing fell."""
    step = w.diff(x)
    prepared = df.withColumn("_step", step)
    gain = w.sma(F.greatest(F.col("_step"), F.lit(0.0)), n)
    loss = w.sma(F.greatest(-F.col("_step"), F.lit(0.0)), n)
    # greatest() skips NULL, so the first change must be masked explicitly.
    known = F.count("_step").over(w.trailing(n)) == n
    out = prepared.withColumns({"_g": gain, "_l": loss, "_k": known})
    value = F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + w.ratio("_g", "_l")))
    return df_named(out, df, **{name: F.when(F.col("_k"), value)})


def ema_seeded(df: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """Chart EMA: the first value is the mean of the first ``n`` inputs."""
    seen = F.count(F.col(x)).over(w.running())
    seed = F.avg(F.col(x)).over(w.running())
    fed = F.when(seen == n, seed).when(seen > n, F.col(x))
    out = ewm(df.withColumn("_fed", fed), {name: ("_fed", span(n))})
    return out.drop("_fed")


def macd_chart(df: DataFrame, x: str = "close") -> DataFrame:
    """Chart MACD (12, 26, 9) from seeded EMAs; 35 rows at least.

    Values stay unrounded, so that they can be computed with; rounding to cents is the chart's.
    """
    out = ema_seeded(ema_seeded(df, x, 12, "_fast"), x, 26, "_slow")
    out = df_named(out, df, _line=F.col("_fast") - F.col("_slow"))
    out = ema_seeded(out, "_line", 9, "_sig")
    enough = F.count(F.lit(1)).over(Window.partitionBy("symbol")) >= 35
    out = out.withColumn("_enough", enough)
    return df_named(
        out,
        df,
        macd_line=F.when(F.col("_enough"), F.col("_line")),
        macd_signal_line=F.when(F.col("_enough"), F.col("_sig")),
        macd_histogram=F.when(F.col("_enough"), F.col("_line") - F.col("_sig")),
    )


def true_range() -> Column:
    before = w.lag("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )


def directional_moves() -> tuple[Column, Column]:
    up, down = w.diff("high"), -w.diff("low")
    plus = F.when(w.is_true((up > down) & (up > 0)), up).otherwise(0.0)
    minus = F.when(w.is_true((down > up) & (down > 0)), down).otherwise(0.0)
    return plus, minus


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    out = ewm(df.withColumn("true_range", true_range()), {"atr": ("true_range", wilder(n))})
    return out.withColumn("atr_pct", w.ratio("atr", "close"))


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    plus, minus = directional_moves()
    prepared = df.withColumns({"_tr": true_range(), "_plus": plus, "_minus": minus})
    a = wilder(n)
    out = ewm(prepared, {"_atr": ("_tr", a), "_p": ("_plus", a), "_m": ("_minus", a)})
    out = df_named(
        out, df, plus_di=100 * w.ratio("_p", "_atr"), minus_di=100 * w.ratio("_m", "_atr")
    )
    both = F.col("plus_di") + F.col("minus_di")
    out = out.withColumn("_dx", 100 * w.ratio(F.abs(F.col("plus_di") - F.col("minus_di")), both))
    return ewm(out, {"adx": ("_dx", a)}, gaps=True).drop("_dx")


def heikin_ashi(df: DataFrame) -> DataFrame:
    """Candles whose open is the previous half-weight mean of closes."""
    close = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    out = ewm(df.withColumn("ha_close", close), {"_mean": ("ha_close", 0.5)})
    out = out.withColumn("ha_open", F.coalesce(w.lag("_mean"), F.col("ha_close"))).drop("_mean")
    body = F.col("ha_close") - F.col("ha_open")
    return out.withColumns(
        {
            "ha_high": F.greatest("high", "ha_open", "ha_close"),
            "ha_low": F.least("low", "ha_open", "ha_close"),
            "ha_body_pct": w.ratio(body, "ha_open"),
            "ha_direction": F.signum(body),
        }
    )


def staged(df: DataFrame, *blocks: list[dict[str, Column]]) -> DataFrame:
    """Add blocks of columns. A block is a list of stages, each reading columns of the
    stage before; equal stages of all blocks become one projection. Names starting with
    ``_`` are dropped at the end."""
    out, temporary = df, []
    for i in range(max(len(b) for b in blocks)):
        stage = {name: c for b in blocks if i < len(b) for name, c in b[i].items()}
        temporary += [name for name in stage if name.startswith("_")]
        out = out.withColumns(stage)
    return out.drop(*temporary)


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def obv_steps() -> list[dict[str, Column]]:
    sign = F.coalesce(F.signum(w.diff("close")), F.lit(0.0))
    return [
        {"_obv_flow": sign * F.col("volume")},
        {"obv": F.sum("_obv_flow").over(w.running())},
        {"obv_slope": w.pct_change("obv", 20)},
    ]


def obv(df: DataFrame) -> DataFrame:
    return staged(df, obv_steps())


def session_vwap(df: DataFrame, keys=("symbol", "session"), order: str = "time") -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    spec = w.running(keys, order)
    value = F.sum(typical * F.col("volume")).over(spec)
    volume = F.sum("volume").over(spec)
    return df.withColumn("vwap", F.when(volume > 0, value / volume).otherwise(typical))


def bollinger_steps(n: int = 20, k: float = 2.0, x: str = "close") -> list[dict[str, Column]]:
    upper, lower = F.col("bb_mid") + k * F.col("_bb_std"), F.col("bb_mid") - k * F.col("_bb_std")
    return [
        {"bb_mid": w.sma(x, n), "_bb_std": w.roll_std(x, n)},
        {
            "bb_upper": upper,
            "bb_lower": lower,
            "bb_width": w.ratio(upper - lower, "bb_mid"),
            "bb_pctb": w.ratio(F.col(x) - lower, upper - lower),
        },
    ]


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, x: str = "close") -> DataFrame:
    return staged(df, bollinger_steps(n, k, x))


def cci_steps(n: int = 20) -> list[dict[str, Column]]:
    return [
        {"_cci_tp": typical_price()},
        {"_cci_mean": w.sma("_cci_tp", n), "_cci_dev": w.mean_abs_dev("_cci_tp", n)},
        {"cci": w.ratio(F.col("_cci_tp") - F.col("_cci_mean"), 0.015 * F.col("_cci_dev"))},
    ]


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    return staged(df, cci_steps(n))


def mfi_steps(n: int = 14) -> list[dict[str, Column]]:
    """100 whenever no outflow is known, warm-up included."""
    tp, before = F.col("_mfi_tp"), w.lag("_mfi_tp")
    money = tp * F.col("volume")
    value = 100 - 100 / (1 + w.ratio("_mfi_pos", "_mfi_neg"))
    return [
        {"_mfi_tp": typical_price()},
        {
            "_mfi_in": F.when(w.is_true(tp > before), money).otherwise(0.0),
            "_mfi_out": F.when(w.is_true(tp < before), money).otherwise(0.0),
        },
        {"_mfi_pos": w.roll_sum("_mfi_in", n), "_mfi_neg": w.roll_sum("_mfi_out", n)},
        {"mfi": F.when(w.is_true(F.col("_mfi_neg") > 0), value).otherwise(100.0)},
    ]


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    return staged(df, mfi_steps(n))


def return_steps(horizons=RETURN_HORIZONS, x: str = "close") -> list[dict[str, Column]]:
    return [{f"ret_{n}d": w.pct_change(x, n) for n in horizons}]


def returns(df: DataFrame, horizons=RETURN_HORIZONS, x: str = "close") -> DataFrame:
    return staged(df, return_steps(horizons, x))


def rate_of_change_steps(horizons=(1, 5, 10, 20), x: str = "close") -> list[dict[str, Column]]:
    return [{f"roc_{n}d": w.pct_change(x, n) * 100 for n in horizons}]


def rate_of_change(df: DataFrame, horizons=(1, 5, 10, 20), x: str = "close") -> DataFrame:
    return staged(df, rate_of_change_steps(horizons, x))


def momentum(df: DataFrame, n: int = 10, x: str = "close") -> DataFrame:
    return df.withColumn(f"mom_{n}d", w.diff(x, n))


def crossover(fast, slow) -> Column:
    """+1 when ``fast`` crosses above ``slow``, -1 below, 0 otherwise or unknown."""
    f, s = w.col(fast), w.col(slow)
    pf, ps = w.lag(f), w.lag(s)
    above = w.is_true((f > s) & (pf <= ps))
    below = w.is_true((f < s) & (pf >= ps))
    return F.when(above, 1.0).when(below, -1.0).otherwise(0.0)


def moving_average_steps(x: str = "close") -> list[dict[str, Column]]:
    """Distances, slopes, crossovers and spreads of simple averages."""
    made = {}
    for n in DISTANCE_PERIODS:
        made[f"dist_sma{n}"] = w.ratio(x, f"_ma{n}") - 1
        made[f"ma_slope_sma{n}_5d"] = w.slope(f"_ma{n}", 5)
    for fast, slow in CROSS_PAIRS:
        made[f"ma_cross_{fast}_{slow}"] = crossover(f"_ma{fast}", f"_ma{slow}")
        made[f"ma_spread_{fast}_{slow}"] = w.ratio(F.col(f"_ma{fast}") - F.col(f"_ma{slow}"), f"_ma{slow}")
    return [{f"_ma{n}": w.sma(x, n) for n in DISTANCE_PERIODS}, made]


def moving_average_block(df: DataFrame, x: str = "close") -> DataFrame:
    return staged(df, moving_average_steps(x))


def pivot_steps(n: int = 10) -> list[dict[str, Column]]:
    return [
        {"pivot_high": w.roll_max("high", n), "pivot_low": w.roll_min("low", n)},
        {
            "pivot_dist_high_pct": w.ratio("close", "pivot_high") - 1,
            "pivot_dist_low_pct": w.ratio("close", "pivot_low") - 1,
        },
    ]


def pivots(df: DataFrame, n: int = 10) -> DataFrame:
    return staged(df, pivot_steps(n))


def fibonacci_steps(n: int = 60) -> list[dict[str, Column]]:
    reach = F.nullif(F.col("_fib_hi") - F.col("_fib_lo"), F.lit(0.0))
    made = {"fib_level_pct": w.ratio(F.col("close") - F.col("_fib_lo"), reach)}
    for level in (0.382, 0.618):
        off = F.abs(F.col("close") - (F.col("_fib_hi") - level * reach))
        made[f"fib_dist_{int(level * 1000)}"] = w.ratio(off, "close")
    return [{"_fib_hi": w.roll_max("high", n), "_fib_lo": w.roll_min("low", n)}, made]


def fibonacci(df: DataFrame, n: int = 60) -> DataFrame:
    return staged(df, fibonacci_steps(n))


def high_and_volume_steps() -> list[dict[str, Column]]:
    return [
        {
            "dist_52w_high": w.ratio("close", F.max("close").over(w.trailing(252))) - 1,
            "vol_ratio_20_60": w.ratio(w.sma("volume", 20), w.sma("volume", 60)),
        }
    ]


def highs_and_volume(df: DataFrame) -> DataFrame:
    return staged(df, high_and_volume_steps())


def technical_features(df: DataFrame) -> DataFrame:
    """The whole technical group. Recursions share three EWM passes."""
    plus, minus = directional_moves()
    step = w.diff("close")
    ha = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    prepared = df.withColumns(
        {
            "_tr": true_range(),
            "_plus": plus,
            "_minus": minus,
            "_up": F.when(w.is_true(step > 0), step).otherwise(0.0),
            "_down": F.when(w.is_true(step < 0), -step).otherwise(0.0),
            "_hac": ha,
        }
    )
    a = wilder(14)
    out = ewm(
        prepared.withColumnsRenamed({c: f"t{c}" for c in ["_tr", "_plus", "_minus", "_up", "_down", "_hac"]}),
        {
            "atr": ("t_tr", a),
            "t_p": ("t_plus", a),
            "t_m": ("t_minus", a),
            "t_gain": ("t_up", a),
            "t_loss": ("t_down", a),
            "t_ema12": ("close", span(12)),
            "t_ema26": ("close", span(26)),
            "t_ema50": ("close", span(50)),
            "t_ham": ("t_hac", 0.5),
        },
    )
    out = out.withColumns(
        {
            "plus_di": 100 * w.ratio("t_p", "atr"),
            "minus_di": 100 * w.ratio("t_m", "atr"),
            "atr_pct": w.ratio("atr", "close"),
            "rsi": 100 - 100 / (1 + w.ratio("t_gain", "t_loss")),
            "macd": F.col("t_ema12") - F.col("t_ema26"),
            "dist_ema50": w.ratio("close", "t_ema50") - 1,
            "t_hao": F.coalesce(w.lag("t_ham"), F.col("t_hac")),
        }
    ).withColumns(
        {
            "t_dx": 100
            * w.ratio(
                F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")
            ),
            "ha_body_pct": w.ratio(F.col("t_hac") - F.col("t_hao"), "t_hao"),
            "ha_direction": F.signum(F.col("t_hac") - F.col("t_hao")),
        }
    )
    out = ewm(out, {"macd_signal": ("macd", span(9))})
    out = ewm(out, {"adx": ("t_dx", a)}, gaps=True)
    out = out.drop(*[c for c in out.columns if c.startswith("t_")])
    averages = [{"sma20": w.sma("close", 20), "sma50": w.sma("close", 50), "mom_10d": w.diff("close", 10)}]
    return staged(
        out, averages, bollinger_steps(), cci_steps(), obv_steps(), mfi_steps(), rate_of_change_steps(), return_steps(),
        moving_average_steps(), pivot_steps(), fibonacci_steps(), high_and_volume_steps(),
    )


TECHNICAL = sorted(
    ["bb_upper", "bb_mid", "bb_lower", "bb_width", "bb_pctb", "atr", "atr_pct", "adx", "plus_di",
     "minus_di", "cci", "obv", "obv_slope", "mfi", "mom_10d", "dist_ema50", "ha_body_pct",
     "ha_direction", "pivot_high", "pivot_low", "pivot_dist_high_pct", "pivot_dist_low_pct",
     "fib_level_pct", "fib_dist_382", "fib_dist_618", "dist_52w_high", "vol_ratio_20_60"]
    + [f"roc_{n}d" for n in (1, 5, 10, 20)]
    + [f"ret_{n}d" for n in RETURN_HORIZONS]
    + [f"dist_sma{n}" for n in DISTANCE_PERIODS]
    + [f"ma_slope_sma{n}_5d" for n in DISTANCE_PERIODS]
    + [f"ma_{kind}_{f}_{s}" for kind in ("cross", "spread") for f, s in CROSS_PAIRS]
)
