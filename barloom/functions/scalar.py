"""Scalar column helpers: symbols, numbers, dates, normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import col

# Exchange suffixes in the order they are removed.
SUFFIXES = [".NS", ".NSE", ".BO", ".BSE"]
SYMBOL_PATTERN = "^[A-Z0-9]{1,10}$"
BLANKS = ["", "nan", "none", "-", "n/a", "--"]


def clean_symbol(x) -> Column:
    """Upper case without exchange suffix (``.NS`` goes first, so ``X.NSE`` is ``XE``)."""
    out = F.upper(col(x))
    for suffix in SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.trim(out)


def is_symbol(x) -> Column:
    return col(x).rlike(SYMBOL_PATTERN)


def exchange_symbol(x, exchange: str = "NS") -> Column:
    return F.concat(clean_symbol(x), F.lit(".BO" if exchange.upper() == "BSE" else ".NS"))


def squeeze(x) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), r"\s+", " "))


def parse_percent(x) -> Column:
    """First signed number of a text such as ``12,345.6 %``; blanks are NULL."""
    text = squeeze(x)
    hit = F.regexp_extract(F.replace(text, F.lit("%"), F.lit("")), r"-?\d+(?:,\d+)*(?:\.\d+)?", 0)
    number = F.replace(hit, F.lit(","), F.lit(""))
    return F.when(~F.lower(text).isin(BLANKS) & (hit != ""), number.try_cast("double"))


def format_percent(x) -> Column:
    value = parse_percent(x)
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f%%", F.bround(value, 2)))


def parse_when(x) -> Column:
    """ISO text with optional ``Z``, or ``yyyy-MM-dd HH:mm:ss``; anything else NULL."""
    text = F.regexp_replace(col(x), "Z$", "+00:00")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(col(x), F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def finite(x, digits: int | None = None) -> Column:
    """NULL for NaN and infinities, optionally rounded."""
    c = col(x).cast("double")
    kept = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return kept if digits is None else F.round(kept, digits)


# Coefficients of Hart's double-precision rational approximation, highest
# power first (numerator, denominator).
HART_TOP = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_BOTTOM = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x) -> Column:
    """Standard normal distribution to about 14 digits; Spark has no ``erf``."""
    c = col(x)
    a = F.abs(c)
    near = _polynomial(a, HART_TOP) / _polynomial(a, HART_BOTTOM)
    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + k / far
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, near).otherwise(1.0 / far / 2.506628274631)
    return F.when(c > 0, 1.0 - tail).otherwise(tail)


def normal_pdf(x) -> Column:
    return F.exp(-0.5 * col(x) * col(x)) / math.sqrt(2.0 * math.pi)


def call_greeks(
    df: DataFrame, spot: str, strike: str, years, sigma: str, rate: float = 0.06, dividend: float = 0.0
) -> DataFrame:
    """Add delta, gamma, theta (per day), vega and rho of a European call; NULL unless
    prices, volatility and time are positive.

    Intermediate values are columns of their own, so that no long expression is repeated
    inside another.
    """
    s, k, v = F.col(spot), F.col(strike), F.col(sigma)
    out = df.withColumn("_t", col(years).cast("double") if not isinstance(years, float) else F.lit(years))
    t = F.col("_t")
    ok = (v > 0) & (t > 0) & (s > 0) & (k > 0)
    d1 = (F.log(s / k) + (rate - dividend + v * v / 2.0) * t) / (v * F.sqrt(t))
    out = out.withColumn("_d1", F.when(ok, d1)).withColumn("_d2", F.col("_d1") - v * F.sqrt(t))
    out = out.withColumns({"_n1": normal_cdf("_d1"), "_n2": normal_cdf("_d2"), "_pdf": normal_pdf("_d1")})
    carry, disc = F.exp(-dividend * t), F.exp(-rate * t)
    theta = (
        -carry * F.col("_pdf") * v / (2.0 * F.sqrt(t)) - rate * k * disc * F.col("_n2") + dividend * s * carry * F.col("_n1")
    ) / 365.0
    raw = {
        "delta": carry * F.col("_n1"),
        "gamma": carry * F.col("_pdf") / (F.greatest(F.lit(1e-12), s) * v * F.sqrt(t)),
        "theta": theta,
        "vega": s * carry * F.col("_pdf") * F.sqrt(t),
        "rho": k * t * disc * F.col("_n2"),
    }
    known = F.col("_d1").isNotNull()
    return out.withColumns({n: F.when(known, c) for n, c in raw.items()}).drop("_t", "_d1", "_d2", "_n1", "_n2", "_pdf")


def independent_windows(n, horizon: int) -> Column:
    """Non-overlapping windows inside ``n`` overlapping rows."""
    c = col(n)
    return F.when((c > 0) & F.lit(horizon > 0), F.ceil(c / max(horizon, 1))).otherwise(F.lit(0))
