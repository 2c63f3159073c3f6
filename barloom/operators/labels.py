"""Forward-looking labels: the only columns that read later rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w


def add_target(df: DataFrame, horizon: int = 20, x: str = "close") -> DataFrame:
    ret = w.ratio(w.lead(x, horizon), x) - 1
    out = df.withColumn(f"target_ret_{horizon}d", ret)
    r = F.col(f"target_ret_{horizon}d")
    return out.withColumn(f"target_up_{horizon}d", F.when(r.isNotNull(), (r > 0).cast("double")))


def vol_threshold_label(df: DataFrame, horizon: int = 20, k: float = 0.5, n: int = 20) -> DataFrame:
    """Up / down / unknown outside and inside a volatility band around zero."""
    out = df.withColumn("_r", w.pct_change("close"))
    theta = k * w.roll_std("_r", n, sample=True) * F.sqrt(F.lit(float(horizon)))
    out = out.withColumn(f"vol_theta_{horizon}d", theta).drop("_r")
    r, t = F.col(f"target_ret_{horizon}d"), F.col(f"vol_theta_{horizon}d")
    return out.withColumn(f"train_up_{horizon}d", F.when(r > t, 1.0).when(r < -t, 0.0))


def past_volatility(df: DataFrame, n: int = 20) -> DataFrame:
    """Sample deviation of the ``n`` returns before the row's own."""
    out = df.withColumn("_r", w.pct_change("close"))
    frame = w.ordered().rowsBetween(-n, -1)
    value = F.when(F.count("_r").over(frame) == n, F.stddev_samp("_r").over(frame))
    return out.withColumn("past_vol", value).drop("_r")


def candidate_labels(df: DataFrame, ret: str, band: float = 0.01, vol: str = "past_vol", k: float = 1.0) -> DataFrame:
    r = F.col(ret)
    known = r.isNotNull()
    ratio = w.ratio(r, F.when(F.col(vol) > 0, F.col(vol)))
    return df.withColumns(
        {
            "label_binary": F.when(known, (r > 0).cast("int")),
            "label_meaningful": F.when(known, (r > band).cast("int")),
            "label_three": F.when(r > band, 1).when(r < -band, -1).when(known, 0),
            "vol_adjusted": ratio,
            "label_vol_binary": F.when(ratio.isNotNull(), (ratio > k).cast("int")),
            "label_vol_three": F.when(ratio > k, 1).when(ratio < -k, -1).when(ratio.isNotNull(), 0),
            "label_regression": r,
        }
    )


LABELS = ["label_binary", "label_meaningful", "label_three", "label_vol_binary", "label_vol_three"]

# Edges of the near-zero histogram, left closed.
NEAR_ZERO = [0.0, 0.001, 0.005, 0.01, 0.02]


def label_counts(df: DataFrame, labels=LABELS) -> DataFrame:
    """Count and share per label value; an undefined label is its own class."""
    long = df.unpivot(["symbol", "date"], labels, "label", "value")
    counted = long.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("label"))
    defined = F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).over(Window.partitionBy("label"))
    return counted.withColumns(
        {
            "n_defined": defined,
            "n_undefined": total - defined,
            "share": F.when(F.col("value").isNotNull(), F.try_divide(F.col("n"), defined)),
        }
    )


def near_zero_histogram(df: DataFrame, ret: str) -> DataFrame:
    size = F.abs(F.col(ret))
    lower = F.lit(None).cast("double")
    for edge in NEAR_ZERO:
        lower = F.when(size >= edge, edge).otherwise(lower)
    counted = (
        df.where(F.col(ret).isNotNull())
        .groupBy(lower.alias("lower"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("share", F.col("n") / total)


def label_agreement(df: DataFrame, labels=LABELS) -> DataFrame:
    """Rows, agreement and correlation for each pair of label columns, one pass."""
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        aggs += [
            F.struct(
                F.lit(a).alias("left"),
                F.lit(b).alias("right"),
                F.count_if(both).alias("n"),
                F.count_if(both & (F.col(a) == F.col(b))).alias("equal"),
                F.when(
                    (F.count_if(both) >= 2) & (F.min(x) != F.max(x)) & (F.min(y) != F.max(y)), w.correlation(x, y)
                ).alias("corr"),
            ).alias(f"p{i}")
        ]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[f"p{i}" for i in range(len(pairs))]))).withColumn(
        "rate", F.try_divide(F.col("equal"), F.col("n"))
    )


def band_coverage(df: DataFrame, ret: str, theta: str) -> DataFrame:
    """Labelled rows and those outside the noise band."""
    outside = F.abs(F.col(ret)) > F.col(theta)
    return df.agg(
        F.count(ret).alias("labelled"),
        F.count_if(outside).alias("outside"),
        F.try_divide(F.count_if(outside), F.count(ret)).alias("ratio"),
    )
