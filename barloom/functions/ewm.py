"""Exponentially weighted means without a row loop.

``y[t] = a*x[t] + (1-a)*y[t-1]`` is an affine recursion, so a symbol's rows are cut into
blocks: inside a block the recursion is one running sum of rescaled inputs, and each
block only needs the value its predecessor ended on. Those block ends are folded over a
short array (one entry per 256 rows), all inside window functions on one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import col


def _block_rows(alphas) -> int:
    steepest = max(-math.log(1.0 - a) for a in alphas)
    return max(2, min(256, int(600 / steepest)))


def ewm(df: DataFrame, specs: dict, gaps: bool = False, keys=("symbol",), order="date") -> DataFrame:
    """Add one column per entry of ``specs`` = ``{name: (input, alpha)}``.

    Leading NULLs stay NULL and the first value seeds the mean. With ``gaps`` the inputs
    may turn NULL later: the mean is carried and its weight decays by each missed row.
    """
    block = _block_rows([a for _, a in specs.values()])
    by_row = Window.partitionBy(*keys).orderBy(order)
    so_far = by_row.rowsBetween(Window.unboundedPreceding, 0)
    before = by_row.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__rn", F.row_number().over(by_row) - 1)
    staged = {}
    for name, (x, _) in specs.items():
        staged[f"__x_{name}"] = col(x).cast("double")
        staged[f"__n_{name}"] = F.count(col(x)).over(so_far)
        if gaps:
            staged[f"__prev_{name}"] = F.max(F.when(col(x).isNotNull(), F.col("__rn"))).over(before)
    staged["__block"] = F.floor(F.col("__rn") / block)
    staged["__j"] = (F.col("__rn") % block).cast("double")
    out = out.withColumns(staged)

    # Same sort serves both: blocks grow with time.
    in_block = (
        Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("__block", order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    decay = {}
    for name, (_, a) in specs.items():
        x, n = F.col(f"__x_{name}"), F.col(f"__n_{name}")
        first = n == 1
        if not gaps:
            weight = F.when(first, 1.0).otherwise(F.lit(float(a)))
            scale = F.pow(F.lit(1.0 - a), F.col("__j"))
            decay[f"__s_{name}"] = scale
            decay[f"__w_{name}"] = F.when(x.isNotNull(), weight * x / scale).otherwise(0.0)
        else:
            kept = F.pow(F.lit(1.0 - a), F.col("__rn") - F.col(f"__prev_{name}"))
            live = x.isNotNull() & F.col(f"__prev_{name}").isNotNull()
            keep = F.when(live, kept / (kept + F.lit(float(a)))).otherwise(1.0)
            gain = F.when(live, 1.0 - keep).when(x.isNotNull(), 1.0).otherwise(0.0)
            decay[f"__k_{name}"] = F.log(keep)
            decay[f"__w_{name}"] = gain * F.coalesce(x, F.lit(0.0))
    out = out.withColumns(decay)
    if gaps:
        out = out.withColumns(
            {f"__s_{n}": F.exp(F.sum(f"__k_{n}").over(in_block)) for n in specs}
        ).withColumns({f"__w_{n}": F.col(f"__w_{n}") / F.col(f"__s_{n}") for n in specs})
    local = {f"__l_{n}": F.sum(f"__w_{n}").over(in_block) for n in specs}
    out = out.withColumns(local)

    last_of_block = F.col("__j") == float(block - 1)
    carried = {}
    for name, (_, a) in specs.items():
        ended = F.struct(
            (F.col(f"__s_{name}") * (1.0 if gaps else 1.0 - a)).alias("d"),
            (F.col(f"__s_{name}") * F.col(f"__l_{name}")).alias("e"),
        )
        ends = F.collect_list(F.when(last_of_block, ended)).over(earlier)
        carried[f"__c_{name}"] = F.aggregate(
            ends, F.lit(0.0), lambda acc, v: acc * v["d"] + v["e"]
        )
    out = out.withColumns(carried)
    final = {}
    for name, (_, a) in specs.items():
        step = 1.0 if gaps else 1.0 - a
        y = F.col(f"__s_{name}") * (F.col(f"__c_{name}") * step + F.col(f"__l_{name}"))
        final[name] = F.when(F.col(f"__n_{name}") > 0, y)
    out = out.withColumns(final)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def span(n: int) -> float:
    return 2.0 / (n + 1)


def wilder(n: int) -> float:
    return 1.0 / n
