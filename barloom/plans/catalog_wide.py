"""Catalogue: models on all feature columns, with and without the relative block, and tree ensembles of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import trees, wide
from ..operators import cross, labels, metrics, policy, quality, splits
from ..session import materialize
from . import research as rs
from . import views as v
from .catalog_models import OOF, as_oof, full_frame, ready
from .registry import query, sql_view


def modelling_panel(spark, sf) -> tuple[DataFrame, dict[str, list[str]]]:
    """Every feature column of the frame, the relative block beside it, and the label; columns by matrix."""
    week, average = materialize(v.weekly(spark, sf), "weekly"), materialize(v.market(spark, sf), "market")
    frame = materialize(full_frame(spark, sf, week, average), "frame")
    relative = cross.relative_features(week, average).select("symbol", "date", *cross.relative_columns())
    base = [c for columns in rs.group_columns(frame.columns).values() for c in columns]
    out = labels.add_target(frame.join(relative, ["symbol", "date"], "left"), 4)
    out = out.withColumnsRenamed({"target_ret_4d": "ret", "target_up_4d": "up"})
    both = [*base, *cross.relative_columns()]
    panel = materialize(out.select("symbol", "date", "close", "ret", "up", *both), "modelling-panel")
    known = quality.column_profile(panel.select(*[F.col(c).cast("double").alias(c) for c in both]), both)
    # A column that never varies teaches nothing; at most one row for each column comes back.
    varies = {r["column"] for r in known.where("varies and filled > 0").select("column").collect()}
    return panel, {"baseline": [c for c in base if c in varies], "baseline_plus_relative": [c for c in both if c in varies]}


def by_matrix(spark, sf, kind: str, group: list[str]) -> DataFrame:
    panel, matrices = modelling_panel(spark, sf)
    folds = materialize(splits.panel_folds(panel, 4, 4, 60), "folds")
    out = None
    for name, columns in matrices.items():
        one = wide.out_of_fold(panel.select("symbol", "date", "up", *columns), folds, columns, "up", group, kind)
        one = one.select("symbol", "date", "fold", "prob", "up").withColumn("matrix", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return as_oof(out)


WIDE = "matrix, symbol, date:d, fold:i, prob:6, y:0"


@query("oof_matrices_ridge", WIDE)
def _(spark, sf):
    return by_matrix(spark, sf, "signed", [])


@query("oof_matrices_logistic", WIDE)
def _(spark, sf):
    return by_matrix(spark, sf, "logistic", [])


@query("relative_block_gain", "matrix, n:i, auc:6, brier:6, accuracy:6, gain:6")
def _(spark, sf):
    rows = materialize(by_matrix(spark, sf, "signed", []).where("fold >= 0"), "matrix-oof")
    s = metrics.scorecard(rows.withColumnRenamed("prob", "p"), ["matrix"])
    base = s.where("matrix = 'baseline'").select("auc").scalar()
    return s.withColumn("gain", F.col("auc") - base)


sql_view(
    "q_pair_rows",
    """SELECT * FROM (SELECT symbol, date, f1, d, lead(close, 4) OVER w / close - 1 AS ret, stddev_pop(f1) OVER (w ROWS 19 PRECEDING) AS vol, count(f1) OVER (w ROWS 19 PRECEDING) AS nv FROM (
  SELECT symbol, date, close, close / lag(close) OVER w - 1 AS f1, CASE WHEN count(close) OVER (w ROWS 19 PRECEDING) = 20 THEN close / avg(close) OVER (w ROWS 19 PRECEDING) - 1 END AS d FROM weekly WINDOW w AS (PARTITION BY symbol ORDER BY date))
  WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE nv = 20""",
)
sql_view(
    "q_pair_folds",
    """SELECT date, k AS fold FROM (SELECT *, n - CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS pre, (n - CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) - 60) // 4 AS sz FROM (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM q_pair_rows))), range(-1, 4) t(k)
WHERE r < CASE WHEN k < 0 THEN pre ELSE 60 + k * sz END - 4""",
)
sql_view(
    "q_pair_sums",
    """SELECT symbol, fold, count(*) AS n, avg(y) AS my, avg(f1) AS m1, avg(d) AS m2, stddev_pop(f1) AS s1, stddev_pop(d) AS s2,
  covar_pop(f1, d) AS c12, covar_pop(f1, y) AS c1y, covar_pop(d, y) AS c2y
FROM (SELECT r.symbol, f.fold, r.f1, r.d, CASE WHEN r.ret > 0 THEN 1.0::DOUBLE ELSE 0 END AS y FROM q_pair_rows r JOIN q_pair_folds f ON f.date = r.date WHERE r.ret IS NOT NULL) GROUP BY symbol, fold""",
)


@query(
    "ridge_pair_weights",
    "symbol, fold:i, n_rows:i, base:6, shift_ret1:6, shift_dist:6, slope_ret1:4, slope_dist:4",
    # Two standardised features leave a system of two equations beside the mean label; Cramer's rule solves it.
    # A feature that does not vary has no slope.
    """SELECT symbol, fold, n AS n_rows, my AS base, m1 AS shift_ret1, m2 AS shift_dist,
  coalesce((a1 * (n + 1) - a2 * r) / det / nullif(s1, 0), 0) AS slope_ret1, coalesce((a2 * (n + 1) - a1 * r) / det / nullif(s2, 0), 0) AS slope_dist
FROM (SELECT *, (n + 1.0::DOUBLE) * (n + 1) - r * r AS det FROM (SELECT *, coalesce(n * c12 / nullif(s1 * s2, 0), 0) AS r,
  coalesce(n * c1y / nullif(s1, 0), 0) AS a1, coalesce(n * c2y / nullif(s2, 0), 0) AS a2 FROM q_pair_sums))""",
)
def _(spark, sf):
    p, f = ready(spark, sf)
    rows = p.withColumn("x", wide.vector(["f_ret1", "f_dist"]))
    stats, center = wide.moments(rows, f, ["symbol"], ["f_ret1", "f_dist"], "up")
    out = wide.solve_ridge(stats, center, ["symbol", "fold"])
    parts = {f"{name}_{c}": F.element_at(name, i + 1) for name in ("shift", "slope") for i, c in enumerate(("ret1", "dist"))}
    return out.withColumns(parts)


# ---- ensembles of every symbol, fold and seed -------------------------------------------

SEEDED = "symbol, date:d, fold:i, seed:i, prob:6, y:0"
SEEDS = (0, 1, 2)


def tree_rows(spark, sf):
    panel, matrices = modelling_panel(spark, sf)
    columns = matrices["baseline"]
    folds = materialize(splits.panel_folds(panel, 4, 4, 60), "folds")
    return trees.prepare(panel.select("symbol", "date", "up", *columns), folds, ["symbol"], columns, "up"), columns


@query("oof_symbol_forests", SEEDED)
def _(spark, sf):
    rows, columns = tree_rows(spark, sf)
    nodes = trees.fit_forest(rows, ["symbol"], len(columns), SEEDS)
    return trees.score_forest(rows, nodes, ["symbol"], len(columns)).withColumnRenamed("_y", "y")


@query("oof_symbol_boosted", SEEDED)
def _(spark, sf):
    rows, columns = tree_rows(spark, sf)
    return trees.out_of_fold_boosted(rows, ["symbol"], len(columns), SEEDS[:1]).withColumnRenamed("_y", "y")


@query("oof_pooled_forest", OOF)
def _(spark, sf):
    p, f = ready(spark, sf)
    rows = trees.prepare(p, f, [], rs.FEATURES, "up")
    nodes = trees.fit_forest(rows, [], len(rs.FEATURES))
    return trees.score_forest(rows, nodes, [], len(rs.FEATURES)).withColumnRenamed("_y", "y")


@query("oof_symbol_ensemble", "symbol, date:d, fold:i, p_logistic:5, p_ridge:5, p_forest:5, p_boosted:5, prob:5, y:0")
def _(spark, sf):
    """Every model of a symbol on the same folds and columns, and their average."""
    panel, matrices = modelling_panel(spark, sf)
    columns = matrices["baseline"]
    own = panel.select("symbol", "date", "up", *columns)
    folds = materialize(splits.panel_folds(own, 4, 4, 60), "folds")
    key = ["symbol", "date", "fold"]
    out = wide.out_of_fold(own, folds, columns, "up", ["symbol"], "logistic").select(*key, F.col("up").alias("y"), F.col("prob").alias("p_logistic"))
    ridge = wide.out_of_fold(own, folds, columns, "up", ["symbol"], "signed").select(*key, F.col("prob").alias("p_ridge"))
    rows = trees.prepare(own, folds, ["symbol"], columns, "up")
    nodes = trees.fit_forest(rows, ["symbol"], len(columns))
    forest = trees.score_forest(rows, nodes, ["symbol"], len(columns)).select(*key, F.col("prob").alias("p_forest"))
    boosted = trees.out_of_fold_boosted(rows, ["symbol"], len(columns)).select(*key, F.col("prob").alias("p_boosted"))
    for part in (ridge, forest, boosted):
        out = out.join(part, key, "left")
    models = ["p_logistic", "p_ridge", "p_forest", "p_boosted"]
    return policy.uncertainty(out, models).withColumnRenamed("probability", "prob")
