"""Catalogue: splits, models, calibration, explanations and composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking
from ..models import calibration, grouped, pooled, trees, wide
from ..operators import events, labels, ledger, market, metrics, policy, quality, splits
from ..session import materialize
from . import research as rs
from . import views as v
from .catalog_cross import arrivals, spots_of
from .catalog_market import sector_closes
from .registry import query, sql_view

# ---- splits --------------------------------------------------------------------------

sql_view("q_dates", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)")
FOLD = "fold:i, role, n:i, first:d, last:d"


def fold_summary(folds):
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )


def q_folds(rows):
    return f"""SELECT fold, role, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT fold, date, CASE WHEN r >= s AND r < e THEN 'test' WHEN r < s - g THEN 'train' WHEN r < s THEN 'purge' END AS role
FROM ({rows})) WHERE role IS NOT NULL GROUP BY 1, 2"""


@query(
    "chronological_split",
    "role, n:i, first:d, last:d",
    """SELECT CASE WHEN date <= DATE '1999-01-01' THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(date) AS first, max(date) AS last FROM bars WHERE date <= DATE '2000-06-30' GROUP BY 1""",
)
def _(spark, sf):
    out = splits.chronological(v.bars(spark, sf), "1999-01-01", "2000-06-30")
    return out.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "walk_forward_folds",
    FOLD,
    q_folds("SELECT *, 260 + k * 90 AS s, 260 + k * 90 + 40 AS e, 0 AS g, k AS fold FROM q_dates, range(0, 200) t(k) WHERE 260 + k * 90 + 40 <= n"),
)
def _(spark, sf):
    return fold_summary(splits.walk_forward(v.bars(spark, sf), 40, 90, 260))


@query(
    "purged_folds",
    FOLD,
    q_folds("SELECT *, 15 + k * 90 AS s, 15 + k * 90 + 40 AS e, CASE WHEN 15 + k * 90 > 20 THEN 20 ELSE 0 END AS g, k AS fold FROM q_dates, range(0, 200) t(k) WHERE 15 + k * 90 + 40 <= n"),
)
def _(spark, sf):
    return fold_summary(splits.walk_forward(v.bars(spark, sf), 40, 90, 15, 20))


@query(
    "purged_chrono_folds",
    FOLD,
    q_folds("SELECT *, round_even(n * k / 5.0::DOUBLE, 0) AS s, n AS e, 20 AS g, k AS fold FROM q_dates, range(1, 6) t(k) WHERE round_even(n * k / 5.0::DOUBLE, 0) < n"),
)
def _(spark, sf):
    return fold_summary(splits.chrono_folds(v.bars(spark, sf)))


@query(
    "panel_folds_with_holdout",
    FOLD,
    q_folds("""SELECT *, CASE WHEN k < 0 THEN pre ELSE 60 + k * sz END AS s, CASE WHEN k < 0 THEN n ELSE least(60 + (k + 1) * sz, pre) END AS e, 20 AS g, k AS fold FROM (
  SELECT *, n - CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS pre, (n - CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) - 60) // 4 AS sz FROM q_dates), range(-1, 4) t(k)"""),
)
def _(spark, sf):
    return fold_summary(splits.panel_folds(v.bars(spark, sf)))


@query(
    "fold_assignment",
    "fold:i, role, rows:i",
    """SELECT fold, role, count(*) AS rows FROM bars b JOIN (SELECT fold, date, CASE WHEN r >= s AND r < e THEN 'test' WHEN r < s - 20 THEN 'train' END AS role FROM (
  SELECT *, 260 + k * 90 AS s, 300 + k * 90 AS e, k AS fold FROM q_dates, range(0, 200) t(k) WHERE 300 + k * 90 <= n)) f ON f.date = b.date WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    panel = v.bars(spark, sf)
    out = splits.assign(panel, splits.walk_forward(panel, 40, 90, 260, 20))
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"))


# ---- models --------------------------------------------------------------------------

OOF = "symbol, date:d, fold:i, prob:6, y:0"


def panel(spark, sf):
    return rs.research_panel(v.weekly(spark, sf))


def ready(spark, sf):
    p = materialize(panel(spark, sf), "panel")
    return p, splits.panel_folds(p, 4, 4, 60)


def as_oof(df):
    return df.withColumn("y", F.col("up"))


@query("oof_pooled_ridge", OOF)
def _(spark, sf):
    p, f = ready(spark, sf)
    return as_oof(grouped.out_of_fold(p, f, rs.FEATURES, "up", [], "ridge"))


@query("oof_per_symbol_logistic", OOF)
def _(spark, sf):
    p, f = ready(spark, sf)
    return as_oof(grouped.out_of_fold(p, f, rs.FEATURES, "up", ["symbol"], "logistic"))


@query("leave_one_symbol_out", OOF)
def _(spark, sf):
    p, f = ready(spark, sf)
    return as_oof(grouped.leave_one_symbol_out(p, f, rs.FEATURES, "up"))


@query("oof_pooled_models", "symbol, date:d, fold:i, model, seed:i, prob:6, y:0")
def _(spark, sf):
    p, f = ready(spark, sf)
    out = pooled.out_of_fold(p, f, rs.FEATURES, "up", ("logistic",), symbol="symbol")
    forest = pooled.out_of_fold(p, f, rs.FEATURES, "up", ("rf",))
    return as_oof(out.unionByName(forest))


@query("boosted_trees_fold", "symbol, date:d, fold:i, prob:6, y:0")
def _(spark, sf):
    p, f = ready(spark, sf)
    rows = trees.prepare(p, f, ["symbol"], rs.FEATURES, "up")
    return trees.out_of_fold_boosted(rows, ["symbol"], len(rs.FEATURES)).withColumnRenamed("_y", "y")


@query(
    "feature_matrix",
    "symbol, n:i, width:i",
    """SELECT symbol, count(*) AS n, 6 + (SELECT count(DISTINCT symbol) FROM weekly) + 1 AS width FROM (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM weekly) WHERE k > 20 GROUP BY symbol""",
)
def _(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    p = panel(spark, sf)
    out = Pipeline(stages=pooled.feature_stages(rs.FEATURES, "symbol")).fit(p).transform(p)
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array("raw_features"))).alias("width")
    )


@query("tree_feature_gains", "feature, rank:i, share:4")
def _(spark, sf):
    p, f = ready(spark, sf)
    rows = trees.prepare(p, f, [], rs.FEATURES, "up")
    return trees.gain_shares(trees.fit_forest(rows, [], len(rs.FEATURES)), rs.FEATURES)


@query("permutation_importance", "feature, importance:6")
def _(spark, sf):
    p, f = ready(spark, sf)
    rows = splits.assign(p, f)
    out = None
    for fold in sorted(r["fold"] for r in f.select("fold").distinct().collect()):
        own = rows.where(F.col("fold") == fold)
        model, _ = pooled.fit(own.where("role = 'train'"), rs.FEATURES, "up", "logistic")
        if model is not None:
            one = pooled.permutation_importance(model, own.where("role = 'test'"), rs.FEATURES, "up")
            out = one if out is None else out.unionByName(one)
    return out.groupBy("feature").agg(F.avg("importance").alias("importance"))


@query("local_sensitivity", "symbol, factor, rank:i, impact:6, direction")
def _(spark, sf):
    p, _f = ready(spark, sf)
    model, _ = pooled.fit(p, rs.FEATURES, "up", "logistic")
    last = p.groupBy("symbol").agg(F.max_by(F.struct(*rs.FEATURES), "date").alias("r")).select("symbol", "r.*")
    return pooled.local_sensitivity(model, p, last, rs.FEATURES)


@query("signed_factors", "symbol, sign, rank:i, factor, impact:6")
def _(spark, sf):
    p, _f = ready(spark, sf)
    model, _ = pooled.fit(p, rs.FEATURES, "up", "logistic")
    last = p.groupBy("symbol").agg(F.max_by(F.struct(*rs.FEATURES), "date").alias("r")).select("symbol", "r.*")
    return pooled.signed_factors(pooled.local_sensitivity(model, p, last, rs.FEATURES, k=len(rs.FEATURES)))


@query("group_ablation", "variant, n:i, auc:6, delta:6")
def _(spark, sf):
    p, f = ready(spark, sf)
    groups = {"returns": ["f_ret1", "f_ret5"], "trend": ["f_dist"], "volume": ["f_volume"], "risk": ["f_range", "f_vol"]}
    rows = as_oof(grouped.ablation(p, f.where("fold >= 0"), groups, "up"))
    s = metrics.scorecard(rows.withColumnRenamed("prob", "p"), ["variant"])
    full = s.where("variant = 'full'").select("auc").scalar()
    return s.withColumn("delta", F.col("auc") - full)


@query("penalty_sweep", "penalty:2, median_auc:6, best:b")
def _(spark, sf):
    p, f = ready(spark, sf)
    rows = as_oof(grouped.penalty_sweep(p, f.where("fold >= 0"), rs.FEATURES, "up", [0.1, 1.0, 10.0, 100.0]))
    s = metrics.scorecard(rows.withColumnRenamed("prob", "p"), ["penalty", "symbol"])
    m = ranking.median(s, ["penalty"], "auc", "median_auc")
    top = m.agg(F.max("median_auc")).scalar()
    # Adopted only above a fixed bar.
    return m.withColumn("best", (F.col("median_auc") == top) & (F.col("median_auc") >= 0.55))


@query("target_research", "label, n:i, auc:6, brier:6, accuracy:6")
def _(spark, sf):
    p = labels.candidate_labels(labels.past_volatility(panel(spark, sf)), "ret")
    p = materialize(p, "targets")
    f = splits.panel_folds(p, 4, 4, 60).where("fold >= 0")
    up = [c for c in labels.LABELS if c not in ("label_three", "label_vol_three")]
    three = [F.when(F.col(c) == 1, 1).when(F.col(c).isNotNull(), 0).alias(f"{c}_up") for c in ("label_three", "label_vol_three")]
    long = p.select("symbol", "date", *rs.FEATURES, *up, *three).unpivot(
        ["symbol", "date", *rs.FEATURES], [*up, "label_three_up", "label_vol_three_up"], "label", "y"
    )
    rows = grouped.out_of_fold(long, f, rs.FEATURES, "y", ["label"], "ridge")
    return metrics.scorecard(rows.withColumnRenamed("prob", "p"), ["label"])


@query("return_risk_models", "model, n:i, rmse:6, mae:6, bias:6, corr:6, mad:6")
def _(spark, sf):
    p, f = ready(spark, sf)
    rows = materialize(splits.assign(p, f), "return-rows")
    known = rows.where("role = 'train'").groupBy("fold").agg(F.avg("ret").alias("_mean"), F.avg(F.when(F.col("up") == 1, F.col("ret"))).alias("_rise"))
    keep = ["symbol", "date", "fold", "ret"]
    parts = {"ridge": wide.out_of_fold(p, f, rs.FEATURES, "ret", [], "plain").select(*keep, F.col("prob").alias("pred"))}
    up = grouped.out_of_fold(p, f, rs.FEATURES, "up", [], "logistic").select(*keep, "prob").join(known, "fold")
    parts["two_stage"] = up.select(*keep, (F.col("prob") * F.coalesce("_rise", F.lit(0.0))).alias("pred"))
    parts["null"] = rows.where("role = 'test'").join(known, "fold").select(*keep, F.col("_mean").alias("pred"))
    for fold in sorted(r["fold"] for r in f.select("fold").distinct().collect()):
        own = rows.where(F.col("fold") == fold)
        one = pooled.predict_return(own.where("role = 'train'"), own.where("role = 'test'"), rs.FEATURES, "ret", "rf").select(*keep, "pred")
        parts["forest"] = one if "forest" not in parts else parts["forest"].unionByName(one)
    out = None
    for name, df in parts.items():
        one = df.where("ret is not null").select(F.lit(name).alias("model"), "symbol", F.col("ret").alias("y"), "pred")
        out = one if out is None else out.unionByName(one)
    return metrics.residual_risk(materialize(out, "returns"), ["model"], "y", "pred")


@query("return_risk_verdict", "best:6, null_rmse:6, good:4, cv:4, interpretation, verdict")
def _(spark, sf):
    p, f = ready(spark, sf)
    rows = grouped.out_of_fold(p, f, rs.FEATURES, "ret", [], "plain")
    # The null forecast knows its fold's training rows only.
    known = splits.assign(p, f).where("role = 'train'").groupBy("fold").agg(F.avg("ret").alias("null_pred"))
    rows = materialize(rows.where("ret IS NOT NULL").withColumn("pred", F.col("prob")).join(known, "fold"), "verdict")
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("ret") - F.col(c), 2))).alias("rmse")
    err = rows.select(F.greatest(F.lit(0.01), F.least(F.lit(0.99), 0.5 + F.col("pred"))).alias("p"), (F.col("ret") - F.col("pred")).alias("error"))
    return policy.return_risk_verdict(
        rows.agg(rmse("pred")), rows.groupBy("symbol").agg(rmse("pred")), rows.groupBy("fold").agg(rmse("pred")),
        rows.agg(rmse("null_pred")), metrics.entropy_interaction(err),
    )


@query("shuffled_target_control", "auc:6, n:i")
def _(spark, sf):
    p = v.preds(spark, sf).select("id", "p", "y")
    mixed = pooled.permuted(p, ["y"], 17)
    return metrics.scorecard(mixed.select("p", F.col("y__p").alias("y")), [])


# ---- calibration ---------------------------------------------------------------------


def calib_rows(spark, sf):
    # A skewed probability, so that calibration has something to correct.
    return v.preds(spark, sf).select("symbol", "date", "id", F.pow("p", 2).alias("p"), "y", "fold")


@query("platt_calibration", "symbol, a:4, b:4, n_out:i, low:4, high:4")
def _(spark, sf):
    rows = calib_rows(spark, sf)
    params = materialize(calibration.fit_platt(rows, ["symbol"]), "platt")
    out = calibration.apply_platt(rows, params, ["symbol"])
    s = out.groupBy("symbol").agg(F.count("platt").alias("n_out"), F.min("platt").alias("low"), F.max("platt").alias("high"))
    return params.join(s, "symbol")


@query(
    "isotonic_levels",
    "symbol, total:0, weighted:3, lowest:6, highest:6",
    """SELECT symbol, CAST(count(*) AS DOUBLE) AS total, CAST(sum(y) AS DOUBLE) AS weighted,
  (SELECT min(m) FROM (SELECT avg(y) OVER (ORDER BY p, id) AS m FROM preds q WHERE q.symbol = p0.symbol)) AS lowest,
  (SELECT max(m) FROM (SELECT avg(y) OVER (ORDER BY p DESC, id DESC) AS m FROM preds q WHERE q.symbol = p0.symbol)) AS highest FROM preds p0 GROUP BY symbol""",
)
def _(spark, sf):
    # The first level of an isotonic fit is the smallest prefix mean, the last the largest
    # suffix mean, and levels weighted by their rows add up to all positives.
    steps = calibration.fit_isotonic(calib_rows(spark, sf), ["symbol"], seq="id")
    return steps.groupBy("symbol").agg(
        F.sum("w").alias("total"),
        F.sum(F.col("w") * F.col("value")).alias("weighted"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


@query("calibrator_selection", "symbol, n:i, n_select:i, levels:i, brier_platt:5, brier_isotonic:5, brier_se:6, method")
def _(spark, sf):
    return calibration.select_calibrator(calib_rows(spark, sf), ["symbol"], ["date", "id"])


@query("calibration_sensitivity", "symbol, n:i, n_levels:i, near_002:4, near_005:4, n_crossing:i")
def _(spark, sf):
    rows = materialize(calib_rows(spark, sf), "calibration")
    fit, hold = rows.where("fold < 3"), rows.where("fold = 3")
    methods = fit.select("symbol").distinct().withColumn("method", F.lit("isotonic"))
    return calibration.sensitivity(calibration.calibrate(fit, hold, methods, ["symbol"], "id"), ["symbol"])


@query(
    "oof_audit",
    "symbol, n:i, reported:6, recomputed:6, matches:b",
    """SELECT symbol, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS reported, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS recomputed, true AS matches FROM preds WHERE fold = 3 GROUP BY symbol""",
)
def _(spark, sf):
    hold = v.preds(spark, sf).where("fold = 3")
    reported = metrics.scorecard(hold, ["symbol"]).select("symbol", F.col("accuracy").alias("reported"))
    again = metrics.accuracy_vs_constant(hold, ["symbol"]).select("symbol", "n", F.col("accuracy").alias("recomputed"))
    return reported.join(again, "symbol").withColumn("matches", F.abs(F.col("reported") - F.col("recomputed")) < 1e-9)


# ---- composed plans ------------------------------------------------------------------


def full_frame(spark, sf, week=None, average=None):
    """All features; the weekly bars and the market are written once, as each of their readers would go over all trades."""
    week = materialize(v.weekly(spark, sf), "weekly") if week is None else week
    average = materialize(v.market(spark, sf), "market") if average is None else average
    chain = events.chain_metrics(v.chains(spark, sf), spots_of(week), 30).withColumn(
        "available_at", F.add_months("as_of", 1)
    )
    snaps = v.snaps(spark, sf).withColumn("symbol", F.concat(F.lit("Brand#"), (F.col("seq") % 25).cast("string")))
    return rs.feature_frame(
        week, average, v.volx(spark, sf, average), market.breadth(week),
        arrivals(spark, sf), (v.series(spark, sf), ["demand", "supply"]), (snaps, "seq"), chain, sector_closes(week),
    )


@query("full_feature_frame", "symbol, rows:i, n_columns:i, beta_rows:i, fund_rows:i, opt_rows:i, macro_rows:i")
def _(spark, sf):
    frame = full_frame(spark, sf)
    return frame.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(frame.columns)).alias("n_columns"),
        F.count("beta").alias("beta_rows"),
        F.count("fund_pe").alias("fund_rows"),
        F.count("opt_atm_iv").alias("opt_rows"),
        F.count("mac_demand_ret_20d").alias("macro_rows"),
    )


@query("feature_catalog", "feature_group, position:i, feature, filled:i")
def _(spark, sf):
    frame = full_frame(spark, sf)
    known = quality.column_profile(frame, [c for g in rs.group_columns(frame.columns).values() for c in g])
    return rs.feature_manifest(spark, frame.columns).join(
        known.select(F.col("column").alias("feature"), "filled"), "feature"
    )


_W = """w.symbol AND (u.valid_from IS NULL OR w.date >= u.valid_from) AND (u.valid_to IS NULL OR w.date <= u.valid_to) AND u.inclusion_status <> 'excluded'"""


@query(
    "pooled_dataset",
    "symbol, date:d, close:6, target_ret_20d:6, target_up_20d:0",
    f"""SELECT symbol, date, close, r AS target_ret_20d, CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS INTEGER) END AS target_up_20d FROM (
  SELECT w.symbol, w.date, w.close, lead(w.close, 20) OVER (PARTITION BY w.symbol ORDER BY w.date) / w.close - 1 AS r FROM weekly w JOIN universe u ON u.symbol = {_W} WHERE w.date <= DATE '2000-12-31')""",
)
def _(spark, sf):
    return rs.pooled_dataset([v.weekly(spark, sf)], v.universe(spark, sf), 20, "2000-12-31")[0]


_IN = "(valid_from IS NULL OR date >= valid_from) AND (valid_to IS NULL OR date <= valid_to)"


@query(
    "pooled_dataset_skipped",
    "symbol, reason",
    f"""SELECT DISTINCT symbol, 'not in universe manifest' AS reason FROM weekly WHERE symbol NOT IN (SELECT symbol FROM universe)
UNION ALL SELECT symbol, exclusion_reason FROM universe WHERE inclusion_status = 'excluded' AND symbol IN (SELECT symbol FROM weekly)
UNION ALL SELECT symbol, 'no rows inside point-in-time universe window' FROM universe u WHERE inclusion_status <> 'excluded'
  AND NOT EXISTS (SELECT 1 FROM weekly w WHERE w.symbol = u.symbol AND date <= DATE '2000-12-31' AND {_IN})""",
)
def _(spark, sf):
    return rs.pooled_dataset([v.weekly(spark, sf)], v.universe(spark, sf), 20, "2000-12-31")[1]


@query("symbol_forecasts", "symbol, date:d, close:4, raw_p:6, p:6, signal, direction:i, method, lower:4, upper:4, auc:6, gated:b")
def _(spark, sf):
    return rs.forecast(panel(spark, sf))


@query("prediction_snapshots", "prediction_id, symbol, as_of:d, probability:4, signal, feature_snapshot")
def _(spark, sf):
    return rs.snapshots(rs.forecast(panel(spark, sf)), rs.FEATURES, "model-v1", "features-v1")


def oof_for_benchmark(spark, sf):
    p, f = ready(spark, sf)
    rows = grouped.out_of_fold(p, f.where("fold >= 0"), rs.FEATURES, "up", [], "ridge")
    rows = rows.select("symbol", "date", F.col("prob").alias("p"), F.col("up").alias("y"), "ret", "fold")
    return p, materialize(rows, "benchmark-oof")


@query("universe_benchmark", "symbol, n:i, auc:6, accuracy:6, edge:6, cum_return:6, buy_hold_return:6, always_up_return:6, profit_factor:4, n_trades:i, auc_bucket, collapse_flag:b, flag_few_trades:b")
def _(spark, sf):
    p, rows = oof_for_benchmark(spark, sf)
    return rs.benchmark(p, rows.where("y IS NOT NULL"), 4)


@query("model_backtest", "model, symbol, n_days:i, n_trades:i, cum_return:6, max_dd:6, sharpe:4")
def _(spark, sf):
    p, rows = oof_for_benchmark(spark, sf)
    d = F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)
    both = rows.select("symbol", "date", F.lit("ridge").alias("model"), d.alias("direction")).unionByName(
        rows.select("symbol", "date", F.lit("always_up").alias("model"), F.lit(1.0).alias("direction"))
    )
    return ledger.strategy_metrics(p, both, 4, 100000.0, ("symbol", "model"))


@query("pooled_vs_symbol_comparison", "median_delta:6, wins:i, losses:i, ties:i, n_symbols:i, fold_win_ratio:6, verdict")
def _(spark, sf):
    from ..functions.tables import one_row

    p, f = ready(spark, sf)
    f = f.where("fold >= 0")
    own = grouped.out_of_fold(p, f, rs.FEATURES, "up", ["symbol"], "ridge").select("symbol", "date", "fold", "prob", F.col("up").alias("y"))
    pool = grouped.out_of_fold(p, f, rs.FEATURES, "up", [], "ridge").select("symbol", "date", F.col("prob").alias("q"))
    rows = materialize(own.join(pool, ["symbol", "date"]).where("y IS NOT NULL"), "matched")
    d = metrics.auc_deltas(rows, ["symbol"], "q", "prob")
    folds = metrics.auc_deltas(rows, ["fold"], "q", "prob")
    # Ridge draws nothing at random, so the seeds' gate sees one seed, which is never enough.
    seeds = metrics.auc_deltas(rows.withColumn("seed", F.lit(0)), ["seed"], "q", "prob")
    row = one_row(ranking.median(d, [], "delta", "median_delta"), metrics.win_loss(d), metrics.robustness(folds, seeds))
    return policy.pooled_verdict(row)
