"""Composed research plans: feature panel, pooled dataset, forecast, benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..models import calibration, grouped
from ..operators import events, joins, labels, ledger, market, metrics, policy, quality, splits, technical
from ..session import materialize

FUNDAMENTAL = {
    "pe_ratio": "fund_pe", "eps": "fund_eps", "roe": "fund_roe", "roce": "fund_roce", "debt_to_equity": "fund_de",
    "operating_margin": "fund_opm", "revenue_growth": "fund_rev_growth", "profit_growth": "fund_profit_growth",
    "fundamental_score": "fund_score",
}
OPTION = ["pcr", "total_oi", "atm_iv", "delta", "gamma", "theta", "vega", "rho"]


def point_in_time(panel: DataFrame, snapshots: DataFrame, names: dict[str, str], seq: str | None = None) -> DataFrame:
    """Snapshot metrics known on each day, under their feature names; metrics the
    snapshots do not carry add no column."""
    have = [c for c in names if c in snapshots.columns]
    out = joins.as_of(panel, snapshots, have, seq=seq)
    return out.withColumnsRenamed({c: names[c] for c in have})


def feature_frame(
    bars: DataFrame,
    market_series: DataFrame | None = None,
    vix: DataFrame | None = None,
    breadth: DataFrame | None = None,
    articles: DataFrame | None = None,
    macro: tuple[DataFrame, list[str]] | None = None,
    fundamentals: tuple[DataFrame, str | None] | None = None,
    options: DataFrame | None = None,
    sectors: DataFrame | None = None,
) -> DataFrame:
    """All feature groups in their order; a source that is not given adds no column.

    Every per-symbol group is a window on the same partitioning. The frame is written to
    the shared folder between groups: plans stay short, bars and series are computed
    once, and a lost executor repeats one group instead of all.
    """
    bars = materialize(bars, "frame-bars")
    if market_series is not None:
        market_series = materialize(market_series, "frame-market")
    out = technical.technical_features(bars)
    out = materialize(market.risk_block(out), "frame-technical")
    if market_series is not None:
        out = joins.attach_series(out, market_series, "_mkt")
        out = market.relative_block(out, "_mkt", "nifty").drop("_mkt")
        out = market.beta_block(out, market_series)
    out = market.regime_features(out, market_series, vix, breadth)
    out = materialize(market.alpha_factors(out), "frame-market-relative")
    if articles is not None:
        out = events.event_features(out, articles)
        out = events.sentiment_features(out, articles)
    if macro is not None:
        out = market.macro_features(out, *macro)
    if fundamentals is not None:
        out = point_in_time(out, fundamentals[0], FUNDAMENTAL, fundamentals[1])
    if options is not None:
        out = point_in_time(out, options, {c: f"opt_{c}" for c in OPTION})
    if sectors is not None and "sector" in out.columns:
        out = market.sector_features(out, sectors)
    return out


GROUP_PREFIXES = {
    "market": ["vol_20d", "vol_60d", "down_vol", "vol_pctile", "vol_exp", "hl_range", "gap_freq", "max_dd", "rel_"],
    "beta": ["beta", "residual_"],
    "regime": ["regime_"],
    "alpha": ["alpha_"],
    "event": ["event_"],
    "sentiment": ["sent_"],
    "macro": ["mac_"],
    "fundamental": ["fund_"],
    "options": ["opt_"],
}


def group_columns(columns: list[str]) -> dict[str, list[str]]:
    """Feature columns present, by group."""
    out = {"technical": [c for c in columns if c in technical.TECHNICAL]}
    taken = set(out["technical"])
    for name, prefixes in GROUP_PREFIXES.items():
        found = [c for c in columns if c not in taken and any(c.startswith(p) for p in prefixes)]
        taken.update(found)
        if found:
            out[name] = found
    return {k: v for k, v in out.items() if v}


def feature_manifest(spark, columns: list[str]) -> DataFrame:
    rows = [(g, i, c) for g, cs in sorted(group_columns(columns).items()) for i, c in enumerate(sorted(cs))]
    return spark.createDataFrame(rows, "feature_group string, position int, feature string")


def pooled_dataset(frames: list[DataFrame], universe: DataFrame, horizon: int = 20, as_of=None):
    """Pooled point-in-time panel and the skipped symbols with their reasons.

    Cut-off and validity come before the label, so no label reads past them; a symbol
    with repeated dates is set aside instead of failing the job.
    """
    pooled = quality.pool(frames)
    sound, bad = quality.quarantine(pooled, ["symbol", "date"])
    known = quality.as_of_cutoff(sound, as_of) if as_of is not None else sound
    inside = quality.eligible_rows(known, universe)
    skipped = quality.skipped_symbols(sound, universe, known).join(bad, "symbol", "left_anti").unionByName(bad)
    return labels.add_target(inside, horizon), skipped


def snapshots(decisions: DataFrame, features: list[str], model_version: str, feature_version: str) -> DataFrame:
    """Versioned prediction records with their features as JSON; outcome comes later."""
    return decisions.select(
        F.concat_ws("_", "symbol", F.lit(feature_version), F.date_format("date", "yyyyMMdd")).alias("prediction_id"),
        "symbol",
        F.col("date").alias("as_of"),
        F.lit(feature_version).alias("feature_version"),
        F.lit(model_version).alias("model_version"),
        F.round("p", 4).alias("probability"),
        "signal",
        F.to_json(F.struct(*features)).alias("feature_snapshot"),
        F.lit(None).cast("string").alias("actual_future_outcome"),
    )


def research_panel(bars: DataFrame, horizon: int = 4) -> DataFrame:
    """A compact modelling panel: a handful of causal features and the forward label."""
    out = bars.withColumns(
        {
            "f_ret1": w.pct_change("close", 1),
            "f_ret5": w.pct_change("close", 5),
            "f_dist": w.ratio("close", w.sma("close", 20)) - 1,
            "f_volume": w.ratio("volume", w.sma("volume", 20)),
            "f_range": w.ratio(F.col("high") - F.col("low"), "close"),
        }
    )
    out = out.withColumn("f_vol", w.roll_std("f_ret1", 20))
    out = labels.add_target(out, horizon)
    return out.withColumnsRenamed({f"target_ret_{horizon}d": "ret", f"target_up_{horizon}d": "up"}).where(
        F.col("f_vol").isNotNull()
    )


FEATURES = ["f_ret1", "f_ret5", "f_dist", "f_volume", "f_range", "f_vol"]


def forecast(panel: DataFrame, horizon: int = 4, features: list[str] | None = None, min_train: int = 80) -> DataFrame:
    """One decision per symbol, all symbols in one set of jobs.

    Walk-forward probabilities per symbol; calibration chosen and fitted on the older
    folds; the newest row scored by a model on all labelled rows; policy, conformal band,
    and the quality gate at the base rate of the newest fold.
    """
    features = features or FEATURES
    panel = materialize(panel, "forecast-panel")
    folds = splits.panel_folds(panel, horizon, 4, min_train)
    oof = grouped.out_of_fold(panel, folds, features, "up", ["symbol"], "ridge")
    oof = materialize(
        oof.select("symbol", "date", "fold", F.col("prob").alias("p"), F.col("up").alias("y"), F.unix_date("date").alias("seq")),
        "forecast-oof",
    ).where("y IS NOT NULL")
    older, newest = oof.where("fold >= 0"), oof.where("fold = -1")
    methods = materialize(calibration.select_calibrator(older, ["symbol"], ["date", "seq"]), "forecast-methods")
    scaled = grouped.standardize(panel, panel.where("up IS NOT NULL"), ["symbol"], features)
    weights = grouped.fit_ridge(scaled.where("up IS NOT NULL"), ["symbol"], features, "up")
    last = scaled.groupBy("symbol").agg(F.max_by(F.struct("date", "close", *features), "date").alias("_r"))
    last = grouped.score(last.select("symbol", "_r.*"), weights, ["symbol"], features, "ridge")
    last = last.select("symbol", "date", "close", F.col("prob").alias("p"), *features)
    calibrated = calibration.calibrate(older, last, methods, ["symbol"], "seq").withColumnRenamed("p", "raw_p")
    decided = policy.decide(calibrated.withColumnRenamed("q", "p"))
    auc = metrics.auc_of_levels(metrics.levels(oof, ["symbol"]), ["symbol"])
    base = newest.groupBy("symbol").agg(F.avg("y").alias("base_rate"))
    gated = policy.quality_gate(decided, auc, base)
    band = policy.conformal_band(older, ["symbol"])
    return policy.apply_band(gated, band, ["symbol"]).join(auc, "symbol")


def benchmark(panel: DataFrame, oof: DataFrame, horizon: int, capital: float = 100000.0) -> DataFrame:
    """Per-symbol benchmark row: discrimination, ledger, baselines and failure flags."""
    score = metrics.scorecard(oof, ["symbol"])
    signals = oof.select(
        "symbol", "date", "p", "y", "ret", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("direction")
    )
    book = ledger.strategy_metrics(panel, signals, horizon, capital)
    start = oof.groupBy("symbol").agg(F.min("date").alias("_start"))
    window = panel.join(start, "symbol").where(F.col("date") >= F.col("_start"))
    hold = ledger.buy_and_hold(window, horizon, capital).select("symbol", F.col("cum_return").alias("buy_hold_return"))
    always = ledger.strategy_metrics(
        panel, signals.select("symbol", "date", F.lit(1.0).alias("direction")), horizon, capital
    ).select("symbol", F.col("cum_return").alias("always_up_return"))
    out = score.select(
        "symbol", "n", "auc", "accuracy", "positive_rate", "brier", "ece", "distinct_levels", "near_005"
    ).join(
        book.select("symbol", "cum_return", "profit_factor", "n_trades", "max_dd", "sharpe", "no_leverage_ok"), "symbol", "left"
    )
    out = out.join(hold, "symbol", "left").join(always, "symbol", "left")
    auc = F.col("auc")
    return out.withColumns(
        {
            "edge": F.col("accuracy") - F.greatest("positive_rate", 1 - F.col("positive_rate")),
            "collapse_flag": metrics.collapse_flag(),
            "auc_bucket": F.when(auc <= 0.5, "chance_or_worse").when(auc < 0.55, "weak").when(auc.isNotNull(), "useful"),
            "flag_profit_factor_lt_1": F.coalesce(F.col("profit_factor") < 1, F.lit(False)),
            "flag_negative_cum_return": F.coalesce(F.col("cum_return") < 0, F.lit(False)),
            "flag_few_trades": F.coalesce("n_trades", F.lit(0)) < 5,
        }
    )


