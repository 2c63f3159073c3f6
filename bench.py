"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from barloom.plans import load_catalog
from barloom.plans.registry import CATALOG
from barloom.session import local_session, scratch

HEADLINE = [
    "trend_screen",
    "bars_from_trades",
    "technical_features",
    "risk_features",
    "market_relative",
    "beta",
    "alpha_factors",
    "as_of_join",
    "sentiment_features",
    "relative_features",
    "universe_relative",
    "candidate_labels",
    "scorecard_by_model",
    "roc_auc",
    "psi_drift",
    "conformal_class_quantiles",
    "selective_metrics",
    "ledger_equity",
    "strategy_metrics",
    "stock_cards",
    "fundamental_score",
    "lexicon_sentiment",
    "realised_outcomes",
    "full_feature_frame",
    "oof_pooled_ridge",
    "pooled_vs_symbol_comparison",
    "universe_benchmark",
    "symbol_forecasts",
    "stream_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("barloom-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    load_catalog()
    names = sys.argv[1:] or HEADLINE
    # One small query first, so that the JVM's start is not billed to the first headline.
    CATALOG["trade_metrics"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        with scratch(spark):
            CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
