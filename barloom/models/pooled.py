"""Pooled models on ``pyspark.ml``: feature matrices, fold fits, explanations."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics
from ..session import materialize
from .grouped import sigmoid

MODELS = ("logistic", "ridge", "rf", "gbt")
# Forest and boosting sizes of the per-fold models.
FOREST = {"numTrees": 50, "maxDepth": 8, "minInstancesPerNode": 30}
BOOST = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8}


def feature_stages(features: list[str], symbol: str | None = None) -> list:
    """Median imputation, optional one-hot symbol and one vector column."""
    filled = [f"{f}__x" for f in features]
    stages = [Imputer(strategy="median", relativeError=0.0001, inputCols=features, outputCols=filled)]
    parts = list(filled)
    if symbol:
        stages += [
            StringIndexer(inputCol=symbol, outputCol="symbol__i", stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCol="symbol__i", outputCol="symbol__v", dropLast=False),
        ]
        parts.append("symbol__v")
    return stages + [VectorAssembler(inputCols=parts, outputCol="raw_features", handleInvalid="keep")]


def estimator(model: str, label: str, seed: int, n: int, sizes: dict | None = None):
    s = sizes or {}
    if model == "logistic":
        return LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w", regParam=1.0 / max(n, 1), maxIter=s.get("maxIter", 50))
    if model == "ridge":
        return LinearRegression(featuresCol="features", labelCol="_sign", weightCol="_w", regParam=1.0 / max(n, 1), solver="normal", predictionCol="score")
    if model == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w", seed=seed, **(FOREST | s))
    if model == "gbt":
        return GBTClassifier(featuresCol="features", labelCol=label, weightCol="_w", seed=seed, **(BOOST | s))
    raise ValueError(f"unknown model: {model}")


def fit(train: DataFrame, features: list[str], label: str, model: str, seed: int = 0, sizes: dict | None = None, symbol: str | None = None):
    """Fit one model on all training rows; ``None`` and the prior if one class is absent."""
    rows = _weigh(train, label)
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("prior")).first()
    if head["n"] == 0:
        return None, 0.5
    if head["prior"] in (0.0, 1.0):
        return None, float(head["prior"])
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    stages = [*feature_stages(features, symbol), scaler, estimator(model, label, seed, head["n"], sizes)]
    return Pipeline(stages=stages).fit(rows), float(head["prior"])


def _weigh(train: DataFrame, label: str) -> DataFrame:
    known = train.where(F.col(label).isNotNull())
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    n, p = sizes.select("n").scalar(), sizes.select("p").scalar()
    each = F.when(F.col(label) == 1, F.try_divide(n, 2 * p)).otherwise(F.try_divide(n, 2 * (n - p)))
    return known.withColumns({"_w": F.coalesce(each, F.lit(1.0)), "_sign": 2.0 * F.col(label) - 1.0})


def predict(model: PipelineModel | None, rows: DataFrame, prior: float) -> DataFrame:
    """Rows with P(up) in ``prob``."""
    if model is None:
        return rows.withColumn("prob", F.lit(prior))
    out = model.transform(rows)
    if "score" in out.columns:
        p = sigmoid(F.col("score"))
    else:
        p = vector_to_array("probability")[1]
    return out.withColumn("prob", p).select(*rows.columns, "prob")


def out_of_fold(
    panel: DataFrame, folds: DataFrame, features: list[str], label: str, models=("logistic",), seeds=(0,),
    fold_ids=None, sizes: dict | None = None, symbol: str | None = None,
) -> DataFrame:
    """Predictions of every (fold, seed, model); one distributed fit each. All folds of the table unless listed."""
    from ..operators.splits import assign

    rows = materialize(assign(panel, folds), "pooled-rows")
    out = None
    if fold_ids is None:
        fold_ids = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    for fold in fold_ids:
        part = rows.where(F.col("fold") == fold)
        for name in models:
            for seed in seeds:
                fitted, prior = fit(part.where("role = 'train'"), features, label, name, seed, sizes, symbol)
                one = predict(fitted, part.where("role = 'test'"), prior).withColumns(
                    {"model": F.lit(name), "seed": F.lit(seed)}
                )
                out = one if out is None else out.unionByName(one)
    return out


def positions(df: DataFrame, name: str, seed: int, buckets: int = 1024) -> DataFrame:
    """Number rows in a random but repeatable order, bucket by bucket.

    The order is a hash; offsets come from bucket counts, so no task sorts all rows.
    """
    h = F.xxhash64(F.lit(seed), *df.columns)
    out = df.withColumns({"_h": h, "_hb": F.pmod(h, F.lit(buckets))})
    sizes = out.groupBy("_hb").agg(F.count(F.lit(1)).alias("_c")).withColumn("_one", F.lit(1))
    before = F.coalesce(
        F.sum("_c").over(Window.partitionBy("_one").orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select("_hb", before.alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_hb").orderBy("_h", *df.columns))
    return out.join(offsets, "_hb").withColumn(name, F.col("_off") + inside).drop("_h", "_hb", "_off")


def permuted(df: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Each row with another random row's ``columns`` as ``<column>__p``."""
    left = positions(df, "_pos", seed)
    donors = positions(df, "_pos", seed + 1_000_003).select("_pos", *[F.col(c).alias(f"{c}__p") for c in columns])
    return left.join(donors, "_pos").drop("_pos")


def permutation_importance(
    model: PipelineModel, rows: DataFrame, features: list[str], label: str, repeats: int = 3, seed: int = 0
) -> DataFrame:
    """Mean loss of AUC when one feature takes a random row's value.

    One shuffled join per repeat serves every feature, and one scoring pass covers all.
    """
    keep = rows.where(F.col(label).isNotNull()).select(*features, label)
    keep = materialize(keep, "importance-rows")
    parts = None
    names = F.array(F.lit("__base__"), *[F.lit(f) for f in features])
    for k in range(repeats):
        mixed = permuted(keep, features, seed + k).withColumn("feature", F.explode(names))
        swapped = {f: F.when(F.col("feature") == f, F.col(f"{f}__p")).otherwise(F.col(f)) for f in features}
        one = mixed.withColumns(swapped).select(*features, label, "feature", F.lit(k).alias("repeat"))
        parts = one if parts is None else parts.unionByName(one)
    scored = predict(model, parts, 0.5)
    auc = metrics.auc_of_levels(metrics.levels(scored, ["feature", "repeat"], "prob", label), ["feature", "repeat"])
    base = auc.where("feature = '__base__'").select("repeat", F.col("auc").alias("_base"))
    return (
        auc.where("feature <> '__base__'")
        .join(base, "repeat")
        .groupBy("feature")
        .agg(F.avg(F.col("_base") - F.col("auc")).alias("importance"))
    )


def local_sensitivity(
    model: PipelineModel, train: DataFrame, latest: DataFrame, features: list[str], k: int = 8, delta: float = 0.15
) -> DataFrame:
    """Half the change of P(up) for a step of 0.15 training deviations up and down, the
    ``k`` largest per symbol."""
    spread = train.agg(*[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f) for f in features])
    steps = {f: spread.select(f).scalar() for f in features}
    grid = F.array(
        *[F.struct(F.lit(f).alias("factor"), F.lit(float(s)).alias("side")) for f in features for s in (1, -1)]
    )
    probe = latest.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")
    moved = {
        f: F.col(f) + F.when(F.col("factor") == f, F.col("side") * delta * steps[f]).otherwise(0.0) for f in features
    }
    scored = predict(model, probe.withColumns(moved), 0.5)
    impact = F.sum(F.col("side") * F.col("prob")) / 2
    out = scored.groupBy("symbol", "factor").agg(impact.alias("impact"))
    by = Window.partitionBy("symbol").orderBy(F.desc(F.abs("impact")), "factor")
    return (
        out.withColumns(
            {"rank": F.row_number().over(by), "direction": F.when(F.col("impact") >= 0, "positive").otherwise("negative")}
        )
        .where(F.col("rank") <= k)
    )


def signed_factors(impacts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest positive and negative factors per symbol."""
    out = impacts.where("impact <> 0").withColumn("sign", F.when(F.col("impact") > 0, "positive").otherwise("negative"))
    by = Window.partitionBy("symbol", "sign").orderBy(F.desc(F.abs("impact")), "factor")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def tree_gains(models: list[PipelineModel], features: list[str], spark, top: int = 15) -> DataFrame:
    """Split gains summed over folds as shares, the largest first (one value per feature)."""
    total = [0.0] * len(features)
    for m in models:
        for i, g in enumerate(m.stages[-1].featureImportances.toArray()[: len(features)]):
            total[i] += float(g)
    table = spark.createDataFrame(list(zip(features, total)), "feature string, gain double")
    share = F.try_divide(F.col("gain"), F.sum("gain").over(Window.partitionBy(F.lit(1))))
    by = Window.partitionBy(F.lit(1)).orderBy(F.desc("gain"), "feature")
    return table.withColumns({"share": share, "rank": F.row_number().over(by)}).where(F.col("rank") <= top)


def regressor(model: str, label: str, seed: int = 17, sizes: dict | None = None):
    s = sizes or {}
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "pred"}
    if model == "ridge":
        return LinearRegression(regParam=1e-3, solver="normal", **common)
    if model == "rf":
        return RandomForestRegressor(seed=seed, **({"numTrees": 200, "maxDepth": 6} | s), **common)
    if model == "gbt":
        return GBTRegressor(seed=seed, **({"maxIter": 200, "maxDepth": 3} | s), **common)
    raise ValueError(f"unknown regressor: {model}")


def predict_return(train: DataFrame, test: DataFrame, features: list[str], label: str, model: str, seed: int = 17, sizes: dict | None = None) -> DataFrame:
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    stages = [*feature_stages(features), scaler, regressor(model, label, seed, sizes)]
    fitted = Pipeline(stages=stages).fit(train.where(F.col(label).isNotNull()))
    return fitted.transform(test).select(*test.columns, "pred")


def two_stage_return(train: DataFrame, test: DataFrame, features: list[str], ret: str, up: str, seed: int = 17) -> DataFrame:
    """P(up) times the return expected when up."""
    direction, prior = fit(train, features, up, "logistic", seed)
    out = predict(direction, test, prior)
    rising = train.where(F.col(up) == 1)
    out = predict_return(rising, out, features, ret, "ridge", seed)
    return out.withColumn("pred", F.col("prob") * F.col("pred"))


def null_return(train: DataFrame, test: DataFrame, ret: str) -> DataFrame:
    """Training mean as the forecast of every test row."""
    mean = train.agg(F.avg(ret).alias("m")).scalar()
    return test.withColumn("pred", mean)
