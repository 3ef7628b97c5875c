"""Regressors on panels by MLlib, fitted on the past only."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import new_path

SEED = 42


def estimator(kind: str, **params):
    """A regressor by name with a fixed seed."""
    if kind == "gbt":
        return GBTRegressor(seed=SEED, maxIter=params.pop("maxIter", 10), maxDepth=params.pop("maxDepth", 3), **params)
    if kind == "forest":
        return RandomForestRegressor(seed=SEED, numTrees=params.pop("numTrees", 20), maxDepth=params.pop("maxDepth", 4), **params)
    return LinearRegression(regParam=params.pop("regParam", 0.01), elasticNetParam=0.0, **params)


def fitted(train: DataFrame, features: list[str], label: str, kind: str, **params) -> PipelineModel:
    """Rows with an unknown feature or label do not train."""
    steps = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), estimator(kind, **params).setLabelCol(label)]
    return Pipeline(stages=steps).fit(train.where(F.col(label).isNotNull()))


def tune(fit: DataFrame, check: DataFrame, features: list[str], label: str, kind: str, grid: list[dict]) -> tuple[dict, float]:
    """The settings of least error on `check`. Settings that a learner refuses are passed over with a warning; other errors are raised."""
    best = None
    for params in grid:
        try:
            error = RegressionEvaluator(labelCol=label).evaluate(fitted(fit, features, label, kind, **dict(params)).transform(check))
        except (IllegalArgumentException, TypeError) as e:
            warnings.warn(f"{kind} {params}: {e}", stacklevel=2)
            continue
        if best is None or error < best[1]:
            best = (params, error)
    if best is None:
        raise ValueError("no settings could be fitted")
    return best


def attribution(model: PipelineModel, features: list[str]) -> dict[str, float]:
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return dict(zip(features, map(float, weights.toArray()), strict=True))


def ensemble_scores(train: DataFrame, rows: DataFrame, features: list[str], label: str, kinds: tuple[str, ...] = ("linear", "forest")) -> DataFrame:
    """symbol, session, score (mean of the members), rank within session."""
    out = rows.drop("features", "prediction")
    for kind in kinds:
        out = fitted(train, features, label, kind).transform(out.drop("features")).withColumnRenamed("prediction", f"p_{kind}")
    mean = reduce(lambda a, b: a + b, [F.col(f"p_{k}") for k in kinds]) / len(kinds)
    out = out.select("symbol", "session", mean.alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "symbol")).cast("long"))


def save_ensemble(models: dict[str, PipelineModel], path: str) -> None:
    """Each member in a folder of its name."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_ensemble(path: str, names: list[str]) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{path}/{n}") for n in names}


def ensemble_mean(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """rows with `score`, the mean of the members' predictions; rows with an unknown feature go."""
    columns, out = rows.columns, rows
    for name, model in models.items():
        out = model.transform(out.drop("features")).withColumnRenamed("prediction", f"p_{name}")
    return out.select(*columns, (reduce(lambda a, b: a + b, [F.col(f"p_{n}") for n in models]) / len(models)).alias("score"))


def ablation(train: DataFrame, check: DataFrame, sets: dict[str, list[str]], labels: list[str], kinds: list[str]) -> list[tuple[str, str, str, int, float]]:
    """(feature set, label, learner, rows checked, root mean squared error) of every combination. All learners of a feature set are checked in one pass."""
    out = []
    for name, features in sets.items():
        rows, measures, pairs = check, [], [(label, kind) for label in labels for kind in kinds]
        for k, (label, kind) in enumerate(pairs):
            rows = fitted(train, features, label, kind).transform(rows).withColumnRenamed("prediction", f"_p{k}").drop("features")
            error = F.col(label) - F.col(f"_p{k}")
            measures += [F.count(label).alias(f"n{k}"), F.sqrt(F.avg(error * error)).alias(f"rmse{k}")]
        r = rows.agg(*measures).first()
        out += [(name, label, kind, r[f"n{k}"], r[f"rmse{k}"]) for k, (label, kind) in enumerate(pairs)]
    return out


def _stored(model: PipelineModel, spark) -> PipelineModel:
    """The model as it is read from storage: without its training summary, which holds the session and so keeps a logistic model from being sent
    to tasks once that session has observed metrics."""
    path = new_path(spark, "model")
    model.write().save(path)
    return PipelineModel.load(path)


def platt(rows: DataFrame, score: str, target: str, least_rows: int = 100):
    """Logistic curve from out-of-sample scores to probabilities; None below least_rows or where the target is constant."""
    known = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    size = known.agg(F.count("*").alias("n"), F.countDistinct(target).alias("kinds")).first()
    if size["n"] < least_rows or size["kinds"] < 2:
        return None
    curve = LogisticRegression(featuresCol="platt_score", labelCol=target, probabilityCol="platt", predictionCol="platt_class", rawPredictionCol="platt_raw")
    return _stored(Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="platt_score"), curve]).fit(known), rows.sparkSession)


def walk_forward(panel: DataFrame, features: list[str], label: str, folds: list[tuple[str, str]], embargo_days: int, kind: str = "linear", **params) -> DataFrame:
    """Predictions of each test span [start, end) by a model fitted on all rows that end an embargo before it."""
    parts = []
    for k, (start, end) in enumerate(folds):
        cut = F.date_sub(F.lit(start).cast("date"), embargo_days)
        test = panel.where((F.col("session") >= start) & (F.col("session") < end))
        parts.append(fitted(panel.where(F.col("session") < cut), features, label, kind, **params).transform(test).select(F.lit(k).alias("fold"), "symbol", "session", label, "prediction"))
    return reduce(DataFrame.unionByName, parts)


def probability(rows: DataFrame, inputs: list[str], target: str, weight: str, penalty: float = 0.01, least_rows: int = 100, date: str | None = None, least_dates: int = 40):
    """Penalized logistic model on standardized inputs with row weights; None below least_rows, or below least_dates dates where `date` names their column."""
    size = rows.agg(F.count("*").alias("n"), (F.countDistinct(date) if date else F.lit(least_dates)).alias("dates")).first()
    if size["n"] < least_rows or size["dates"] < least_dates:
        return None
    steps = [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip"), LogisticRegression(labelCol=target, weightCol=weight, regParam=penalty, standardization=True)]
    return _stored(Pipeline(stages=steps).fit(rows), rows.sparkSession)


def ridge_ranker(train: DataFrame, numeric: list[str], category: str, label: str, penalty: float = 1.0) -> PipelineModel:
    """Ridge on median-imputed numbers with flags for what was missing, and a category one-hot encoded; unseen categories are kept apart."""
    filled = [f"{c}_filled" for c in numeric]
    steps = [
        Imputer(inputCols=numeric, outputCols=filled, strategy="median"),
        StringIndexer(inputCol=category, outputCol="_c", handleInvalid="keep"),
        OneHotEncoder(inputCols=["_c"], outputCols=["_onehot"]),
        VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in numeric], "_onehot"], outputCol="features"),
        LinearRegression(labelCol=label, regParam=penalty, elasticNetParam=0.0),
    ]
    flagged = train
    for c in numeric:
        flagged = flagged.withColumn(f"{c}_missing", F.col(c).isNull().cast("double"))
    return Pipeline(stages=steps).fit(flagged)
