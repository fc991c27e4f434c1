"""MLlib regressors behind one small interface: fit on a table, add a prediction column, persist."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.operators.ordered import q
from featherloom.params import ParameterError, need_columns, numeric_columns, one_of
from featherloom.plans.metrics import class_metrics, regression_metrics
from featherloom.plans.splitters import k_fold, random_split, stratified_k_fold
from featherloom.session import materialise

PREDICTION = "prediction"

# Per model: the estimator, the parameter names users give and what they set, and defaults.
_FAMILIES = {
    "linear_regression": (LinearRegression, {"fit_intercept": "fitIntercept"}, {"regParam": 0.0, "standardization": False}),
    "lasso": (LinearRegression, {"alpha": "regParam", "max_iter": "maxIter", "tol": "tol", "fit_intercept": "fitIntercept"}, {"regParam": 1.0, "elasticNetParam": 1.0, "standardization": False}),
    "elastic_net": (LinearRegression, {"alpha": "regParam", "l1_ratio": "elasticNetParam", "max_iter": "maxIter", "tol": "tol", "fit_intercept": "fitIntercept"}, {"regParam": 1.0, "elasticNetParam": 0.5, "standardization": False}),
    "huber": (LinearRegression, {"epsilon": "epsilon", "alpha": "regParam", "max_iter": "maxIter", "tol": "tol"}, {"loss": "huber", "regParam": 0.0001, "epsilon": 1.35}),
    "decision_tree": (DecisionTreeRegressor, {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "random_state": "seed"}, {"maxDepth": 5, "seed": 42}),
    "random_forest": (RandomForestRegressor, {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "random_state": "seed"}, {"numTrees": 100, "maxDepth": 30, "seed": 42}),
    "gradient_boosting": (GBTRegressor, {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth", "subsample": "subsamplingRate", "random_state": "seed"}, {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42}),
    "xgboost": (GBTRegressor, {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth", "subsample": "subsamplingRate", "random_state": "seed"}, {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42}),
}
MODEL_TYPES = tuple(_FAMILIES)
FIT_ROWS = 10_000  # rows that are worth a task of their own in each pass of a fit


def regressor(model_type: str, parameters: dict | None = None):
    one_of(model_type, MODEL_TYPES, "model_type")
    estimator, names, settings = _FAMILIES[model_type]
    settings = dict(settings)
    for k, v in (parameters or {}).items():
        if k not in names:
            raise ParameterError(f"{model_type} has no parameter {k!r}; known: {sorted(names)}")
        settings[names[k]] = v
    return estimator(featuresCol="__features", labelCol="__label", predictionCol=PREDICTION, **settings)


@dataclass
class FittedModel:
    """A fitted MLlib model with the columns it reads."""

    model: PipelineModel
    features: list[str]
    target: str
    model_type: str

    def predict(self, df: DataFrame, clip: bool = False) -> DataFrame:
        """Add ``prediction``; missing inputs count as 0."""
        out = self.model.transform(_inputs(df.drop(PREDICTION), self.features))
        out = out.drop("__features", *[f"__x{i}" for i in range(len(self.features))])
        return out.withColumn(PREDICTION, F.greatest(F.col(PREDICTION), F.lit(0.0))) if clip else out

    def importances(self, top_n: int | None = None) -> list[tuple[str, float]]:
        """Tree importances or absolute coefficients, largest first."""
        core = self.model.stages[-1]
        values = core.featureImportances.toArray() if hasattr(core, "featureImportances") else [abs(v) for v in core.coefficients.toArray()]
        ranked = sorted(zip(self.features, map(float, values)), key=lambda x: (-x[1], x[0]))
        return ranked[:top_n] if top_n else ranked

    def importance_table(self, spark: SparkSession, top_n: int | None = None) -> DataFrame:
        rows = [(i + 1, f, v) for i, (f, v) in enumerate(self.importances(top_n))]
        return spark.createDataFrame(rows, "rank int, feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        text = json.dumps({"features": self.features, "target": self.target, "model_type": self.model_type})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedModel:
        about = json.loads(spark.read.text(f"{path}/columns").first()[0])
        return cls(PipelineModel.load(f"{path}/model"), about["features"], about["target"], about["model_type"])


def _inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"__x{i}": F.coalesce(q(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})


def fit_model(df: DataFrame, model_type: str, target: str, features: Sequence[str], parameters: dict | None = None) -> FittedModel:
    """Fit on the rows that have a target."""
    need_columns(df, [target, *features])
    rows = _inputs(df.where(q(target).isNotNull()), features).withColumn("__label", q(target).cast("double"))
    rows = _dealt(rows.select("__label", *[f"__x{i}" for i in range(len(features))]))
    if model_type == "elastic_net":
        parameters = _elastic(rows, parameters or {})
    assembler = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(features))], outputCol="__features")
    model = Pipeline(stages=[assembler, regressor(model_type, parameters)]).fit(rows)
    return FittedModel(model, list(features), target, model_type)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows for the many passes of a fit, dealt evenly over the cores: a small file of many rows is read by one task or few.

    Equal tables give equal parts in equal order, so draws of rows by a seed agree between runs.
    """
    n = min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FIT_ROWS))
    if n < 2:
        return rows
    return rows.repartition(n).sortWithinPartitions(*rows.columns)


def _elastic(rows: DataFrame, parameters: dict) -> dict:
    """MLlib divides the squared part of the penalty by the label's deviation; strength and ratio that undo it.

    The penalty is then alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2) beside the squared error / 2n, in the columns' own units.
    """
    alpha, ratio = float(parameters.get("alpha", 1.0)), float(parameters.get("l1_ratio", 0.5))
    spread = rows.agg(F.stddev_samp("__label")).first()[0] or 1.0
    strength = alpha * (ratio + (1 - ratio) * spread)
    return parameters | {"alpha": strength, "l1_ratio": alpha * ratio / strength if strength else ratio}


# ---- training and validation -----------------------------------------------------------


def train(
    df: DataFrame, target: str, keys: Sequence[str], model_type: str = "linear_regression", features: Sequence[str] | None = None,
    parameters: dict | None = None, test_size: float = 0.2, seed: int = 42,
) -> tuple[FittedModel, DataFrame]:
    """Fit on a random 80 %, score both parts. Missing inputs become 0, a missing target the mean."""
    features = list(features or [c for c in numeric_columns(df) if c not in (target, *keys)])
    mean = df.agg(F.avg(q(target))).first()[0]
    filled = df.withColumn(target, F.coalesce(q(target).cast("double"), F.lit(mean)))
    rows = materialise(random_split(filled.select(*[q(c) for c in dict.fromkeys([*keys, target, *features])]), keys, test_size, seed), "training")
    model = fit_model(rows.where("split = 'train'"), model_type, target, features, parameters)
    return model, regression_metrics(model.predict(rows), target, PREDICTION, ["split"])


METRICS = ("mse", "rmse", "mae", "r2", "mape", "wmape")


def cross_validate(
    df: DataFrame, model_type: str, target: str, features: Sequence[str], keys: Sequence[str], parameters: dict | None = None,
    n_folds: int = 5, stratified: bool = False, seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Mean, std, min and max over the folds of every metric."""
    placed = stratified_k_fold(df, target, keys, n_folds, seed) if stratified else k_fold(df, keys, n_folds, True, seed)
    rows = materialise(placed.select(*[q(c) for c in dict.fromkeys([*keys, target, *features, "fold"])]), "folds")

    def one(fold: int) -> DataFrame:
        model = fit_model(rows.where(F.col("fold") != fold), model_type, target, features, parameters)
        return model.predict(rows.where(F.col("fold") == fold))

    scored = _in_threads(one, range(n_folds), parallelism)
    per_fold = regression_metrics(reduce(DataFrame.unionByName, scored), target, PREDICTION, ["fold"])
    long = per_fold.unpivot(["fold"], list(METRICS), "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("folds")
    )


def cross_validate_classes(df: DataFrame, predict_by_fold, target: str, keys: Sequence[str], n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Per-class scores over stratified folds for a caller-given classifier ``predict_by_fold(train, test)``."""
    rows = materialise(stratified_k_fold(df, target, keys, n_folds, seed), "folds")
    parts = [predict_by_fold(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)) for f in range(n_folds)]
    return class_metrics(reduce(DataFrame.unionByName, parts), target, PREDICTION)


def _in_threads(fn, items, parallelism: int) -> list:
    """Independent fits submitted from a few driver threads; Spark shares the executors among them."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(fn, items))


# ---- scoring ---------------------------------------------------------------------------


def batch_predict(df: DataFrame, model: FittedModel) -> DataFrame:
    """Predictions for a whole table; its partitions are the batches."""
    return model.predict(df)


def prediction_summary(df: DataFrame, prediction: str = PREDICTION) -> DataFrame:
    p = q(prediction)
    return df.agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))


def map_predict(df: DataFrame, score, features: Sequence[str], prediction: str = PREDICTION) -> DataFrame:
    """Any vectorised Python model: ``score(pandas frame of the features) -> array``, in Arrow batches."""
    names = list(features)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{prediction: score(pdf[names])})

    schema = T.StructType([*df.schema.fields, T.StructField(prediction, T.DoubleType())])
    return df.mapInPandas(run, schema)


def model_udf(score, return_type: str = "double"):
    """A column function over feature columns for a vectorised model; types as in the model's signature."""
    one_of(return_type, ("double", "float", "integer", "long", "string", "binary", "boolean", "timestamp"), "return_type")
    spark_type = {"integer": "int", "long": "bigint"}.get(return_type, return_type)

    @F.pandas_udf(spark_type)
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series(score(pd.concat(columns, axis=1)))

    def call(*columns: Column) -> Column:
        return apply(*columns)

    return call
