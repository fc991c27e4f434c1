"""MLlib classifiers: labels of any type, stratified cross-validation, class shares of predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.operators.ordered import q
from featherloom.params import ParameterError, need_columns, one_of
from featherloom.plans.models import PREDICTION, _in_threads, _inputs
from featherloom.plans.splitters import stratified_k_fold
from featherloom.session import materialise

# Per classifier: the estimator, the parameter names users give and what they set, and defaults.
_FAMILIES = {
    "logistic_regression": (LogisticRegression, {"alpha": "regParam", "l1_ratio": "elasticNetParam", "max_iter": "maxIter", "tol": "tol", "fit_intercept": "fitIntercept"}, {}),
    "decision_tree": (DecisionTreeClassifier, {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "random_state": "seed"}, {"maxDepth": 5, "seed": 42}),
    "random_forest": (RandomForestClassifier, {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "random_state": "seed"}, {"numTrees": 100, "maxDepth": 10, "seed": 42}),
    "naive_bayes": (NaiveBayes, {"smoothing": "smoothing"}, {"modelType": "gaussian"}),
}
CLASSIFIER_TYPES = tuple(_FAMILIES)
SCORES = ("accuracy", "precision", "recall", "f1")
_MOST_CLASSES = 10_000


@dataclass
class FittedClassifier:
    """A fitted classifier, the columns it reads and its labels in the order of their numbers."""

    model: PipelineModel
    features: list[str]
    target: str
    labels: list
    label_type: str

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, a label; missing inputs count as 0."""
        out = self.model.transform(_inputs(df.drop(PREDICTION), self.features))
        label = F.array(*[F.lit(v).cast(self.label_type) for v in self.labels])[F.col("__number").cast("int")]
        return out.withColumn(PREDICTION, label).drop("__features", "__number", "__raw", "__probability", *[f"__x{i}" for i in range(len(self.features))])


def class_labels(df: DataFrame, target: str) -> list:
    """Distinct non-null labels in order; a model holds one set of numbers for each, so there are few."""
    found = df.select(q(target).alias("label")).where("label IS NOT NULL").distinct().orderBy("label").limit(_MOST_CLASSES + 1).collect()
    if len(found) > _MOST_CLASSES:
        raise ParameterError(f"{target} has more than {_MOST_CLASSES} classes")
    return [r["label"] for r in found]


def fit_classifier(df: DataFrame, model_type: str, target: str, features: Sequence[str], parameters: dict | None = None, labels: Sequence | None = None) -> FittedClassifier:
    """Fit on the rows that have a label. ``labels`` fixes the numbering, for folds that lack a class."""
    one_of(model_type, CLASSIFIER_TYPES, "model_type")
    need_columns(df, [target, *features])
    estimator, names, settings = _FAMILIES[model_type]
    settings = dict(settings)
    for k, v in (parameters or {}).items():
        if k not in names:
            raise ParameterError(f"{model_type} has no parameter {k!r}; known: {sorted(names)}")
        settings[names[k]] = v
    labels = list(class_labels(df, target) if labels is None else labels)
    if not labels:
        raise ParameterError(f"{target} has no labels")
    kind = df.schema[target].dataType.simpleString()
    number = F.array_position(F.array(*[F.lit(v).cast(kind) for v in labels]), q(target)).cast("double") - 1
    rows = _inputs(df.where(q(target).isNotNull()), features).select(number.alias("__label"), *[F.col(f"__x{i}") for i in range(len(features))])
    assembler = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(features))], outputCol="__features")
    core = estimator(featuresCol="__features", labelCol="__label", predictionCol="__number", rawPredictionCol="__raw", probabilityCol="__probability", **settings)
    return FittedClassifier(Pipeline(stages=[assembler, core]).fit(rows), list(features), target, labels, kind)


def fold_scores(df: DataFrame, actual: str, predicted: str, fold: str = "fold") -> DataFrame:
    """(fold, accuracy, precision, recall, f1): macro means over the classes that occur, 0 where undefined; one aggregate for all folds."""
    counts = df.where(q(actual).isNotNull() & q(predicted).isNotNull()).groupBy(q(fold).alias("fold"), q(actual).alias("a"), q(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit, none = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("a").alias("class"), hit.alias("tp"), F.col("n").alias("support"), none.alias("called")),
        F.struct(F.col("p").alias("class"), none.alias("tp"), none.alias("support"), F.col("n").alias("called")),
    )
    classes = counts.select("fold", F.explode(sides).alias("s")).select("fold", "s.*").groupBy("fold", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "called")])
    precision, recall = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("called") + F.col("support")), F.lit(0.0))
    return classes.groupBy("fold").agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(f1).alias("f1"))


def cross_validate_classifier(
    df: DataFrame, model_type: str, target: str, features: Sequence[str], keys: Sequence[str], parameters: dict | None = None, n_folds: int = 5, seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Mean, std, min and max of every score over stratified folds."""
    placed = stratified_k_fold(df, target, keys, n_folds, seed)
    rows = materialise(placed.select(*[q(c) for c in dict.fromkeys([*keys, target, *features, "fold"])]), "folds")
    labels = class_labels(rows, target)

    def one(fold: int) -> DataFrame:
        model = fit_classifier(rows.where(F.col("fold") != fold), model_type, target, features, parameters, labels)
        return model.predict(rows.where(F.col("fold") == fold))

    scored = reduce(DataFrame.unionByName, _in_threads(one, range(n_folds), parallelism))
    long = fold_scores(scored, target, PREDICTION).unpivot(["fold"], list(SCORES), "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("folds")
    )


def class_shares(df: DataFrame, prediction: str = PREDICTION) -> DataFrame:
    """(class, n, share) of the predictions, the most frequent first; null is a class of its own."""
    counts = df.groupBy(q(prediction).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.withColumn("share", F.col("n") / F.lit(max(total, 1))).orderBy(F.desc("n"), F.col("class").asc_nulls_last())
