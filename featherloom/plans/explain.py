"""Model-agnostic explanations: change rows in Spark, predict, aggregate.

``predict`` is any function that adds a ``prediction`` column to a DataFrame, such as
``FittedModel.predict``. Variants of a row are made by exploding a short literal array, so the
row count grows by a fixed factor and nothing is collected. Trees and linear models need no variants.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from functools import reduce
from math import comb

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherloom.operators.ordered import q
from featherloom.operators.profile import wide_aggregate
from featherloom.operators.quantiles import exact_quantiles
from featherloom.params import ParameterError, need_columns, one_of
from featherloom.plans import trees
from featherloom.plans.models import FittedModel
from featherloom.session import materialise

Predict = Callable[[DataFrame], DataFrame]


def _grids(rows: DataFrame, features: Sequence[str], resolution: int, percentiles: tuple[float, float]) -> dict[str, list[float]]:
    """Per feature its distinct values, or ``resolution`` even steps between two percentiles where it has as many or more."""
    bounds = exact_quantiles(rows, features, list(percentiles))
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), q(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("s")).select("s.*").where("v IS NOT NULL").distinct()
    ranked = stacked.withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("v"))).where(F.col("n") <= resolution)  # a top-n per feature, cut before the shuffle
    values: dict[int, list[float]] = {i: [] for i in range(len(features))}
    for r in ranked.select("f", "v").collect():  # at most features x resolution
        values[r["f"]].append(r["v"])
    grids = {}
    for i, f in enumerate(features):
        lo, hi = bounds[f]
        grids[f] = sorted(values[i]) if len(values[i]) < resolution else [lo + (hi - lo) * k / (resolution - 1) for k in range(resolution)]
    return grids


def partial_dependence(
    df: DataFrame, predict: Predict, features: Sequence[str], grid_resolution: int = 50, percentiles: tuple[float, float] = (0.05, 0.95), reads: Sequence[str] | None = None
) -> DataFrame:
    """Average prediction with one feature set to each grid value, for any number of features.

    A feature with fewer distinct values than the grid uses these values. ``reads`` are the columns ``predict`` looks
    at (a fitted model's features, else all columns). Trees are evaluated leaf by leaf in one pass, linear
    models from their means. For anything else rows that agree on ``reads`` are counted first, and each distinct
    combination of the other columns meets the grid once.
    """
    if not features:
        raise ParameterError("name at least one feature")
    need_columns(df, features)
    grids = _grids(df, features, grid_resolution, percentiles)
    if trees.is_tree_model(predict):
        return trees.tree_dependence(df, trees.read_ensemble(df, predict), grids)
    fitted = getattr(predict, "__self__", None)
    if isinstance(fitted, FittedModel) and hasattr(fitted.model.stages[-1], "coefficients"):
        return _linear_dependence(df, fitted, grids)
    reads = list(reads or (fitted.features if isinstance(fitted, FittedModel) else df.columns))
    combined = materialise(df.groupBy(*[q(c) for c in reads]).agg(F.count(F.lit(1)).alias("__rows")), "combinations")
    parts = []
    for f, grid in grids.items():
        others = [c for c in reads if c != f]
        points = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(v).alias("value")) for i, v in enumerate(grid)])).alias("__p")
        if f in reads:
            varied = combined.groupBy(*[q(c) for c in others]).agg(F.sum("__rows").alias("__rows")).select(*[q(c) for c in others], "__rows", points).withColumn(f, F.col("__p.value"))
            means = predict(varied).groupBy("__p").agg((F.sum(F.col("prediction") * F.col("__rows")) / F.sum("__rows")).alias("average_prediction"))
        else:  # what is not read changes nothing
            means = predict(combined).agg((F.sum(F.col("prediction") * F.col("__rows")) / F.sum("__rows")).alias("average_prediction")).select("average_prediction", points)
        parts.append(means.select(F.lit(f).alias("feature"), F.col("__p.point").alias("point"), F.col("__p.value").alias("grid_value"), "average_prediction"))
    return reduce(DataFrame.unionByName, parts)


def _linear_dependence(df: DataFrame, fitted: FittedModel, grids: dict[str, list[float]]) -> DataFrame:
    core = fitted.model.stages[-1]
    weights = dict(zip(fitted.features, map(float, core.coefficients.toArray())))
    means = wide_aggregate(df, {f: F.avg(F.coalesce(q(f).cast("double"), F.lit(0.0))) for f in fitted.features})
    level = float(core.intercept) + sum(w * means[f] for f, w in weights.items())
    rows = [(f, i, float(v), level + (weights[f] * (v - means[f]) if f in weights else 0.0)) for f, grid in grids.items() for i, v in enumerate(grid)]
    return df.sparkSession.createDataFrame(rows, "feature string, point int, grid_value double, average_prediction double")


def dependence_trend(dependence: DataFrame) -> DataFrame:
    """Range of the effect and its direction by the slope over the grid points."""
    slope = F.regr_slope("average_prediction", F.col("point").cast("double"))
    out = dependence.groupBy("feature").agg(
        F.min("grid_value").alias("grid_min"), F.max("grid_value").alias("grid_max"), F.min("average_prediction").alias("effect_min"),
        F.max("average_prediction").alias("effect_max"), slope.alias("slope"),
    )
    return out.withColumn("trend", F.when(F.abs("slope") < 0.001, "flat").when(F.col("slope") > 0, "increasing").otherwise("decreasing"))


def _means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return wide_aggregate(df, {f: F.avg(q(f).cast("double")) for f in features})


def feature_contributions(df: DataFrame, predict: Predict, features: Sequence[str], keys: Sequence[str], method: str = "permutation", background: DataFrame | None = None) -> DataFrame:
    """Per row and feature: prediction minus the prediction with the feature at its mean
    (``permutation``), or the feature minus its mean (``difference``)."""
    one_of(method, ("permutation", "difference"), "method")
    need_columns(df, [*features, *keys])
    means = _means(background if background is not None else df, features)
    if method == "difference":
        items = F.array(*[F.struct(F.lit(f).alias("feature"), (q(f).cast("double") - F.lit(means[f])).alias("contribution")) for f in features])
        return df.select(*[q(k) for k in keys], F.explode(items).alias("__c")).select(*[q(k) for k in keys], "__c.*")
    based = predict(df).withColumnRenamed("prediction", "__base")
    varied = based.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    varied = varied.withColumns({f: F.when(F.col("feature") == f, F.lit(means[f])).otherwise(q(f).cast("double")) for f in features})
    return predict(varied).select(*[q(k) for k in keys], "feature", (F.col("__base") - F.col("prediction")).alias("contribution"))


def _one_row(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(q(key) == F.lit(value)).limit(1)


def nearest_rows(df: DataFrame, features: Sequence[str], key: str, value, k: int = 5) -> DataFrame:
    """The k other rows closest to the row with the given key, in standard deviations."""
    stats = wide_aggregate(df, {**{f"m|{f}": F.avg(q(f).cast("double")) for f in features}, **{f"s|{f}": F.stddev_samp(q(f).cast("double")) for f in features}})
    row = _one_row(df, key, value).first()
    if row is None:
        raise ParameterError(f"no row with {key} = {value!r}")
    total: Column = F.lit(0.0)
    for f in features:
        if stats[f"s|{f}"]:
            total = total + F.pow((q(f).cast("double") - F.lit(float(row[f]))) / F.lit(stats[f"s|{f}"]), 2)
    others = df.where(~q(key).eqNullSafe(F.lit(value)))
    return others.withColumn("distance", F.sqrt(total)).orderBy("distance", q(key)).limit(k)


def explain_row(df: DataFrame, predict: Predict, features: Sequence[str], key: str, value) -> DataFrame:
    """Per feature of one row: value, mean, std, deviation, z-score, percentile and importance."""
    row = _one_row(df, key, value)
    picked = row.first()
    if picked is None:
        raise ParameterError(f"no row with {key} = {value!r}")
    aggs = {"n": F.count(F.lit(1))}
    for f in features:
        x = q(f).cast("double")
        aggs.update({f"m|{f}": F.avg(x), f"s|{f}": F.stddev_samp(x), f"p|{f}": F.count_if(x <= F.lit(float(picked[f])))})
    got = wide_aggregate(df, aggs)
    rows = []
    for f in features:
        v, m, s = float(picked[f]), got[f"m|{f}"], got[f"s|{f}"]
        rows.append((f, v, m, s, v - m, (v - m) / s if s else 0.0, 100.0 * got[f"p|{f}"] / got["n"]))
    stats = df.sparkSession.createDataFrame(rows, "feature string, value double, mean double, std double, deviation double, z_score double, percentile double")
    effect = feature_contributions(row, predict, features, [key], background=df).select("feature", F.abs("contribution").alias("importance"))
    return stats.join(F.broadcast(effect), "feature")  # one row per feature


def prediction_context(df: DataFrame, predict: Predict, key: str, value) -> DataFrame:
    """Prediction of one row against the mean and (population) spread of all predictions."""
    scored = predict(df)
    out = scored.agg(F.max(F.when(q(key) == F.lit(value), F.col("prediction"))).alias("prediction"), F.avg("prediction").alias("baseline"), F.stddev_pop("prediction").alias("std"))
    return out.withColumn("z_score", F.when(F.col("std") > 0, (F.col("prediction") - F.col("baseline")) / F.col("std")).otherwise(F.lit(0.0)))


def coalitions(n: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions (rows of 0 / 1, the empty and the full one first) and the matrix that turns their worths into Shapley values.

    All of them if there are at most ``most``, otherwise pairs of a drawn coalition and its complement, sizes drawn in
    proportion to the kernel's mass. The values minimise the weighted squared distance between a coalition's worth
    and the sum of its members' values, whose total is fixed; the minimum is linear in the worths, hence a matrix.
    With all coalitions it is exact.
    """
    ends = [np.zeros(n, int), np.ones(n, int)]
    sizes = np.arange(1, n)
    mass = (n - 1) / (sizes * (n - sizes)) if n > 1 else np.zeros(0)  # kernel weight of a size's coalitions together
    if 2**n <= max(most, 4):
        inner = [np.array([(k >> i) & 1 for i in range(n)]) for k in range(1, 2**n - 1)]
        weight = np.array([mass[z.sum() - 1] / comb(n, int(z.sum())) for z in inner])
    else:
        rng = random.Random(seed)
        drawn: dict[tuple, float] = {}
        for _ in range(max(most // 2, n)):
            z = np.zeros(n, int)
            z[rng.sample(range(n), rng.choices(sizes.tolist(), mass.tolist())[0])] = 1
            for side in (z, 1 - z):
                drawn[tuple(side)] = drawn.get(tuple(side), 0.0) + 1.0
        inner, weight = [np.array(z) for z in drawn], np.array(list(drawn.values()))
    table = np.array([*ends, *inner])
    # The last feature's value is the total less the others'.
    worth = np.eye(len(table))
    total = worth[1] - worth[0]
    if n == 1:
        return table, total[None, :]
    z = table[2:]
    design = (z[:, :-1] - z[:, -1:]).astype(float)
    goal = worth[2:] - worth[0] - z[:, -1:] * total
    root = np.sqrt(weight)[:, None]
    values = np.linalg.lstsq(design * root, goal * root, rcond=None)[0]
    return table, np.vstack([values, total - values.sum(axis=0)])


def shapley_values(
    df: DataFrame, predict: Predict, features: Sequence[str], keys: Sequence[str], samples: int = 256, seed: int = 42, background: DataFrame | None = None, method: str = "auto",
    permutations: int | None = None,
) -> DataFrame:
    """Shapley value of every feature for every row.

    ``kernel``: absent features stand at the background's mean; the values are the weighted least squares fit to
    the predictions of at most ``samples`` coalitions, exact if all of them are used (see :func:`coalitions`). ``paths``, for models
    made of trees: absent features leave a split open, taken in the training rows' shares; exact, by polynomials over the paths,
    and without copies of rows. ``auto`` takes paths for trees. A number of ``permutations`` asks for as many
    coalitions as so many orders of the features pass.
    """
    one_of(method, ("auto", "kernel", "paths"), "method")
    need_columns(df, [*features, *keys])
    samples = samples if permutations is None else permutations * (len(features) + 1)
    if method == "paths" or method == "auto" and trees.is_tree_model(predict):
        found = trees.tree_shapley(df, trees.read_ensemble(df, predict), keys)
        return found.where(F.col("feature").isin(list(features)))
    means = _means(background if background is not None else df, features)
    table, weights = coalitions(len(features), samples, seed)
    text = json.dumps([{"present": "".join(map(str, z)), "weights": w.tolist()} for z, w in zip(table.tolist(), weights.T)])
    variants = F.from_json(F.lit(text), "array<struct<present string, weights array<double>>>")  # folded to one literal
    varied = df.withColumn("__v", F.explode(variants))
    varied = varied.withColumns({f: F.when(F.substring("__v.present", j + 1, 1) == "1", q(f).cast("double")).otherwise(F.lit(means[f])) for j, f in enumerate(features)})
    sums = [F.sum(F.col("__v.weights")[j] * F.col("prediction")).alias(f"__s{j}") for j in range(len(features))]
    parts = predict(varied).groupBy(*[q(k) for k in keys]).agg(*sums)
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"__s{j}").alias("shapley_value")) for j, f in enumerate(features)])
    return parts.select(*[q(k) for k in keys], F.explode(items).alias("__i")).select(*[q(k) for k in keys], "__i.*")


def shapley_importance(values: DataFrame) -> DataFrame:
    return values.groupBy("feature").agg(F.avg(F.abs("shapley_value")).alias("mean_abs_shapley")).orderBy(F.desc("mean_abs_shapley"), "feature")


def local_surrogate(
    df: DataFrame, predict: Predict, features: Sequence[str], key: str, value, num_features: int | None = None, num_samples: int = 5000, seed: int = 42
) -> DataFrame:
    """Weighted linear fit around one row: features (all, or the strongest ``num_features``) with their local weights.

    Neighbours are drawn from normals with the columns' spread; weights fall with distance.
    """
    picked = _one_row(df, key, value).first()
    if picked is None:
        raise ParameterError(f"no row with {key} = {value!r}")
    got = wide_aggregate(df, {f: F.stddev_samp(q(f).cast("double")) for f in features})
    spread = {f: got[f] or 1.0 for f in features}
    spark = df.sparkSession
    near = spark.range(0, num_samples, 1, 8).select("id", *[F.when(F.col("id") == 0, 0.0).otherwise(F.randn(seed + i)).alias(f"__z{i}") for i in range(len(features))])
    near = near.withColumns({f: F.lit(float(picked[f])) + F.col(f"__z{i}") * spread[f] for i, f in enumerate(features)})
    distance = F.lit(0.0)
    for i in range(len(features)):
        distance = distance + F.col(f"__z{i}") * F.col(f"__z{i}")
    width2 = 0.75 * 0.75 * len(features)
    scored = predict(near).withColumn("__w", F.sqrt(F.exp(-distance / width2)))
    vectors = VectorAssembler(inputCols=[f"__z{i}" for i in range(len(features))], outputCol="__zv").transform(scored)
    fit = LinearRegression(featuresCol="__zv", labelCol="prediction", weightCol="__w", predictionCol="__local", regParam=0.0).fit(vectors)
    ranked = sorted(zip(features, map(float, fit.coefficients.toArray())), key=lambda x: (-abs(x[1]), x[0]))[:num_features]
    return spark.createDataFrame([(f, w, w / spread[f]) for f, w in ranked], "feature string, weight_per_std double, weight double")
