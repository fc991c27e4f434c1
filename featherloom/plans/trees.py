"""Fitted tree ensembles as plain arrays, and what can be computed on them without copying rows.

The nodes come from the table MLlib saves a model in. A leaf is the product of the intervals that its path leaves to
each feature, so a prediction, a Shapley value and a partial dependence are sums over leaves of products over the features of
a path. They are evaluated on Arrow batches inside tasks; the arrays are as large as the model, which a driver holds anyway.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.operators.ordered import q
from featherloom.session import new_path, shuffle_partitions

#: Last stages of fitted pipelines whose trees are read.
TREES = ("DecisionTreeRegressionModel", "RandomForestRegressionModel", "GBTRegressionModel")


@dataclass
class Leaf:
    """A leaf's weighted value, and for each feature of its path the interval (above, upto] and the share of the
    training rows of the nodes splitting on it that went the path's way."""

    value: float
    features: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    share: np.ndarray


@dataclass
class Ensemble:
    features: list[str]
    leaves: list[Leaf]

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        """Per feature the ends of all leaves' intervals."""
        ends: list[list[float]] = [[] for _ in self.features]
        for leaf in self.leaves:
            for f, low, high in zip(leaf.features.tolist(), leaf.above.tolist(), leaf.upto.tolist()):
                ends[f] += [x for x in (low, high) if np.isfinite(x)]
        return [np.unique(e) for e in ends]

    @property
    def base(self) -> float:
        """The prediction when nothing is known: every split taken in the shares of the training rows."""
        return float(sum(leaf.value * leaf.share.prod() for leaf in self.leaves))


def is_tree_model(predictor) -> bool:
    """Whether ``predictor`` is the ``predict`` method of a fitted model made of trees over numbers."""
    owner = getattr(predictor, "__self__", predictor)
    stages = getattr(getattr(owner, "model", None), "stages", None)
    return bool(stages) and type(stages[-1]).__name__ in TREES


def read_ensemble(df: DataFrame, predictor) -> Ensemble:
    """The trees of a fitted model; ``df`` gives the session and may be any table."""
    fitted = getattr(predictor, "__self__", predictor)
    core, spark = fitted.model.stages[-1], df.sparkSession
    path = new_path(spark, "trees")
    core.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    kind = type(core).__name__
    if kind == "DecisionTreeRegressionModel":
        nodes, weights = nodes.select(F.lit(0).alias("tree"), *nodes.columns), [1.0]
    else:
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
        weights = [w / core.getNumTrees for w in core.treeWeights] if kind == "RandomForestRegressionModel" else list(core.treeWeights)
    columns = ["tree", "id", "prediction", F.get("impurityStats", 0).alias("rows"), "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", 0).alias("cut")]
    table = {(r["tree"], r["id"]): r for r in nodes.select(*columns).toLocalIterator()}  # the model itself
    leaves: list[Leaf] = []
    for tree, weight in enumerate(weights):
        todo = [(0, {})]
        while todo:
            number, path_of = todo.pop()
            node = table[tree, number]
            if node["leftChild"] < 0:
                order = sorted(path_of)
                parts = np.array([path_of[f] for f in order], float).reshape(-1, 3)
                leaves.append(Leaf(weight * node["prediction"], np.array(order, int), parts[:, 0], parts[:, 1], parts[:, 2]))
                continue
            f, cut = node["feature"], node["cut"]
            low, high, share = path_of.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                todo.append((child, path_of | {f: (*bounds, share * table[tree, child]["rows"] / node["rows"])}))
    return Ensemble(list(fitted.features), leaves)


def _holds(leaf: Leaf, table: np.ndarray) -> np.ndarray:
    """(rows, features of the path): whether a row's value lies in the leaf's interval."""
    values = table[:, leaf.features]
    return (values > leaf.above) & (values <= leaf.upto)


def predictions(ensemble: Ensemble, table: np.ndarray) -> np.ndarray:
    return sum((leaf.value * _holds(leaf, table).all(axis=1) for leaf in ensemble.leaves), np.zeros(len(table)))


def shapley(ensemble: Ensemble, table: np.ndarray) -> np.ndarray:
    """(rows, features): Shapley values of the game in which an absent feature's splits are taken in the training rows' shares.

    Of one leaf a coalition is worth the product, over the features of its path, of the feature's indicator if present and of its share if
    absent. The sum over all coalitions of the other features, weighted by their size, is a sum over the coefficients of the
    polynomial prod(share + indicator t): work grows with the square of a path's features, not with the number of subsets.
    """
    # Rows in the same cell of all cuts lie in the same leaves, so a cell is worked out once.
    cells, back = _cells(ensemble, table)
    out = np.zeros((len(cells), len(ensemble.features)))
    for leaf in ensemble.leaves:
        if len(leaf.features):
            out[:, leaf.features] += _leaf_values(leaf, _holds(leaf, cells))
    return out[back]


def _cells(ensemble: Ensemble, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each occupied cell between the cuts of the ensemble, and the cell of every row."""
    code = np.zeros(len(table), np.int64)
    for f, cuts in enumerate(ensemble.cuts):
        if len(cuts):
            place = np.where(np.isnan(table[:, f]), len(cuts) + 1, np.searchsorted(cuts, table[:, f], "left"))
            code = np.unique(code * (len(cuts) + 2) + place, return_inverse=True)[1].ravel()  # numbered anew, so codes never overflow
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    return table[first], back.ravel()


def _leaf_values(leaf: Leaf, holds: np.ndarray) -> np.ndarray:
    """(rows, features of the path): the share of each feature in a leaf's value."""
    d = len(leaf.features)
    weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    # Rows that agree on the path's indicators have the same values; there are few patterns.
    if d < 63:
        _, first, back = np.unique(holds @ (1 << np.arange(d, dtype=np.int64)), return_index=True, return_inverse=True)
        patterns = holds[first]
    else:
        patterns, back = np.unique(holds, axis=0, return_inverse=True)
    inside = patterns.astype(float)
    values = np.zeros_like(inside)
    for i in range(d):
        poly = np.zeros((len(inside), d))
        poly[:, 0] = 1.0
        for n, j in enumerate(j for j in range(d) if j != i):
            poly[:, 1: n + 2] = poly[:, 1: n + 2] * leaf.share[j] + poly[:, : n + 1] * inside[:, j: j + 1]
            poly[:, 0] *= leaf.share[j]
        values[:, i] = leaf.value * (inside[:, i] - leaf.share[i]) * (poly @ weight)
    return values[back.ravel()]


def inputs(features: Sequence[str]) -> list[Column]:
    """Model inputs: doubles, missing ones 0."""
    return [F.coalesce(q(f).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, f in enumerate(features)]


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))


def _matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(n)]) if n else np.zeros((batch.num_rows, 0))


def tree_shapley(df: DataFrame, ensemble: Ensemble, keys: Sequence[str]) -> DataFrame:
    """(*keys, feature, shapley_value); each row is read once."""
    names = ensemble.features
    # A table of few files would be a few long tasks; the columns read are dealt evenly.
    rows = df.select(*[q(k) for k in keys], *inputs(names))
    if rows.rdd.getNumPartitions() < _tasks(df.sparkSession):
        rows = rows.repartition(_tasks(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shapley(ensemble, _matrix(batch, len(keys), len(names)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(names)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], lists], [*keys, "values"])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "`values` array<double>"])
    each = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in names]).alias("feature"), F.col("values").alias("shapley_value"))).alias("__v")
    return rows.mapInArrow(run, schema).select(*[q(k) for k in keys], each).select(*[q(k) for k in keys], "__v.*")


def tree_dependence(df: DataFrame, ensemble: Ensemble, grids: dict[str, Sequence[float]]) -> DataFrame:
    """(feature, point, average): the mean prediction over all rows with a feature set to each value of its grid, for all features in one pass.

    For a leaf a row either meets all conditions on other features or none of its grid values counts, so a task counts, per leaf
    and feature, the rows that meet the rest. The counts, not rows x grid, are summed; the grid meets them once.
    """
    place = {f: i for i, f in enumerate(ensemble.features)}
    wanted = [place[f] for f in grids if f in place]
    names = ensemble.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((len(ensemble.leaves), len(wanted) + 1), np.int64)  # the last column: rows that meet all conditions
        seen = 0
        for batch in batches:
            table = _matrix(batch, 0, len(names))
            seen += len(table)
            for n, leaf in enumerate(ensemble.leaves):
                holds = _holds(leaf, table)
                misses = (~holds).sum(axis=1)
                own = {f: i for i, f in enumerate(leaf.features.tolist())}
                met[n] += int((misses == 0).sum())
                for k, f in enumerate(wanted):
                    if f in own:
                        met[n, k] += int(((misses == 1) & ~holds[:, own[f]]).sum())
        leaf, feature = np.indices(met.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(leaf.ravel(), -1).astype(np.int32)), pa.array(np.append(feature.ravel(), -1).astype(np.int32)), pa.array(np.append(met.ravel(), seen))], ["leaf", "feature", "n"])

    counts = df.select(*inputs(names)).mapInArrow(run, "leaf int, feature int, n long").groupBy("leaf", "feature").agg(F.sum("n").alias("n"))
    found = {(r["leaf"], r["feature"]): r["n"] for r in counts.collect()}  # leaves of the model x features asked for
    rows = found.get((-1, -1), 0)
    out = []
    for f, grid in grids.items():
        values = np.asarray(grid, float)
        average = np.zeros(len(values))
        for n, leaf in enumerate(ensemble.leaves):
            own = np.flatnonzero(leaf.features == place.get(f, -1))
            inside = (values > leaf.above[own[0]]) & (values <= leaf.upto[own[0]]) if len(own) else np.ones(len(values), bool)
            # A feature the model does not read changes nothing.
            met = found.get((n, wanted.index(place[f]) if f in place else len(wanted)), 0)
            average += inside * leaf.value * met / max(rows, 1)
        out += [(f, i, float(v), float(a)) for i, (v, a) in enumerate(zip(values, average))]
    return df.sparkSession.createDataFrame(out, "feature string, point int, grid_value double, average_prediction double")
