"""Shapley values and dependence against enumeration of all subsets and of all rows."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.plans import explain as Z
from featherloom.plans import models as ML
from featherloom.plans import trees

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for k in range(160):
        x = [rng.randrange(4), rng.gauss(0, 1), rng.gauss(0, 1), rng.random(), rng.randrange(2), rng.gauss(5, 2)]
        y = x[0] * x[1] + 3 * x[4] * (x[5] > 5) + abs(x[2]) - x[3] + rng.gauss(0, 0.1)
        data.append((k, *[None if rng.random() < 0.03 else float(v) for v in x], y))
    return spark.createDataFrame(data, "k int, " + ", ".join(f"{f} double" for f in NAMES) + ", y double")


def by_subsets(worth, n):
    out = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        out.append(sum(factorial(r) * factorial(n - 1 - r) / factorial(n) * (worth(frozenset(s) | {i}) - worth(frozenset(s))) for r in range(n) for s in combinations(others, r)))
    return out


def expectation(tree, row, known, node=0):
    """Of one tree by recursion: splits on unknown features are taken in the training rows' shares."""
    r = tree[node]
    if r["leftChild"] < 0:
        return r["prediction"]
    f, cut = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
    if f in known:
        return expectation(tree, row, known, r["leftChild"] if row[f] <= cut else r["rightChild"])
    return sum(tree[c]["impurityStats"][0] / r["impurityStats"][0] * expectation(tree, row, known, c) for c in (r["leftChild"], r["rightChild"]))


@pytest.mark.parametrize("kind, parameters", [("decision_tree", {"max_depth": 5}), ("random_forest", {"n_estimators": 4, "max_depth": 4}), ("gradient_boosting", {"n_estimators": 4, "max_depth": 3})])
def test_tree_values_equal_enumeration(spark, rows, tmp_path, kind, parameters):
    model = ML.fit_model(rows, kind, "y", NAMES, parameters)
    got = {(r["k"], r["feature"]): r["shapley_value"] for r in Z.shapley_values(rows, model.predict, NAMES, ["k"]).collect()}
    core = model.model.stages[-1]
    core.write().save(str(tmp_path / "m"))
    nodes = spark.read.parquet(str(tmp_path / "m/data"))
    flat = nodes.select(F.lit(0).alias("t"), "*") if kind == "decision_tree" else nodes.select(F.col("treeID").alias("t"), "nodeData.*")
    tables = {}
    for r in flat.collect():
        tables.setdefault(r["t"], {})[r["id"]] = r
    weights = [1.0] if kind == "decision_tree" else [w / (len(tables) if kind == "random_forest" else 1) for w in core.treeWeights]
    predicted = {r["k"]: r for r in model.predict(rows).collect()}
    base = trees.read_ensemble(rows, model.predict).base
    assert len(got) == 160 * 6
    for k in range(0, 160, 16):
        row = [predicted[k][f] or 0.0 for f in NAMES]
        want = by_subsets(lambda s: sum(w * expectation(tables[t], row, s) for t, w in enumerate(weights)), 6)
        assert [got[k, f] for f in NAMES] == pytest.approx(want, abs=1e-9)
        assert sum(want) + base == pytest.approx(predicted[k]["prediction"], abs=1e-9)


def bumpy(df):
    a, b, c, d, e, f = (F.coalesce(F.col(x), F.lit(0.0)) for x in NAMES)
    return df.withColumn("prediction", a * b + F.abs(c) * e - F.exp(d) * f)


def bumpy_at(x):
    return x[0] * x[1] + abs(x[2]) * x[4] - np.exp(x[3]) * x[5]


def test_kernel_values_equal_enumeration(rows):
    full = rows.dropna()
    got = {(r["k"], r["feature"]): r["shapley_value"] for r in Z.shapley_values(full, bumpy, NAMES, ["k"]).collect()}
    data = {r["k"]: [r[f] for f in NAMES] for r in full.collect()}
    mean = np.mean(list(data.values()), axis=0)
    for k in sorted(data)[::25]:
        want = by_subsets(lambda s: bumpy_at([data[k][i] if i in s else mean[i] for i in range(6)]), 6)
        assert [got[k, f] for f in NAMES] == pytest.approx(want, abs=1e-8)


def test_drawn_coalitions_keep_the_total_and_are_near():
    rng = np.random.default_rng(2)
    table, weights = Z.coalitions(11, 500, 1)
    assert len(table) < 520
    w, v = rng.normal(size=11), rng.normal(size=11)
    worth = table @ w + 0.2 * (table @ v) ** 2
    exact_table, exact = Z.coalitions(11, 2**11, 1)
    want = exact @ (exact_table @ w + 0.2 * (exact_table @ v) ** 2)
    got = weights @ worth
    assert got.sum() == pytest.approx(worth[1] - worth[0])
    assert np.abs(got - want).max() < 0.1 * np.abs(want).max()
    assert Z.coalitions(1, 256, 1)[1].tolist() == [[-1.0, 1.0]]


def brute_dependence(predict, rows, feature, grid):
    return [predict(rows.withColumn(feature, F.lit(float(v)))).agg(F.avg("prediction")).first()[0] for v in grid]


@pytest.mark.parametrize("kind", ["decision_tree", "gradient_boosting", "linear_regression", "function"])
def test_dependence_equals_setting_the_feature(rows, kind):
    predict = bumpy if kind == "function" else ML.fit_model(rows, kind, "y", NAMES[:5], {"n_estimators": 5} if kind == "gradient_boosting" else {}).predict
    got = Z.partial_dependence(rows, predict, NAMES, grid_resolution=7, reads=NAMES if kind == "function" else None).collect()
    assert {r["feature"] for r in got} == set(NAMES)
    for f in NAMES:
        mine = sorted((r["point"], r["grid_value"], r["average_prediction"]) for r in got if r["feature"] == f)
        assert len(mine) == {"f0": 4, "f4": 2}.get(f, 7)
        if f in ("f0", "f2", "f5"):
            assert [m[2] for m in mine] == pytest.approx(brute_dependence(predict, rows, f, [m[1] for m in mine]), abs=1e-9)


def test_tree_explanations_copy_no_rows(rows):
    model = ML.fit_model(rows, "decision_tree", "y", NAMES, {"max_depth": 4})
    text = Z.shapley_values(rows, model.predict, NAMES, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("Generate") == 1  # the one generator spreads the finished values


def test_tree_values_work_out_each_cell_once(monkeypatch):
    leaves = [trees.Leaf(2.0, np.array([0, 1]), np.array([-np.inf, 1.0]), np.array([0.5, np.inf]), np.array([0.25, 0.5])), trees.Leaf(-1.0, np.array([1]), np.array([-np.inf]), np.array([1.0]), np.array([0.5]))]
    ensemble = trees.Ensemble(["a", "b", "c"], leaves)
    table = np.random.default_rng(3).normal(0.5, 1, (5000, 3))
    table[:4] = [[0.5, 1.0, 0], [0.5, 1.5, 0], [np.nan, 2, 0], [0, np.nan, 0]]
    seen, holds = [], trees._holds
    monkeypatch.setattr(trees, "_holds", lambda leaf, rows: seen.append(len(rows)) or holds(leaf, rows))
    got = trees.shapley(ensemble, table)
    assert max(seen) <= 16  # and not 5,000 rows a leaf
    for row, values in list(zip(table, got))[:40]:
        inside = [leaf.value * np.prod([float(row[f] > lo and row[f] <= hi) if f in known else share for f, lo, hi, share in zip(leaf.features, leaf.above, leaf.upto, leaf.share)]) for known in ((), (0,), (1,), (0, 1)) for leaf in leaves]
        none, a, b, both = (sum(inside[k: k + 2]) for k in (0, 2, 4, 6))
        assert values == pytest.approx([(a - none + both - b) / 2, (b - none + both - a) / 2, 0.0])
