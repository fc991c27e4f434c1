"""Backtests and searches from sums per date, against fits of each fold on its own rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.plans import forecast as B
from featherloom.plans import gram
from featherloom.plans import models as ML
from featherloom.plans import splitters as P
from featherloom.session import shared_dir

FOLDS = {"input_steps": 8, "forecast_horizon": 3, "stride": 4}


def series(spark, days=24, per_day=7):
    rng = random.Random(3)
    rows = []
    for d in range(days):
        for k in range(per_day):
            x, z = rng.gauss(1000, 3), rng.gauss(-2, 1)
            y = None if rng.random() < 0.05 else 3 * x - 2 * z + 0.1 * d + rng.gauss(0, 1)
            rows.append((f"2024-01-01T{0:02d}:00:00", d, k, None if rng.random() < 0.05 else x, z, z * 2, y))
    df = spark.createDataFrame(rows, "start string, d int, k int, x double, z double, twin double, y double")
    return df.withColumn("date", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("d"))).drop("start", "d")


def by_fold(df, model, features, parameters, **folds):
    """Scores of every fold fitted on its own rows."""
    placed = P.backtest_folds(df, "date", **folds).cache()
    out = {}
    for fold in range(placed.agg(F.max("fold")).first()[0] + 1):
        rows = placed.where(F.col("fold") == fold)
        found = ML.fit_model(rows.where("split = 'train'"), model, "y", features, parameters).predict(rows)
        for r in B.regression_metrics(found, "y", "prediction", ["fold", "split"]).collect():
            out[r["fold"], r["split"]] = (r["n"], r["rmse"], r["mae"])
    return out


@pytest.mark.parametrize("model, features, parameters", [
    ("linear_regression", ["x", "z"], {}), ("linear_regression", ["z"], {"fit_intercept": False}), ("lasso", ["x", "z"], {"alpha": 0.3}),
    ("elastic_net", ["x", "z"], {"alpha": 0.2, "l1_ratio": 0.7}), ("huber", ["x", "z"], {}), ("decision_tree", ["x", "z"], {"max_depth": 3}),
])
def test_backtest_equals_fits_of_each_fold(spark, model, features, parameters):
    expanding, ascending = model in ("linear_regression", "huber"), model not in ("lasso", "huber")
    df = series(spark, 16)
    folds = FOLDS | {"expanding_window": expanding, "ascending": ascending}
    _, scores, predictions = B.backtest(df, model, "y", features, "date", ["k"], folds, parameters, refit=False)
    got = {(r["fold"], r["split"]): (r["n"], r["rmse"], r["mae"]) for r in scores.collect()}
    want = by_fold(df, model, features, parameters, **folds)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == want[key][0]
        assert got[key][1:] == pytest.approx(want[key][1:], rel=2e-4 if model in ("lasso", "elastic_net") else 1e-6)
    assert predictions.count() == P.backtest_folds(df, "date", **folds).count()


def test_columns_that_repeat_each_other(spark):
    df = series(spark)
    _, scores, _ = B.backtest(df, "linear_regression", "y", ["x", "z", "twin"], "date", ["k"], FOLDS, refit=False)
    _, alone, _ = B.backtest(df, "linear_regression", "y", ["x", "z"], "date", ["k"], FOLDS, refit=False)
    for a, b in zip(scores.orderBy("fold", "split").collect(), alone.orderBy("fold", "split").collect()):
        assert a["rmse"] == pytest.approx(b["rmse"], rel=1e-9)


def written(spark, run):
    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_dir(spark)) for f in names if f.endswith(".parquet"))

    before = size()
    run()
    return size() - before


@pytest.mark.parametrize("model", ["linear_regression", "decision_tree"])
def test_bytes_written_do_not_grow_with_folds(spark, model):
    df = series(spark, 40, 40)

    def run(stride):
        return written(spark, lambda: B.backtest(df, model, "y", ["x", "z"], "date", ["k"], {"input_steps": 12, "forecast_horizon": 2, "stride": stride}, {}, refit=False)[1].collect())

    few, many = run(13), run(1)
    assert many < few * 2  # 3 and 27 folds; copies would be 9 times the bytes


def test_search_of_linear_models_reads_the_rows_a_fixed_number_of_times(spark):
    df = series(spark)
    trials = [{"parameters": {"alpha": a}, "features": f} for a in (0.1, 1.0, 5.0) for f in (["x"], ["x", "z"])]
    found = {r["trial"]: r["value"] for r in B.search(df, "lasso", "y", ["x", "z"], "date", ["k"], FOLDS, trials=trials, last_folds=2).collect()}
    clean = df.select("date", "k", "x", "z", "y").dropna()
    for i, t in enumerate(trials):
        _, scores, _ = B.backtest(clean, "lasso", "y", t["features"], "date", ["k"], FOLDS, t["parameters"], refit=False)
        values = [r["rmse"] for r in scores.where("split = 'validation'").orderBy("fold").collect()][-2:]
        assert found[i] == pytest.approx(np.mean(values), rel=1e-9)
    tracker = spark.sparkContext.statusTracker()

    def jobs(n, group):
        spark.sparkContext.setJobGroup(group, group)
        B.search(df, "lasso", "y", ["x", "z"], "date", ["k"], FOLDS, trials=trials[:n]).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(2, "two trials") == jobs(6, "six trials")


def test_solve_against_normal_equations():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)) * [1, 100, 0.01] + [5, -2000, 3], rng.normal(size=60)
    table = np.column_stack([np.ones(60), x, y])
    centre, scale = table[:, 1:].mean(0) + 0.5, table[:, 1:].std(0)
    own = np.column_stack([np.ones(60), (table[:, 1:] - centre) / scale])
    got = gram.solve(own.T @ own, ["a", "b", "c"], "y", gram.Trial.of("linear_regression", ["a", "c"]), centre, scale)
    want = np.linalg.lstsq(table[:, [0, 1, 3]], y, rcond=None)[0]
    assert [got[0], got[1][0], got[1][2]] == pytest.approx(want.tolist(), rel=1e-8) and got[1][1] == 0
    assert gram.solve(np.zeros((5, 5)), ["a", "b", "c"], "y", gram.Trial.of("lasso", ["a"]), centre, scale) is None
