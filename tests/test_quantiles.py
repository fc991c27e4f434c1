"""Quantiles of many groups and columns against Spark's own exact percentile, with sketches that miss as well."""

import random

import pytest
from pyspark.sql import functions as F

from featherloom.operators import quantiles as QT
from featherloom.operators import relational as R
from featherloom.session import GROUP_ROWS


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(6000):
        g = rng.choice(["hot"] * 6 + [None] + [f"g{k}" for k in range(12)])
        heavy = rng.choice([0.0, 0.0, 0.0, 1.5, 7.0])
        data.append((i, g, i % 3, None if rng.random() < 0.1 or g == "g3" else rng.gauss(0, 10), heavy, rng.randrange(10**9)))
    return spark.createDataFrame(data, "id int, g string, h int, v double, heavy double, whole long").repartition(4)


WANTED = {"a": ("v", 0.5), "b": ("v", 0.013), "c": ("heavy", 0.5), "d": ("heavy", 0.81), "e": ("whole", 0.25), "f": ("whole", 1.0), "g0": ("v", 0.0)}


def close(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a[:2] == b[:2]
        assert list(a[2:]) == pytest.approx(list(b[2:]), abs=1e-9, nan_ok=True)


def in_order(df):
    return [tuple(float("nan") if v is None and i > 1 else v for i, v in enumerate(r)) for r in df.orderBy(F.col("g").asc_nulls_first(), "h").collect()]


@pytest.mark.parametrize("limit", ["2000000", "5"])
@pytest.mark.parametrize("width", [2e-4, 0.02])
def test_groups(spark, rows, limit, width):
    want = rows.groupBy("g", "h").agg(*[F.percentile(c, p).alias(n) for n, (c, p) in WANTED.items()])
    spark.conf.set(GROUP_ROWS[0], limit)
    try:
        close(in_order(QT.group_quantiles(rows, ["g", "h"], WANTED, width)), in_order(want))
    finally:
        spark.conf.unset(GROUP_ROWS[0])


@pytest.mark.parametrize("limit", ["2000000", "5"])
def test_sketch_that_misses_is_widened(spark, rows, limit, monkeypatch):
    """With an accuracy of 5 the sketch is off by far more than the bracket is wide."""
    monkeypatch.setattr(QT, "_ACCURACY", 5)
    spark.conf.set(GROUP_ROWS[0], limit)
    try:
        found = QT._whole(rows, {("v", 0.5), ("whole", 0.3), ("heavy", 0.9)}, 1e-4)
        want = rows.agg(F.percentile("v", 0.5), F.percentile("whole", 0.3), F.percentile("heavy", 0.9)).first()
        assert [found["v", 0.5], found["whole", 0.3], found["heavy", 0.9]] == pytest.approx(list(want))
        grouped = QT.group_quantiles(rows, ["h"], {"m": ("v", 0.5)}, 1e-4).orderBy("h").collect()
        assert [r["m"] for r in grouped] == pytest.approx([r[1] for r in rows.groupBy("h").agg(F.percentile("v", 0.5)).orderBy("h").collect()])
    finally:
        spark.conf.unset(GROUP_ROWS[0])


def test_whole_columns_and_nothing(spark, rows):
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    want = rows.agg(*[F.percentile(c, probs) for c in ("v", "heavy", "whole")]).first()
    found = QT.exact_quantiles(rows, ["v", "heavy", "whole"], probs)
    for c, w in zip(("v", "heavy", "whole"), want):
        assert found[c] == pytest.approx(w)
    empty = rows.where("id < 0")
    assert QT.exact_quantiles(empty, ["v"], [0.5]) == {"v": [None]} and QT.exact_quantiles(rows, [], [0.5]) == {}
    assert QT.group_quantiles(empty, ["g"], {"m": ("v", 0.5)}).count() == 0


def test_any_number_of_medians_takes_the_same_jobs(spark, rows):
    wide = rows.select("g", *[(F.col("v") + i).alias(f"c{i}") for i in range(12)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        group = f"medians {n}"
        spark.sparkContext.setJobGroup(group, group)
        R.aggregate(wide, ["g"], [(f"c{i}", "median") for i in range(n)]).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(1) == jobs(12)
