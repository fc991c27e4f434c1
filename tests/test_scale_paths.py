"""The paths for groups and tables too large for one task, against plain windows and brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows_of
from featherloom.operators import ordered as O
from featherloom.operators import quantiles as QT
from featherloom.operators.profile import kendall_tau
from featherloom.operators.relational import drop_rows_duplicates, merge, qualify
from featherloom.operators.stats import values_at_ranks
from featherloom.operators.windows import rolling_features
from featherloom.session import BROADCAST_ROWS, GROUP_ROWS, small_copy


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows; one time stamp holds many rows."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rng.randint(1, 40)
        rows.append((i, key, rng.randint(0, 5) if i % 4 == 0 else rng.randint(0, 2000), None if i % 11 == 0 else float(rng.randint(0, 90))))
    return spark.createDataFrame(rows, "id bigint, k int, t int, v double").repartition(5)


def both_ways(spark, build, limit="40"):
    expected = rows_of(build())
    spark.conf.set(GROUP_ROWS[0], limit)
    spark.conf.set(BROADCAST_ROWS[0], "2")
    try:
        assert rows_of(build()) == expected
    finally:
        spark.conf.unset(GROUP_ROWS[0])
        spark.conf.unset(BROADCAST_ROWS[0])
    return expected


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "-id"]])
@pytest.mark.parametrize("include", [True, False])
def test_running_values(spark, hot, order, include):
    columns = {"s": ("sum", F.col("id")), "n": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v"))}
    both_ways(spark, lambda: O.running(hot, ["k"], order, columns, include))


def test_running_without_keys(spark, hot):
    rows = both_ways(spark, lambda: O.row_numbers(hot, [], ["t", "id"], "rn"))
    assert sorted(r[-1] for r in rows) == list(range(1, 3001))


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "-id"]])
def test_bounded_frames(spark, hot, order):
    def build(w):
        return {"lag": F.lag("id", 7).over(w), "lead": F.lead("id", 3).over(w), "sum": F.sum("v").over(w.rowsBetween(-9, 4))}

    both_ways(spark, lambda: O.framed(hot, ["k"], order, build, back=9, ahead=4))


def largest_chunk(df, keys, order):
    chunked = O.with_chunks(df, keys, order, df.count())
    return chunked.groupBy(*keys, O.CHUNK).count().agg(F.max("count")).first()[0]


AWKWARD = {
    "common prefix": ("printf('Customer#%09d', id)", ["x"]),
    "narrow range": ("if(k = 0, 500 + id / 1e6, id * 1.0)", ["x"]),
    "one value": ("'same'", ["x", "id"]),
    "two tied columns": ("1", ["x", "k", "id"]),
    "not a number": ("CASE WHEN id % 5 = 0 THEN double('NaN') WHEN id % 7 = 0 THEN NULL ELSE id % 50 * 1.0D END", ["x", "id"]),
    "mixed directions": ("id % 6", ["x", "-id"]),
    "mixed directions, text": ("concat('label ', id % 6)", ["-x", "id"]),
}


@pytest.mark.parametrize("case", AWKWARD)
def test_chunks_are_bounded_and_answers_plain(spark, hot, case):
    value, order = AWKWARD[case]
    df = hot.withColumn("x", F.expr(value))
    columns = {"n": ("count", F.col("v")), "s": ("sum", F.col("id")), "last": ("last", F.col("v"))}

    def frames(w):
        return {"lag": F.lag("id", 70).over(w), "lead": F.lead("id", 70).over(w), "near": F.sum("v").over(w.rowsBetween(-70, 70))}

    plain = [O.running(df, ["k"], order, columns), O.framed(df, ["k"], order, frames, back=70, ahead=70)]
    expected = [sorted(map(str, out.drop("x").collect())) for out in plain]
    spark.conf.set(GROUP_ROWS[0], "100")
    try:
        assert largest_chunk(df, ["k"], order) <= 100
        cut = [O.running(df, ["k"], order, columns), O.framed(df, ["k"], order, frames, back=70, ahead=70)]
        assert [sorted(map(str, out.drop("x").collect())) for out in cut] == expected
    finally:
        spark.conf.unset(GROUP_ROWS[0])


def test_a_frame_receives_as_many_rows_as_it_reaches(spark, hot):
    spark.conf.set(GROUP_ROWS[0], "100")
    try:
        chunked = O.with_chunks(hot, ["k"], ["t", "id"], 3000)
        received = O._halo(chunked, ["k"], 250, True).groupBy("k", O.CHUNK).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset(GROUP_ROWS[0])
    assert received == 250


def test_reach_over_empty_chunks(spark):
    rows = [(1, i if i < 3 else 1000 + i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, t int, v double")
    both_ways(spark, lambda: rolling_features(df, "v", ["g"], ["t"], [20], ["sum"], "x"), "1")


def test_lookup_join_spreads_the_hot_key(spark, hot):
    table = spark.range(0, 30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    both_ways(spark, lambda: O.lookup_join(hot, table, ["k"]))
    both_ways(spark, lambda: O.lookup_join(hot, table, ["k"], "inner"))


@pytest.mark.parametrize("how", ["left", "inner", "right", "outer"])
def test_merge_kinds(spark, hot, how):
    left = hot.groupBy("k").agg(F.count("*").alias("n"))
    right = spark.range(20, 60).select(F.col("id").cast("int").alias("k"), F.col("id").alias("w"))
    rows = both_ways(spark, lambda: merge(left, right, ["k"], how=how))
    keys = {"left": 41, "inner": 21, "right": 40, "outer": 60}
    assert len(rows) == keys[how]


def test_exact_quantiles_narrow_to_percentile(spark, hot):
    probs = [0.0, 0.1, 0.25, 0.5, 0.937, 1.0]
    expected = hot.agg(*[F.percentile(c, probs) for c in ("v", "t", "id")]).first()
    spark.conf.set(GROUP_ROWS[0], "25")
    try:
        found = QT.exact_quantiles(hot, ["v", "t", "id"], probs)
    finally:
        spark.conf.unset(GROUP_ROWS[0])
    for c, e in zip(("v", "t", "id"), expected):
        assert found[c] == pytest.approx(e, abs=1e-9)


def test_grouped_quantiles(spark, hot):
    def build():
        out = QT.grouped_quantiles(hot, ["k"], "v", {"a": 0.3, "b": 0.5})
        return out.select("k", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))

    both_ways(spark, build)


def test_values_at_ranks(spark, hot):
    values = sorted(r[0] for r in hot.where("v IS NOT NULL").select("v").collect())
    ranks = [0, 1, 5, 700, 701, len(values) - 1]
    df = spark.createDataFrame([(r,) for r in ranks], "rank bigint")
    expected = sorted(((r, values[r]) for r in ranks), key=str)
    assert both_ways(spark, lambda: values_at_ranks(hot, "v", df)) == expected


@pytest.mark.parametrize("limit", ["2000000", "10"])
def test_kendall_against_all_pairs(spark, limit):
    rng = random.Random(3)
    points = [(rng.randint(0, 12), rng.randint(0, 30)) for _ in range(120)]
    c = d = tx = ty = 0
    for (x1, y1), (x2, y2) in combinations(points, 2):
        s = (x1 - x2) * (y1 - y2)
        c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (x1 == x2), ty + (y1 == y2)
    n = 120 * 119 / 2
    spark.conf.set(GROUP_ROWS[0], limit)
    try:
        found = kendall_tau(spark.createDataFrame(points, "a int, b int"), "a", "b")
    finally:
        spark.conf.unset(GROUP_ROWS[0])
    assert found == pytest.approx((c - d) / ((n - tx) * (n - ty)) ** 0.5, abs=1e-12)


def test_duplicates_and_latest_rows_limit_groups_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    for out in (drop_rows_duplicates(df, ["l_suppkey"], "last", ["l_shipdate", "l_orderkey", "l_linenumber"]), qualify(df, ["l_suppkey"], ["l_shipdate", "l_orderkey"], target=3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_small_copy_checks_rows_and_bytes(spark):
    assert small_copy(spark.range(10)) is not None
    spark.conf.set(BROADCAST_ROWS[0], "5")
    try:
        assert small_copy(spark.range(10)) is None
    finally:
        spark.conf.unset(BROADCAST_ROWS[0])
    spark.conf.set("spark.featherloom.broadcastByteLimit", "100")
    try:
        assert small_copy(spark.range(3).select(F.repeat(F.lit("x"), 500).alias("s"))) is None
    finally:
        spark.conf.unset("spark.featherloom.broadcastByteLimit")


@pytest.mark.parametrize("parts", [1, 7])
def test_answers_do_not_depend_on_partitioning(spark, hot, parts):
    def build(df):
        return O.framed(O.row_numbers(df, ["k"], ["t", "id"], "rn"), ["k"], ["t", "id"], lambda w: {"p": F.lag("v", 2).over(w)}, back=2)

    assert rows_of(build(hot.repartition(parts))) == rows_of(build(hot))


def test_wide_rows_do_not_reach_the_driver(spark):
    from featherloom import session

    wide = spark.range(1000).select("id", F.repeat(F.lit("x"), 10_000).alias("s"), F.array(F.lit("y")).alias("a"))
    spark.conf.set("spark.featherloom.broadcastByteLimit", "50000")
    try:
        assert session.small_copy(wide) is None
        assert session.small_copy(wide.limit(2)).count() == 2
    finally:
        spark.conf.unset("spark.featherloom.broadcastByteLimit")
