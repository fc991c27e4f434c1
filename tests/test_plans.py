"""What reaches the scan, what is shuffled, and where state is kept."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows_of
from featherloom.operators import relational as R
from featherloom.operators import timeseries as S
from featherloom.operators import windows as W
from featherloom.operators.profile import profile_text
from featherloom.plans import models as ML
from featherloom.plans.chain import FeatureChain
from featherloom.session import materialise, shared_dir
from featherloom.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.mark.parametrize("build, pushed", [
    (lambda t: files.fetch_table(t, {"o_orderstatus": "F"}), "EqualTo(o_orderstatus,F)"),
    (lambda t: files.scan_members(t, "o_orderstatus", ["F", "P"], ["o_orderkey"]), "In(o_orderstatus"),
    (lambda t: R.training_cutoff(t, "o_orderdate", "1999-12-31"), "LessThanOrEqual(o_orderdate"),
    (lambda t: R.filter_rows(t, "o_totalprice", ">", 5), "GreaterThan(o_totalprice,5.0)"),
    (lambda t: R.select_values(t, {"o_orderstatus": ["F"]}), "EqualTo(o_orderstatus,F)"),
])
def test_filters_reach_the_scan(spark, build, pushed):
    assert pushed in plan(build(table(spark, "orders")))


def test_only_used_columns_are_read(spark):
    df = R.aggregate(table(spark, "lineitem"), ["l_returnflag"], [("l_quantity", "sum")])
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan(df)


def test_windows_of_one_series_share_one_shuffle(spark):
    df = table(spark, "events").select("event_id", "event_type", "ts", "value")
    out = W.lag(df, {"value": [1, 7]}, ["ts", "event_id"], ["event_type"])
    out = W.rolling_features(out, "value", ["event_type"], ["ts", "event_id"], [7, 14], ["mean", "max"], "x")
    out = W.frequency(out, "ts", ["event_type"], "value", order_by=["event_id"])
    assert plan(out).count("Exchange hashpartitioning") == 1


def test_dense_calendar_needs_no_cross_join(spark):
    df = S.prepare_timeseries(table(spark, "events"), "ts", ["event_type"], "value")
    text = plan(S.add_missing_dates(df, "ts", ["event_type"]))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_long_texts_are_not_shuffled_for_unique_counts(spark):
    text = plan(profile_text(table(spark, "documents"), ["text"]))
    assert "sha2" in text


def test_materialise_reads_back_from_the_shared_folder(spark):
    df = table(spark, "orders").where("o_orderkey % 2 = 0")
    out = materialise(df)
    assert shared_dir(spark) in out.inputFiles()[0]
    assert rows_of(out) == rows_of(df)


def test_chain_spills_before_fitted_steps(spark):
    steps = [
        {"name": "Lag", "parameters": {"lags": {"value": [1]}, "columns_to_order_by": ["ts", "event_id"], "columns_to_partition_by": ["event_type"]}},
        {"name": "ScalingNumerical", "parameters": {"columns": ["value_lag_1"], "method": "standard"}},
    ]
    df = table(spark, "events")
    spilled, direct = FeatureChain(steps).fit_transform(df, spill=True), FeatureChain(steps).fit_transform(df)
    assert rows_of(spilled.select("event_id", F.round("value_lag_1", 6))) == rows_of(direct.select("event_id", F.round("value_lag_1", 6)))
    assert "Exchange hashpartitioning" not in plan(spilled)


def test_csv_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "a int, b double")
    back = files.load_csv(spark, files.store_csv(df, "nan"), schema="a int, b double")
    assert rows_of(back) == [(1, None), (2, 1.5)]


def test_rows_of_one_file_are_dealt_to_fit(spark, tmp_path):
    spark.range(25_000).select((F.col("id") % 3).alias("y"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    dealt = [ML._dealt(table).rdd.glom().collect() for _ in range(2)]
    assert [len(p) for p in dealt[0]] == [8334, 8333, 8333] and dealt[0] == dealt[1]
    assert sorted(map(str, sum(dealt[0], []))) == sorted(map(str, table.collect()))
    assert ML._dealt(table.limit(10)).count() == 10
