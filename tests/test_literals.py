"""Small tables with known answers."""

import datetime as dt
import json
import shutil

import pytest

from conftest import rows_of
from featherloom.functions import scalars as X
from featherloom.operators import quality as Q
from featherloom.operators import relational as R
from featherloom.operators import timeseries as S
from featherloom.operators import windows as W
from featherloom.params import ParameterError
from featherloom.plans.chain import FeatureChain, StepGraph


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i + 1, v) for i, v in enumerate(values)], "g string, t int, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("g", "t").collect()]


def test_rolling_excludes_current_row_and_needs_full_window(spark):
    df = W.rolling_features(series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), "v", ["g"], ["t"], [3], ["mean", "std", "count", "min"], "x", fillna=False)
    assert column(df, "rolling_mean_v_3_x") == [None, None, None, 2.0, 3.0]
    assert column(df, "rolling_std_v_3_x") == [None, None, None, 1.0, 1.0]
    assert column(df, "rolling_count_v_3_x") == [None, None, None, 3, 3]
    assert column(df, "rolling_min_v_3_x") == [None, None, None, 1.0, 2.0]


def test_rolling_null_in_window(spark):
    df = series(spark, [1.0, 2.0, 3.0, None]).union(series(spark, [9.0], "b"))
    out = W.rolling_features(df, "v", ["g"], ["t"], [2], ["mean"], "x", fillna=False)
    assert column(out, "rolling_mean_v_2_x") == [None, None, 1.5, 2.5, None]


def test_frequency_and_recency(spark):
    assert column(W.frequency(series(spark, [0.0, 1.0, 0.0, 5.0, 0.0]), "t", ["g"], "v"), "frequency") == [0, 0, 1, 1, 2]
    df = series(spark, [0.0, 1.0, 0.0]).union(series(spark, [5.0, 0.0], "b"))
    assert column(W.recency(df, "t", ["g"], "v"), "recency") == [0, 0, 0, 0, 0]


def test_flag_distances(spark):
    df = series(spark, [0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0])
    out = W.flag_distances(df, ["v"], "t")
    assert column(out, "distance_since_previous_v") == [0, 1, 0, 1, 2, 0, 1]
    assert column(out, "distance_until_next_v") == [2, 1, 0, 2, 1, 0, 0]


def test_fills(spark):
    df = series(spark, [None, 1.0, None, None, 4.0, None])
    assert column(W.fill_along(df, {"v": "ffill"}, ["g"], ["t"]), "v") == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert column(W.fill_along(df, {"v": "bfill"}, ["g"], ["t"]), "v") == [1.0, 1.0, 4.0, 4.0, 4.0, None]
    assert column(W.fill_along(df, {"v": "interpolate"}, ["g"], ["t"]), "v") == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_lag_worked_example(spark):
    rows = [("A", f"2021-01-0{i}", i) for i in (1, 2, 3)] + [("B", f"2021-01-0{i}", i + 3) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "product_id string, date string, value int")
    out = W.lag(df, {"value": [1, 2]}, ["date"], ["product_id"]).orderBy("product_id", "date").collect()
    assert [r["value_lag_1"] for r in out] == [0, 1, 2, 0, 4, 5, 6]
    assert [r["value_lag_2"] for r in out] == [0, 0, 1, 0, 0, 4, 5]


def test_drop_na_with_empty_subset(spark):
    df = series(spark, [1.0, None])
    assert R.drop_rows_na(df, [], "any").count() == 2
    assert R.drop_rows_na(df, [], "all").count() == 0


def test_global_aggregate_is_one_row(spark):
    df = spark.createDataFrame([(1, 3), (2, 4)], "B int, C int")
    assert rows_of(R.aggregate(df, [], [("B", "sum", "x"), ("C", "max", "y")])) == [(3, 4)]


def test_aggregate_drops_null_dimension(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "g string, v int")
    assert rows_of(R.aggregate(df, ["g"], [("v", "sum")])) == [("a", 1)]


def test_merge_matches_null_keys_and_keeps_them(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    right = spark.createDataFrame([(None, 5, "z"), (3, 6, "w")], "k int, b int, a string")
    assert rows_of(R.merge(left, right, ["k"], how="outer")) == sorted([(1, "x", None), (None, "y", 5), (3, None, 6)], key=str)


def test_filter_keeps_null_only_for_not_equal(spark):
    df = series(spark, [1.0, None])
    assert R.filter_rows(df, "v", "!=", 1).count() == 1
    assert R.filter_rows(df, "v", "==", 1).count() == 1
    assert R.filter_rows(df, "g", "contains", "^a$").count() == 2


def test_flatten_json_merges_types(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": 2.5}'), (3, None)], "id int, data string")
    out = X.flatten_json(df, "data")
    assert out.columns == ["id", "data.a", "data.b.c"]
    assert rows_of(out) == [(1, 1.0, "x"), (2, 2.5, None), (3, None, None)]


def test_parse_list(spark):
    df = spark.createDataFrame([("['a', 'b']",), ("a , b",), ('["c"]',)], "x string")
    assert [r[0] for r in df.select(X.parse_list(df.x)).collect()] == [["a", "b"], ["a", "b"], ["c"]]


def test_maths_outside_domain_is_null(spark):
    df = spark.createDataFrame([(-4.0,), (0.0,)], "x double")
    assert [r["x_sqrt"] for r in X.maths_transform(df, ["x"], "sqrt").collect()] == [None, 0.0]
    assert [r["x_inverse"] for r in X.maths_transform(df, ["x"], "inverse").collect()] == [-0.25, None]


def test_dense_calendar_starts_per_series(spark):
    d = dt.datetime
    df = spark.createDataFrame([("a", d(2024, 1, 1), 1.0), ("a", d(2024, 1, 3), 2.0), ("b", d(2024, 1, 2), 3.0)], "g string, date timestamp_ntz, v double")
    out = S.add_missing_dates(df, "date", ["g"]).orderBy("g", "date").collect()
    assert [(r["g"], r["date"].day, r["v"]) for r in out] == [("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("b", 2, 3.0), ("b", 3, None)]


def test_cast_raises_on_bad_content(spark):
    df = spark.createDataFrame([("x",)], "v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.cast_types(df, ["v"], "int").collect()


@pytest.mark.parametrize("steps", [
    [{"name": "Nope", "parameters": {}}],
    [{"name": "SelectCols", "parameters": {"cols": ["a"]}}],
    [{"name": "FilterRows", "parameters": {"column": "a"}}],
    [{"name": "Merge", "parameters": {"left_on": ["a"]}}],
])
def test_bad_steps_fail_before_any_job(steps):
    with pytest.raises(ParameterError):
        FeatureChain(steps)


def test_graph_rejects_unknown_source():
    step = {"name": "b", "transformation": {"name": "Sort", "parameters": {"columns": ["x"]}}, "inputs": {"df": "a__output"}}
    with pytest.raises(ParameterError, match="no earlier step"):
        StepGraph([step])


def test_unfitted_chain(spark):
    with pytest.raises(ParameterError, match="not fitted"):
        FeatureChain([{"name": "Sort", "parameters": {"columns": ["v"]}}]).transform(series(spark, [1.0]))


def test_whole_numbers_compare_in_the_type_of_the_column(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740992,)], "id bigint")
    assert R.filter_rows(df, "id", "==", 9007199254740993).count() == 1
    assert R.filter_rows(df, "id", "==", "9007199254740992").count() == 1
    assert R.filter_rows(df, "id", "<", 1e30).count() == 2


@pytest.mark.parametrize("value, kept", [("True", 1), ("true", 1), (True, 1), ("False", 2), (False, 2)])
def test_boolean_values(spark, value, kept):
    df = spark.createDataFrame([(True,), (False,), (False,), (None,)], "b boolean")
    assert R.filter_rows(df, "b", "==", value).count() == kept
    with pytest.raises(ParameterError):
        R.filter_rows(df, "b", "==", 1)


def test_names_with_a_bar(spark):
    df = spark.createDataFrame([(-1,), (2,)], "`a|b` int")
    found = Q.validate_schema(df, [Q.ColumnRule("a|b", "integer", min_value=0)]).where("violations > 0 AND check <> 'null'").collect()
    assert [(r["column"], r["check"], r["violations"]) for r in found] == [("a|b", "min_value", 1)]


def test_saved_chain_holds_its_tables(spark, tmp_path):
    train = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), (None, 4)], "label string, id int")
    chain = FeatureChain([{"name": "OrdinalEncoder", "parameters": {"column": "label"}}]).fit(train)
    expected = sorted(map(str, chain.transform(train).collect()))
    chain.save(spark, str(tmp_path / "one"))
    shutil.copytree(tmp_path / "one", tmp_path / "two")
    loaded = FeatureChain.load(spark, str(tmp_path / "two"))
    assert str(tmp_path / "two") in json.dumps(loaded.states)
    assert sorted(map(str, loaded.transform(train).collect())) == expected
