"""Every registered query against its SQL twin, and the large-group paths against the same answers."""

import math

import pytest

import __spark_entry__ as entry
from conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()
ORDERED = [
    "w1_lag", "w2_rolling", "w3_cumulative_month", "w5_series_age", "w6_recency", "w7_frequency", "w8_flag_distances", "w9_fill_forward_backward", "w10_interpolate",
    "w13_pareto", "w14_average_rank", "w15_moving_average", "w17_percentile_of_value", "a1_aggregate", "a6_profile_numeric", "a11_correlation_kendall", "a13_distribution",
    "b2_k_fold", "b3_stratified_k_fold", "b14_roc_summary", "b10_d2_pinball_by_group", "e8_fill_group_statistics", "f7_outliers_iqr", "h4_mann_whitney", "h6_kruskal",
    "h6_group_medians", "h17_holm", "h17_fdr", "j4_segment_filter", "q7_drift_numeric", "h11_ci_median",
]


def plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else v if isinstance(v, float) else str(v)


def answers(columns, rows):
    order = sorted(columns)
    table = [tuple(plain(r[columns.index(c)]) for c in order) for r in rows]
    return order, sorted(table, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))


def close(a, b):
    """Equal, or floats a rounding tie apart."""
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1.1e-4 * max(1.0, abs(a) * 1e-4)
    return a == b


def same(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns, found = answers(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    wanted_columns, wanted = answers([d[0] for d in result.description], result.fetchall())
    assert columns == wanted_columns
    assert len(found) == len(wanted)
    for mine, theirs in zip(found, wanted):
        assert all(close(x, y) for x, y in zip(mine, theirs)), (mine, theirs)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, duck, name):
    same(spark, duck, name)


@pytest.mark.parametrize("name", ORDERED)
def test_large_group_path(large_paths, duck, name):
    same(large_paths, duck, name)


@pytest.mark.parametrize("name", [
    "flagship_daily_features", "j5_add_missing_dates", "j6_add_inference_dates", "b4_series_holdout_months", "b19_test_period_forecast", "f11_select_dates", "m1_monitor_stream",
])
def test_session_zone_does_not_matter(spark, duck, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        same(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["date", "event_type", "value", "value_lag_1", "value_lag_7", "rolling_mean_value_7_week"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
