"""Tails against published tables, tests against worked numbers, random operators against their invariants."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from featherloom.functions import tails as T
from featherloom.operators import encoders as E
from featherloom.operators import quality as Q
from featherloom.operators import stats as H
from featherloom.plans import explain as Z
from featherloom.plans import models as ML
from featherloom.plans import splitters as P


@pytest.mark.parametrize("found, expected", [
    (2 * T.t_sf_value(2.228138852, 10), 0.05), (T.t_ppf_value(0.975, 10), 2.228138852), (T.t_ppf_value(0.975, 1), 12.7062047), (T.t_ppf_value(0.025, 30), -2.042272456),
    (T.chi2_sf_value(3.841458821, 1), 0.05), (T.chi2_ppf_value(0.95, 10), 18.307038053), (T.chi2_ppf_value(0.025, 10), 3.246972780), (T.f_sf_value(4.964602744, 1, 10), 0.05),
    (T.f_sf_value(3.325834530, 5, 10), 0.05), (T.normal_sf_value(1.959963985), 0.025), (T.normal_ppf_value(0.8), 0.8416212336), (T.beta_inc(2, 3, 0.4), 0.5248),
    (T.ks_two_sample_value(0.6, 10, 10, "exact"), 2 * 4845 / 184756), (T.ks_two_sample_value(1.0, 3, 3, "exact"), 0.1), (T.ks_two_sample_value(1.0, 3, 2, "exact"), 0.2),
])
def test_tails(found, expected):
    assert found == pytest.approx(expected, rel=2e-8)


def test_exact_ks_tail_by_counting_paths():
    n1, n2, d = 5, 4, 0.55
    hits = total = 0
    for chosen in combinations(range(n1 + n2), n1):
        i = j = 0
        gap = 0.0
        for step in range(n1 + n2):
            i, j = (i + 1, j) if step in chosen else (i, j + 1)
            gap = max(gap, abs(i / n1 - j / n2))
        hits, total = hits + (gap >= d), total + 1
    assert T.ks_two_sample_value(d, n1, n2, "exact") == pytest.approx(hits / total)


def test_exact_ks_tail_approaches_the_series():
    exact, series = T.ks_two_sample_value(0.03, 10_000, 10_000, "exact"), T.ks_two_sample_value(0.03, 10_000, 10_000)
    assert exact == pytest.approx(series, rel=0.03)


def columns(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "a double, b double")


A, B = [1.0, 2.0, 3.0, 4.0, 5.0, 9.0], [3.0, 4.0, 6.0, 8.0, 10.0, 12.0]


def test_t_test(spark):
    # means 4 and 43/6, variances 8 and 73/6: pooled variance 121/12, standard error 11/6
    r = H.t_test(columns(spark, A, B), "a", "b").first()
    assert (r["statistic"], r["dof"]) == (pytest.approx(-19 / 11), 10)
    assert r["p_value"] == pytest.approx(2 * T.t_sf_value(abs(r["statistic"]), 10))
    less = H.t_test(columns(spark, A, B), "a", "b", "less").first()["p_value"]
    assert less == pytest.approx(r["p_value"] / 2)


def test_rank_tests(spark):
    df = columns(spark, A, B)
    # ranks of A in the pooled sample: 1, 2, 3.5, 5.5, 7, 10
    r = H.mann_whitney(df, "a", "b").first()
    assert r["statistic"] == 29.0 - 21.0
    w = H.wilcoxon(df, "a", "b").first()
    assert (w["statistic"], w["n_pairs"], w["w_minus"]) == (0.0, 6, 21.0)
    groups = df.select(F.lit("a").alias("g"), F.col("a").alias("v")).union(df.select(F.lit("b"), "b"))
    k = H.kruskal(groups, "v", "g").first()
    total, r1 = 12, 29.0
    h = 12 / (total * 13) * (r1**2 / 6 + (78 - r1) ** 2 / 6) - 39
    assert k["statistic"] == pytest.approx(h / (1 - (6 + 6) / (total**3 - total)))


def test_anova_of_two_groups_is_t_squared(spark):
    df = columns(spark, A, B)
    groups = df.select(F.lit("a").alias("g"), F.col("a").alias("v")).union(df.select(F.lit("b"), "b"))
    r, t = H.anova(groups, "v", "g").first(), H.t_test(df, "a", "b").first()
    assert r["statistic"] == pytest.approx(t["statistic"] ** 2)
    assert r["p_value"] == pytest.approx(t["p_value"])


def test_intervals(spark):
    df = columns(spark, A, B)
    m = H.ci_mean(df, "a").first()
    assert m["upper"] - m["estimate"] == pytest.approx(2.570581836 * m["standard_error"], rel=1e-8)
    s = H.ci_std(df, "a").first()
    assert (s["lower"], s["upper"]) == (pytest.approx(s["estimate"] * (5 / 12.832501994) ** 0.5), pytest.approx(s["estimate"] * (5 / 0.831211613) ** 0.5))
    p = H.ci_proportion(spark.createDataFrame([(1,)] * 8 + [(0,)] * 2, "x int"), "x").first()
    assert (p["lower"], p["upper"]) == (pytest.approx(0.4901625, abs=1e-6), pytest.approx(0.9433178, abs=1e-6))


def test_one_sample_and_proportion(spark):
    r = H.one_sample_t(columns(spark, A, B), "a", 4.0).first()
    assert (r["statistic"], r["p_value"], r["effect"]) == (0.0, 1.0, "negligible")
    z = H.one_proportion_z(spark.createDataFrame([(1,)] * 60 + [(0,)] * 40, "x int"), "x", 0.5).first()
    assert (z["statistic"], z["p_value"]) == (pytest.approx(2.0), pytest.approx(0.0455002639, rel=1e-7))


def test_ab_binary_interval(spark):
    rows = [("c", 1)] * 30 + [("c", 0)] * 70 + [("t", 1)] * 45 + [("t", 0)] * 55
    r = H.ab_test_binary(spark.createDataFrame(rows, "g string, x int"), "g", "x", "c", "t").first()
    assert r["difference"] == pytest.approx(0.15)
    assert r["statistic"] == pytest.approx(0.15 / (0.375 * 0.625 * 0.02) ** 0.5)
    assert r["ci_lower"] < 0.15 < r["ci_upper"]


def test_chi_square_with_empty_cell(spark):
    rows = [("a", "x")] * 10 + [("b", "y")] * 5 + [("b", "x")] * 5 + [("c", "y")] * 10
    r = H.chi_square_independence(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    assert (r["statistic"], r["dof"]) == (pytest.approx(20.0), 2)


@pytest.mark.parametrize("n", [201, 200])
def test_bootstrap_median_interval(spark, n):
    df = spark.range(n).select((F.col("id") * 1.0).alias("x"))
    r = H.ci_median(df, "x").first()
    width = 1.96 * n**0.5  # the median's rank has standard deviation sqrt(n) / 2
    assert r["estimate"] == (n - 1) / 2
    assert r["lower"] == pytest.approx(r["estimate"] - width / 2, abs=3.5)
    assert r["upper"] == pytest.approx(r["estimate"] + width / 2, abs=3.5)
    assert H.ci_median(df, "x").first() == r


def test_categorical_drift_with_a_new_category(spark):
    ref = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10, "c string")
    cur = spark.createDataFrame([("a",)] * 4 + [("d",)] * 1, "c string")
    r = Q.drift_categorical(ref, cur, "c").first()
    assert (r["new_categories"], r["missing_categories"], r["p_value"]) == (1, 1, 0.0)


def test_isolation_finds_the_far_value(spark):
    df = spark.range(400).select(F.when(F.col("id") == 7, 1e6).otherwise(F.col("id") % 50).cast("double").alias("x"))
    out = Q.outliers_isolation(df, "x", 0.01)
    assert [r["x"] for r in out.where("is_outlier").collect()][:1] == [1e6]
    assert out.count() == 400


def test_box_cox_of_log_normal_is_log(spark):
    df = spark.range(4000).select(F.exp(F.randn(5)).alias("x"))
    assert abs(E.fit_scaling(df, ["x"], "box-cox")["x"]["lambda"]) < 0.05


def test_box_cox_leaves_out_what_is_not_positive(spark):
    df = spark.range(600).select("id", F.exp(F.sin(F.col("id"))).alias("x"))
    odd = df.unionByName(spark.createDataFrame([(1000, 0.0), (1001, -2.0), (1002, None)], "id long, x double"))
    state = E.fit_scaling(odd, ["x"], "box-cox")
    assert state["x"] == pytest.approx(E.fit_scaling(df, ["x"], "box-cox")["x"])
    scaled = E.apply_scaling(odd, state)
    assert [r["x"] for r in scaled.where("id >= 1000").collect()] == [None, None, None]
    assert scaled.where("id < 1000 AND x IS NOT NULL").count() == 600
    with pytest.raises(ValueError):
        E.fit_scaling(odd.where("id >= 1000"), ["x"], "box-cox")


def test_one_hot_unknown_rare_and_null(spark):
    train = spark.createDataFrame([("a",)] * 6 + [("b",)] * 5 + [("r",)] + [(None,)] * 3, "c string")
    state = E.fit_one_hot(train, "c", 0.2)
    new = spark.createDataFrame([("a",), ("r",), ("z",), (None,)], "c string")
    out = [tuple(r)[1:] for r in E.apply_one_hot(new, state).collect()]
    assert E.apply_one_hot(new, state).columns[1:] == ["c_a", "c_b", "c_None", "c_infrequent_sklearn"]
    assert out == [(1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)]


def test_ward_groups(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") + 0.1).alias("b"), (100.0 - F.col("id")).alias("c"), (100.2 - F.col("id")).alias("d"))
    assert E.fit_agglomeration(df, ["a", "b", "c", "d"], 2)["clusters"] == [["a", "b"], ["c", "d"]]


def test_pca_wide_and_narrow_agree(spark, monkeypatch):
    df = spark.range(300).select(*[(F.rand(i) * (i + 1)).alias(f"x{i}") for i in range(20)])
    names = [f"x{i}" for i in range(20)]
    _, mean, cov = E.column_moments(df, names)
    _, mean2, cov2 = E.column_moments(df, names[:19])
    assert mean[:19] == pytest.approx(mean2)
    assert cov[:19, :19].ravel() == pytest.approx(cov2.ravel(), abs=1e-9)


def test_folds_are_even_and_stable(spark):
    df = spark.range(103)
    sizes = [r["count"] for r in P.k_fold(df, ["id"], 5).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    one, two = (sorted(map(tuple, P.k_fold(df.repartition(n), ["id"], 5).collect())) for n in (1, 6))
    assert one == two
    assert P.holdout(df, ["id"], 0.2).where("split = 'test'").count() == 21


def test_shapley_values_add_up(spark):
    df = spark.range(20).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))

    def predict(x):
        return x.withColumn("prediction", F.col("a") * F.col("b") + F.col("a"))

    values = Z.shapley_values(df, predict, ["a", "b"], ["id"], permutations=4)
    total = {r["id"]: r["s"] for r in values.groupBy("id").agg(F.sum("shapley_value").alias("s")).collect()}
    base = 9.5 * df.agg(F.avg("b")).first()[0] + 9.5
    for r in predict(df).collect():
        assert total[r["id"]] == pytest.approx(r["prediction"] - base)


def test_models_reject_unknown_parameters():
    with pytest.raises(ValueError):
        ML.regressor("lasso", {"depth": 3})
    with pytest.raises(ValueError):
        ML.regressor("neural_net")
