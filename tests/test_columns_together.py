"""Operators that treat all columns or pairs at once, against the plain computation of each alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.operators import profile as P
from featherloom.operators import quality as Q
from featherloom.plans import classifiers as C
from featherloom.session import BROADCAST_ROWS, GROUP_ROWS
from featherloom.sources import catalog


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(700):
        a = rng.gauss(0, 1)
        b = a + rng.gauss(0, 1) if rng.random() > 0.1 else None
        data.append((i, a, b, rng.randrange(5), None if rng.random() < 0.2 else float(rng.randrange(40)), rng.choice(["x", "y", None]), None if i else 1.0))
    return spark.createDataFrame(data, "id int, a double, b double, c int, d double, text string, nearly_empty double").repartition(3)


@pytest.mark.parametrize("method", ["spearman", "kendall"])
@pytest.mark.parametrize("columns", [["a", "c", "id"], ["a", "b", "c", "d"]])
@pytest.mark.parametrize("large", [False, True])
def test_rank_correlations(spark, rows, method, columns, large):
    if large:
        spark.conf.set(GROUP_ROWS[0], "500")
        spark.conf.set(BROADCAST_ROWS[0], "1")
    try:
        got = {(r["column_a"], r["column_b"]): r["r"] for r in P.correlations(rows, columns, method).collect()}
    finally:
        spark.conf.unset(GROUP_ROWS[0])
        spark.conf.unset(BROADCAST_ROWS[0])
    frame = rows.select(*columns).toPandas().astype(float)
    for (x, y), r in got.items():
        both = frame[[x, y]].dropna()
        if method == "spearman":
            ranks = both.rank()
            want = np.corrcoef(ranks[x], ranks[y])[0, 1]
        else:
            u, v = (np.sign(np.subtract.outer(both[c].to_numpy(), both[c].to_numpy())) for c in (x, y))
            want = (u * v).sum() / np.sqrt((u * u).sum() * (v * v).sum())
        assert r == pytest.approx(want, abs=1e-10)
    assert len(got) == len(columns) * (len(columns) - 1) // 2


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_columns(spark, rows):
    wide = rows.select("id", "text", *[(F.col("d") + i * F.col("a")).alias(f"w{i}") for i in range(8)])
    names = [f"w{i}" for i in range(8)]
    for method in ("spearman", "kendall"):
        few = jobs(spark, f"{method} 2", lambda: P.correlations(wide, names[:2], method))
        assert jobs(spark, f"{method} 8", lambda: P.correlations(wide, names, method)) <= few + 4  # 28 pairs for one; joins may be planned otherwise
    half = F.col("id") < 300
    drift = lambda cols: Q.detect_drift(wide.where(half), wide.where(~half), cols).collect()
    assert jobs(spark, "drift 2", lambda: drift(["w0", "text"])) >= jobs(spark, "drift 9", lambda: drift([*names, "text"])) - 1


def test_constant_and_empty_columns(spark, rows):
    flat = rows.withColumn("one", F.lit(1.0))
    for method in ("spearman", "kendall"):
        got = P.correlations(flat.where("id < 0"), ["a", "b"], method).collect()
        assert [r["r"] for r in got] == [None]
    assert P.correlations(flat, ["one", "a"], "kendall").first()["r"] is None


def test_density_equals_the_direct_sum(spark, rows):
    values = np.array([r["a"] for r in rows.select("a").collect()])
    h = values.std(ddof=1) * len(values) ** -0.2
    for points in (7, 1000):
        got = P.density(rows, "a", points).orderBy("point").collect()
        x = np.array([r["x"] for r in got])
        want = np.exp(-0.5 * ((values[:, None] - x) / h) ** 2).sum(axis=0) / (len(values) * h * np.sqrt(2 * np.pi))
        assert len(got) == points and [r["density"] for r in got] == pytest.approx(want.tolist(), abs=1e-12)
    wide = P.density(rows.select((F.col("a") * 1e-3 + F.when(F.col("id") == 0, 1e6).otherwise(0)).alias("v")), "v", 50).collect()
    assert all(r["density"] >= -1e-15 for r in wide)


def test_drift_of_several_columns_equals_one_by_one(rows):
    old, new = rows.where("id < 300"), rows.where("id >= 300").withColumn("text", F.when(F.col("id") % 7 == 0, "only new").otherwise(F.col("text")))
    together = {r["column"]: r for r in Q.drift_report(old, new, ["a", "text", "d", "c"]).collect()}
    for c in ("a", "d", "c"):
        x, y = (np.sort([r[c] for r in side.where(F.col(c).isNotNull()).collect()]) for side in (old, new))
        grid = np.concatenate([x, y])
        want = np.abs(np.searchsorted(x, grid, "right") / len(x) - np.searchsorted(y, grid, "right") / len(y)).max()
        alone = Q.drift_numeric(old, new, c).first()
        assert together[c]["statistic"] == pytest.approx(want, abs=1e-12) == alone["statistic"]
        assert together[c]["p_value"] == alone["p_value"] and together[c]["ref_n"] == len(x)
        assert together[c]["mean_shift"] == pytest.approx(y.mean() - x.mean(), abs=1e-9)
    assert together["text"]["new_categories"] == 1 and together["text"]["statistic"] == float("inf") and together["text"]["p_value"] == 0
    changes = [tuple(r) for r in Q.category_changes(old, new, ["text"]).collect()]
    assert changes == [("text", "only new", "new", 57)]
    with pytest.raises(Exception, match="both sides need values"):
        Q.detect_drift(old, new.where("id < 0"), ["a"])


def test_isolation_of_all_columns(rows):
    found = {r["column"]: r for r in Q.isolation_outliers(rows, contamination=0.1).collect()}
    assert set(found) == {"id", "a", "b", "c", "d", "nearly_empty"}
    assert (found["nearly_empty"]["values"], found["nearly_empty"]["outliers"], found["nearly_empty"]["threshold"]) == (1, 0, None)
    numbers = rows.select("id", "a", "b", "c", "d", "nearly_empty")
    forests = Q.isolation_forests(numbers, numbers.columns)
    assert forests["nearly_empty"] == []
    frame = numbers.toPandas()
    for c in ("a", "b", "d"):
        values = frame[c].dropna().to_numpy(float)
        # The forest written out: the depth of a value is that of the leaf between the cuts around it.
        depth = np.zeros(len(values))
        for cuts, depths in forests[c]:
            for k, v in enumerate(values):
                depth[k] += depths[sum(1 for cut in cuts if cut <= v)]
        scores = 2.0 ** (-depth / len(forests[c]) / Q._mean_path(256))
        cut = np.quantile(scores, 0.9)
        assert found[c]["outliers"] == (scores > cut).sum() and found[c]["threshold"] == pytest.approx(cut)
        assert found[c]["values"] == len(values)
    again = {r["column"]: r for r in Q.isolation_outliers(rows.repartition(7), contamination=0.1).collect()}
    assert again["a"] == found["a"]
    few = Q.outliers_isolation(rows.limit(5), "a")
    assert few.where("is_outlier").count() == 0


def test_isolation_draws_few_rows_before_the_shuffle(spark):
    df = spark.range(60_000).select((F.col("id") % 977).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, F.col("id") / 7).alias("b"), F.when(F.col("id") < 20_000, F.lit(1.0)).alias("c"))
    same = df.unionByName(spark.range(50_000).select(F.lit(5.0).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("c")))  # one row 50,000 times
    hashed = same.withColumn("h", F.xxhash64(F.lit(42), "a", "b", "c")).toPandas()
    drawn = Q._smallest_hashes(same, ["a", "b", "c"], 200, 42).toPandas()
    for i, c in enumerate("abc"):
        own = drawn[drawn["col"] == i].sort_values(["h", "x"])
        values = [x for x, n in zip(own["x"], own["n"]) for _ in range(min(n, 200))][:200]
        assert values == hashed.dropna(subset=[c]).sort_values(["h", c])[c].tolist()[:200]
        assert len(own) < 2000  # and not every row of the table


def by_links(rows):
    """(dataset, ancestor, least distance) by walking the links."""
    sources = {}
    for e, s in rows:
        sources.setdefault(e, set()).add(s)
    out = set()
    for e in sources:
        seen, now, d = set(), {e}, 0
        while now:
            out |= {(e, a, d) for a in now}
            seen |= now
            now = {s for a in now for s in sources[a] if s is not None and s in sources} - seen
            d += 1
    return out


@pytest.mark.parametrize("extra", [[], [(100, 101), (101, 102), (102, 100), (103, 101)], [(1, 0), (40, 0), (40, None), (7, 99_999)], [(300, 300)]])
def test_lineage_of_all_datasets(spark, monkeypatch, extra):
    rows = [(i, i - 1 if i % 41 else None) for i in range(82)] + [(200, 12), (201, 12), (202, None), (None, 3)] + extra
    table = spark.createDataFrame(rows, "entity_id long, source_dataset_id long")
    merged, of_graph = [], catalog._lineage_of_graph
    monkeypatch.setattr(catalog, "_lineage_of_graph", lambda *parts: merged.append(1) or of_graph(*parts))
    taken = [tuple(r) for r in catalog.lineage(table).collect()]
    assert len(taken) == len(set(taken)) and set(taken) == by_links(rows)
    assert bool(merged) == bool(extra)  # without cycles and second sources no pair is merged


def test_lineage_of_a_long_chain_and_a_cycle(spark):
    n = 3000
    rows = [(i, i - 1 if i else None, f"n{i}", "p") for i in range(n)] + [(n + 1, n + 2, "x", "p"), (n + 2, n + 1, "y", None)]
    table = spark.createDataFrame(rows, "entity_id long, source_dataset_id long, name string, pipeline_name string")
    taken = []
    count = jobs(spark, "chain", lambda: taken.extend(catalog.lineage_of(table, n - 1).collect()))
    assert [(r["ancestor_id"], r["distance"], r["name"]) for r in taken] == [(i, n - 1 - i, f"n{i}") for i in range(n)]
    assert count < 250  # some jobs for each of about twelve doublings
    assert {(r["ancestor_id"], r["distance"]) for r in catalog.lineage_of(table, n + 1).collect()} == {(n + 1, 0), (n + 2, 1)}
    assert catalog.lineage_of(table, -5).count() == 0


@pytest.mark.parametrize("model", ["naive_bayes", "decision_tree", "logistic_regression"])
def test_classifiers(spark, rows, model):
    data = rows.select("id", "a", "d", F.when(F.col("a") + F.coalesce("d", F.lit(0.0)) / 20 > 0.7, "high").when(F.col("a") < -0.7, "low").otherwise("mid").alias("y"))
    fitted = C.fit_classifier(data, model, "y", ["a", "d"])
    scored = fitted.predict(data)
    assert scored.columns == [*data.columns, "prediction"] and fitted.labels == ["high", "low", "mid"]
    assert scored.where("prediction = y").count() / 700 > 0.7
    shares = C.class_shares(scored).collect()
    assert sum(r["n"] for r in shares) == 700 and sum(r["share"] for r in shares) == pytest.approx(1)
    table = {r["metric"]: r for r in C.cross_validate_classifier(data, model, "y", ["a", "d"], ["id"], n_folds=3).collect()}
    assert set(table) == set(C.SCORES) and all(r["folds"] == 3 and r["min"] <= r["mean"] <= r["max"] for r in table.values())
    with pytest.raises(Exception, match="no parameter"):
        C.fit_classifier(data, model, "y", ["a"], {"wrong": 1})


def test_vocabulary_of_many_columns(spark):
    from featherloom.operators import encoders as E

    n = 50_000
    df = spark.range(n).select("id", F.when(F.col("id") % 1000 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("w"), F.col("id")), F.lit("common"), F.lit("common"))).alias("words"))
    state = E.fit_codes(df, "words")
    assert state["size"] == n - 50 + 1
    long = E.codes_long(df, state, ["id"])
    assert long.count() == 2 * (n - 50)
    assert sorted((r["code"], r["value"]) for r in long.where("id = 7").collect())[0] == (0, 2)
    sparse = {r["id"]: r for r in E.codes_sparse(df.where("id IN (0, 7)"), state, ["id"]).collect()}
    assert sparse[0]["indices"] == [] and sparse[7]["values"] == [2.0, 1.0] and sparse[7]["size"] == state["size"]
