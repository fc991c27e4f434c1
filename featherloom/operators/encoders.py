"""Feature preparation with fitted state.

``fit_*`` reads the training rows once (aggregates) and returns a small JSON-able state;
``apply_*`` turns the state into expressions, so replay costs no extra pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.functions.scalars import parse_list
from featherloom.operators.ordered import lookup_join, q, row_numbers
from featherloom.operators.profile import wide_aggregate
from featherloom.operators.quantiles import exact_quantiles, group_quantiles
from featherloom.operators.windows import fill_along
from featherloom.params import ParameterError, need_columns, numeric_columns, one_of
from featherloom.session import BROADCAST_ROWS, COLUMN_LIMIT, limit_of, new_path

# ---- scaling ---------------------------------------------------------------------------


def fit_scaling(df: DataFrame, columns: Sequence[str], method: str = "standard") -> dict:
    """Centre and scale (and lambda for box-cox) per numeric column."""
    one_of(method, ("standard", "robust", "minmax", "box-cox"), "method")
    columns = numeric_columns(df, need_columns(df, columns))
    if not columns:
        return {}
    if method == "robust":
        quarts = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        return {c: {"centre": m, "scale": (hi - lo) or 1.0} for c, (lo, m, hi) in quarts.items()}
    if method == "box-cox":
        return _fit_box_cox(df, columns)
    first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
    got = wide_aggregate(df, {**{f"a|{c}": first(q(c).cast("double")) for c in columns}, **{f"b|{c}": second(q(c).cast("double")) for c in columns}})
    out = {}
    for c in columns:
        a, b = got[f"a|{c}"], got[f"b|{c}"]
        spread = b if method == "standard" else None if b is None else b - a
        out[c] = {"centre": a, "scale": spread or 1.0}
    return out


def _box_cox(x: Column, lam: float) -> Column:
    """Null outside of the domain: values that are not positive."""
    x = F.when(x > 0, x)
    return F.log(x) if abs(lam) < 1e-12 else (F.exp(F.log(x) * lam) - 1) / lam


def _fit_box_cox(df: DataFrame, columns: Sequence[str]) -> dict:
    """Maximum likelihood lambda of the positive values: a grid of 21 values per pass, each pass ten times finer."""
    positive = {c: F.when(q(c) > 0, q(c)).cast("double") for c in columns}
    basics = wide_aggregate(df, {**{f"n|{c}": F.count(x) for c, x in positive.items()}, **{f"s|{c}": F.sum(F.log(x)) for c, x in positive.items()}})
    for c in columns:
        if not basics[f"n|{c}"]:
            raise ParameterError(f"box-cox needs positive values in {c}")
    centre, step = {c: 0.0 for c in columns}, 0.2
    for _ in range(7):
        for _ in range(8):  # follow the maximum when it sits on the edge of the grid
            grid = {(c, i): centre[c] + (i - 10) * step for c in columns for i in range(21)}
            got = wide_aggregate(df, {f"{c}|{i}": F.var_pop(_box_cox(q(c).cast("double"), lam)) for (c, i), lam in grid.items()})
            moved = False
            for c in columns:
                n, logs = basics[f"n|{c}"], basics[f"s|{c}"]
                fit = [(grid[c, i] - 1) * logs - n / 2 * math.log(got[f"{c}|{i}"]) if got[f"{c}|{i}"] and got[f"{c}|{i}"] > 0 else -math.inf for i in range(21)]
                best = max(range(21), key=lambda i: fit[i])
                moved = moved or best in (0, 20)
                centre[c] = grid[c, best]
            if not moved:
                break
        step /= 10
    got = wide_aggregate(df, {k: fn(_box_cox(q(c).cast("double"), centre[c])) for c in columns for k, fn in ((f"a|{c}", F.avg), (f"b|{c}", F.stddev_pop))})
    return {c: {"lambda": centre[c], "centre": got[f"a|{c}"], "scale": got[f"b|{c}"] or 1.0} for c in columns}


def apply_scaling(df: DataFrame, state: dict, overwrite_columns: bool = True) -> DataFrame:
    new = {}
    for c, s in state.items():
        x = q(c).cast("double")
        x = _box_cox(x, s["lambda"]) if "lambda" in s else x
        new[c if overwrite_columns else f"{c}_scaled"] = (x - s["centre"]) / s["scale"]
    return df.withColumns(new)


# ---- categories ------------------------------------------------------------------------


def fit_one_hot(df: DataFrame, column: str, threshold: float | None = 0.01) -> dict:
    """Labels with a share of at least ``threshold`` get a column; rarer ones share one.

    At most 1/threshold labels qualify. The rare labels are kept too (as a table when there
    are many), because a label unseen in training must give zeros everywhere.
    """
    need_columns(df, [column])
    spark = df.sparkSession
    text = q(column).cast("string")
    counts = df.groupBy(text.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    need = (0.01 if threshold is None else threshold) * total
    kept = [r["label"] for r in counts.where(F.col("n") >= need).limit(limit_of(spark, COLUMN_LIMIT) + 1).collect()]
    if len(kept) > limit_of(spark, COLUMN_LIMIT):
        raise ParameterError(f"{column} needs more than {limit_of(spark, COLUMN_LIMIT)} columns; raise the threshold")
    rare = counts.where(F.col("n") < need).select("label")
    limit = min(10_000, limit_of(spark, BROADCAST_ROWS))
    few = rare.limit(limit + 1).collect()
    state = {"column": column, "labels": sorted(x for x in kept if x is not None), "null": None in kept, "rare": [r["label"] for r in few], "rare_table": None}
    if len(few) > limit:
        path = new_path(spark, "rare-labels")
        rare.where("label IS NOT NULL").write.parquet(path)
        state.update(rare=[None] if None in [r["label"] for r in rare.where("label IS NULL").limit(1).collect()] else [], rare_table=path)
    return state


def apply_one_hot(df: DataFrame, state: dict, drop_original_column: bool = False) -> DataFrame:
    column = state["column"]
    c = q(column).cast("string")
    new = {f"{column}_{v}": F.when(c == v, 1.0).otherwise(0.0) for v in state["labels"]}
    if state["null"]:
        new[f"{column}_None"] = F.when(c.isNull(), 1.0).otherwise(0.0)
    rare = [v for v in state["rare"] if v is not None]
    test = c.isin(rare) if rare else F.lit(False)
    if None in state["rare"]:
        test = F.coalesce(test, F.lit(False)) | c.isNull()
    if state["rare_table"]:
        table = df.sparkSession.read.parquet(state["rare_table"]).select("label", F.lit(True).alias("__rare"))
        df = lookup_join(df.withColumn("label", c), table, ["label"]).drop("label")
        test = F.coalesce(test, F.lit(False)) | F.coalesce("__rare", F.lit(False))
    if state["rare"] or state["rare_table"]:
        new[f"{column}_infrequent_sklearn"] = F.when(test, 1.0).otherwise(0.0)
    out = df.withColumns(new).drop("__rare")
    return out.drop(column) if drop_original_column else out


def fit_ordinal(df: DataFrame, column: str) -> dict:
    """Sorted distinct values numbered from 0; a long list stays a table in the shared folder."""
    need_columns(df, [column])
    spark = df.sparkSession
    values = df.select(q(column).alias("value")).where("value IS NOT NULL").distinct()
    coded = row_numbers(values, [], ["value"], "__n").select("value", (F.col("__n") - 1).alias("code"))
    path = new_path(spark, "ordinal-codes")
    coded.write.parquet(path)
    return {"column": column, "table": path}


def apply_ordinal(df: DataFrame, state: dict) -> DataFrame:
    """``ordinal_encode__{column}``; unknown values are -1, nulls stay null."""
    column = state["column"]
    name = f"ordinal_encode__{column}"
    codes = df.sparkSession.read.parquet(state["table"]).select(F.col("value").alias(column), F.col("code").alias(name))
    out = lookup_join(df, codes, [column])
    return out.withColumn(name, F.when(q(column).isNotNull(), F.coalesce(q(name), F.lit(-1))))


def fit_list_vocabulary(df: DataFrame, column: str, threshold: float = 0.01) -> dict:
    """List items with at least the given share of all items, most frequent first."""
    need_columns(df, [column])
    counts = df.select(F.explode(_items(df, column)).alias("item")).where("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = limit_of(df.sparkSession, COLUMN_LIMIT)
    kept = counts.where(F.col("n") >= threshold * total).orderBy(F.desc("n"), "item").limit(limit + 1).collect()
    if len(kept) > limit:
        raise ParameterError(f"{column} needs more than {limit} columns; raise the threshold")
    return {"column": column, "vocabulary": [r["item"] for r in kept]}


def _items(df: DataFrame, column: str) -> Column:
    return q(column) if df.schema[column].dataType.typeName() == "array" else parse_list(q(column))


def apply_list_vocabulary(df: DataFrame, state: dict, drop_raw_col: bool = False) -> DataFrame:
    column = state["column"]
    staged = df.withColumn("__items", _items(df, column))
    out = staged.withColumns({f"{column}_{v}": F.coalesce(F.array_contains("__items", v).cast("int"), F.lit(0)) for v in state["vocabulary"]})
    return out.drop("__items", column) if drop_raw_col else out.drop("__items")


# ---- vocabularies of any size ------------------------------------------------------------


def fit_codes(df: DataFrame, column: str, threshold: float = 0.0) -> dict:
    """Labels (or list items) with at least the given share, numbered from 0, the most frequent first.

    The numbers are a table in the shared folder, whatever its size: nothing is refused and nothing comes to the driver.
    """
    need_columns(df, [column])
    counts = df.select(_labels(df, column).alias("item")).where("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = row_numbers(counts.where(F.col("n") >= threshold * total), [], ["-n", "item"], "code")
    path = new_path(df.sparkSession, "codes")
    kept.select("item", (F.col("code") - 1).cast("int").alias("code"), "n").write.parquet(path)
    return {"column": column, "table": path, "size": kept.sparkSession.read.parquet(path).count()}


def _labels(df: DataFrame, column: str) -> Column:
    """One row per item of a list, or per value of any other column, as text."""
    if df.schema[column].dataType.typeName() == "array":
        return F.explode(F.transform(q(column), lambda v: v.cast("string")))
    return q(column).cast("string")


def codes_long(df: DataFrame, state: dict, keys: Sequence[str]) -> DataFrame:
    """(*keys, code, value): the sparse form of an encoding; ``value`` is how often the row holds the item, rows without any have no row."""
    need_columns(df, [*keys, state["column"]])
    table = df.sparkSession.read.parquet(state["table"]).select("item", "code")
    each = df.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], _labels(df, state["column"]).alias("item")).where("item IS NOT NULL")
    counted = lookup_join(each, table, ["item"], "inner").groupBy(*[f"__k{i}" for i in range(len(keys))], "code").agg(F.count(F.lit(1)).alias("value"))
    return counted.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "code", "value")


def codes_sparse(df: DataFrame, state: dict, keys: Sequence[str]) -> DataFrame:
    """(*keys, size, indices, values): one sparse vector per key, indices ascending; as long as a row's own distinct items."""
    pairs = codes_long(df, state, keys).groupBy(*[q(k) for k in keys]).agg(F.sort_array(F.collect_list(F.struct("code", F.col("value").cast("double").alias("value")))).alias("__p"))
    found = df.select(*[q(k) for k in keys]).distinct()
    out = lookup_join(found, pairs, list(keys))
    empty = F.array().cast("array<struct<code:int,value:double>>")
    out = out.withColumn("__p", F.coalesce("__p", empty))
    return out.select(*[q(k) for k in keys], F.lit(state["size"]).alias("size"), F.col("__p.code").alias("indices"), F.col("__p.value").alias("values"))


# ---- fills -----------------------------------------------------------------------------

FILLS = ("mean", "median", "mode", "min", "max", "zero", "ffill", "bfill", "interpolate")


def fill_values(df: DataFrame, how_to_fill: dict[str, str], group_by: Sequence[str] = (), order_by: Sequence[str] = (), distinct: bool = True) -> DataFrame:
    """Fill nulls per group. Ordered fills follow ``order_by``; statistics come from one value per group."""
    need_columns(df, [*how_to_fill, *group_by, *order_by])
    for how in how_to_fill.values():
        one_of(how, FILLS, "how_to_fill")
    ordered = {c: h for c, h in how_to_fill.items() if h in ("ffill", "bfill", "interpolate")}
    out = fill_along(df, ordered, group_by, order_by) if ordered else df
    fixed = {c: h for c, h in how_to_fill.items() if h not in ordered and h != "zero"}
    if fixed:
        state = fit_fill(df, fixed, group_by)
        out = apply_fill(out, state, fixed, group_by)
    zero = [c for c, h in how_to_fill.items() if h == "zero"]
    if zero:
        out = out.withColumns({c: F.coalesce(q(c), F.lit(0).cast(df.schema[c].dataType)) for c in zero})
    out = out.select(*[q(c) for c in df.columns])
    return out.distinct() if distinct else out


def fit_fill(df: DataFrame, how_to_fill: dict[str, str], group_by: Sequence[str] = ()) -> DataFrame | dict:
    """Fill values: a table with one row per group, or a plain dictionary without groups."""
    keys = list(group_by)
    simple = {"mean": F.avg, "min": F.min, "max": F.max}
    aggs = {c: simple[h](q(c)) for c, h in how_to_fill.items() if h in simple}
    medians = [c for c, h in how_to_fill.items() if h == "median"]
    modes = [c for c, h in how_to_fill.items() if h == "mode"]
    if not keys:
        state = wide_aggregate(df, aggs) if aggs else {}
        state.update({c: v[0] for c, v in exact_quantiles(df, medians, [0.5]).items()} if medians else {})
        for c in modes:
            counts = df.where(q(c).isNotNull()).groupBy(q(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            state[c] = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).first()[0]
        return state
    table = df.groupBy(*[q(k) for k in keys]).agg(*([a.alias(f"__f_{c}") for c, a in aggs.items()] or [F.count(F.lit(1)).alias("__rows")]))
    if medians:
        table = lookup_join(table, group_quantiles(df, keys, {f"__f_{c}": (c, 0.5) for c in medians}), keys)
    for c in modes:
        counts = df.where(q(c).isNotNull()).groupBy(*[q(k) for k in keys], q(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy(*[q(k) for k in keys]).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(f"__f_{c}"))
        table = lookup_join(table, best, keys)
    return table


def apply_fill(df: DataFrame, state: DataFrame | dict, how_to_fill: dict[str, str], group_by: Sequence[str] = ()) -> DataFrame:
    if isinstance(state, dict):
        return df.withColumns({c: F.coalesce(q(c), F.lit(state[c])) for c in how_to_fill})
    joined = lookup_join(df, state, list(group_by))
    return joined.withColumns({c: F.coalesce(q(c), q(f"__f_{c}")) for c in how_to_fill}).select(*[q(c) for c in df.columns])


# ---- polynomial terms ------------------------------------------------------------------


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2, include_bias: bool = True, interaction_only: bool = False) -> DataFrame:
    """Products of the columns up to ``degree``: ``1``, ``a^2``, ``a b``; existing columns are kept."""
    columns = numeric_columns(df, need_columns(df, columns))
    choose = combinations if interaction_only else combinations_with_replacement
    new: dict[str, Column] = {"1": F.lit(1.0)} if include_bias else {}
    for d in range(2, degree + 1):
        for combo in choose(columns, d):
            powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())
            product = F.lit(1.0)
            for c in combo:
                product = product * q(c).cast("double")
            new[name] = product
    if len(new) > limit_of(df.sparkSession, COLUMN_LIMIT):
        raise ParameterError(f"{len(new)} polynomial terms are too many")
    return df.withColumns(new)


# ---- column reduction ------------------------------------------------------------------


def column_moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and sample covariance (columns x columns numbers) of complete rows."""
    clean = df.select(*[q(c).cast("double").alias(c) for c in columns]).dropna()
    d = len(columns)
    if d <= 19:
        aggs = {"n": F.count(F.lit(1)), **{f"m|{i}": F.avg(q(c)) for i, c in enumerate(columns)}}
        aggs.update({f"c|{i}|{j}": F.covar_samp(q(columns[i]), q(columns[j])) for i in range(d) for j in range(i, d)})
        got = wide_aggregate(clean, aggs)
        cov = np.array([[got[f"c|{min(i, j)}|{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
        return got["n"], np.array([got[f"m|{i}"] for i in range(d)], dtype=float), cov
    got = wide_aggregate(clean, {"n": F.count(F.lit(1)), **{f"m|{i}": F.avg(q(c)) for i, c in enumerate(columns)}, **{f"s|{i}": F.stddev_samp(q(c)) for i, c in enumerate(columns)}})
    vectors = VectorAssembler(inputCols=list(columns), outputCol="__v").transform(clean)
    std = np.array([got[f"s|{i}"] for i in range(d)])
    corr = np.nan_to_num(Correlation.corr(vectors, "__v").first()[0].toArray())
    return got["n"], np.array([got[f"m|{i}"] for i in range(d)]), corr * np.outer(std, std)


def fit_pca(df: DataFrame, columns: Sequence[str], n_components: int = 3) -> dict:
    """Means and loadings; in every component the largest loading is positive."""
    columns = numeric_columns(df, need_columns(df, columns))
    if not 1 <= n_components <= len(columns):
        raise ParameterError("n_components must be between 1 and the number of numeric columns")
    _, mean, cov = column_moments(df, columns)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:n_components]
    loadings = vectors[:, order].T
    loadings = [row * np.sign(row[np.argmax(np.abs(row))]) for row in loadings]
    return {"columns": list(columns), "mean": mean.tolist(), "loadings": [r.tolist() for r in loadings], "variance": values[order].tolist()}


def apply_pca(df: DataFrame, state: dict, prefix: str = "pca", first: int = 0) -> DataFrame:
    new = {}
    for i, row in enumerate(state["loadings"]):
        total = F.lit(0.0)
        for c, m, w in zip(state["columns"], state["mean"], row):
            total = total + (q(c).cast("double") - m) * w
        new[f"{prefix}{i + first}"] = total
    return df.withColumns(new)


def fit_agglomeration(df: DataFrame, columns: Sequence[str], n_clusters: int = 3, metric: str = "euclidean") -> dict:
    """Groups of columns: the pair whose merge adds least to the within-group squares goes first."""
    one_of(metric, ("euclidean",), "metric")
    columns = numeric_columns(df, need_columns(df, columns))
    if not 1 <= n_clusters < len(columns):
        raise ParameterError("n_clusters must be smaller than the number of numeric columns")
    n, mean, cov = column_moments(df, columns)
    var = np.diag(cov) * (n - 1) / n
    dist = var[:, None] + var[None, :] - 2 * cov * (n - 1) / n + (mean[:, None] - mean[None, :]) ** 2
    groups = {i: [i] for i in range(len(columns))}
    between = {(i, j): dist[i, j] for i, j in combinations(groups, 2)}
    while len(groups) > n_clusters:
        cost = {(i, j): d * len(groups[i]) * len(groups[j]) / (len(groups[i]) + len(groups[j])) for (i, j), d in between.items()}
        i, j = min(cost, key=lambda k: (cost[k], k))
        a, b, gap = len(groups[i]), len(groups[j]), between[(i, j)]
        for k in groups:
            if k not in (i, j):
                # squared distance from k to the mean of both groups
                dik, djk = between[tuple(sorted((i, k)))], between[tuple(sorted((j, k)))]
                between[tuple(sorted((i, k)))] = (a * dik + b * djk) / (a + b) - a * b * gap / (a + b) ** 2
        groups[i] += groups.pop(j)
        between = {k: d for k, d in between.items() if j not in k}
    return {"clusters": [[columns[m] for m in sorted(g)] for _, g in sorted(groups.items())]}


def apply_agglomeration(df: DataFrame, state: dict) -> DataFrame:
    """The mean of each column group as ``featureagglomeration{i}``."""
    new = {}
    for i, members in enumerate(state["clusters"]):
        total = F.lit(0.0)
        for c in members:
            total = total + q(c).cast("double")
        new[f"featureagglomeration{i}"] = total / len(members)
    return df.withColumns(new)
