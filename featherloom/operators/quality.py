"""Schema and type validation, quality score, outliers and drift."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.functions import tails
from featherloom.functions.scalars import quality_grade
from featherloom.operators.ordered import cumulative_counts, lookup_join, q
from featherloom.operators.profile import _float, _table, compact, duplicate_rows, value_table, wide_aggregate
from featherloom.operators.quantiles import exact_quantiles
from featherloom.params import ParameterError, is_numeric, need_columns, numeric_columns, one_of
from featherloom.session import materialise

COLUMN_TYPES = ("integer", "float", "string", "boolean", "datetime", "category")


@dataclass
class ColumnRule:
    """What a column must look like."""

    name: str
    type: str
    nullable: bool = True
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: Sequence[Any] | None = None
    pattern: str | None = None
    unique: bool = False

    def __post_init__(self):
        one_of(self.type, COLUMN_TYPES, "type")


def type_name(kind: T.DataType) -> str:
    """integer | float | boolean | datetime | string | object."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string" if isinstance(kind, T.StringType) else "object"


_CASTS = {"integer": "bigint", "float": "double", "boolean": "boolean", "datetime": "timestamp_ntz"}


def validate_schema(df: DataFrame, rules: Sequence[ColumnRule], strict: bool = False) -> DataFrame:
    """One row per finding: column, check, severity (error | warning), violations.

    All counters come from one aggregate; uniqueness from one shuffle of (column, value).
    """
    named = {r.name for r in rules}
    rows: list[tuple] = [(r.name, "missing_column", "error", 1) for r in rules if r.name not in df.columns]
    rows += [(c, "extra_column", "error" if strict else "warning", 1) for c in df.columns if c not in named]
    counters: dict[str, Column] = {}
    severity: dict[str, str] = {}

    def count(rule: ColumnRule, check: str, test: Column, level: str = "error"):
        counters[f"{rule.name}|{check}"] = F.count_if(test)
        severity[f"{rule.name}|{check}"] = level

    present = [r for r in rules if r.name in df.columns]
    for r in present:
        c, kind = q(r.name), type_name(df.schema[r.name].dataType)
        count(r, "null", c.isNull(), "warning" if r.nullable else "error")
        if r.type == "integer" and kind != "integer":
            bad = c.isNotNull() if kind != "float" else c.isNotNull() & (c != F.floor(c))
            count(r, "type", bad)
        elif r.type == "float" and kind not in ("integer", "float"):
            count(r, "type", c.isNotNull())
        elif r.type in ("boolean", "datetime") and kind != r.type:
            count(r, "type", c.isNotNull())
        elif r.type == "string" and kind not in ("string", "object"):
            count(r, "type", c.isNotNull(), "warning")
        if kind in ("integer", "float"):
            if r.min_value is not None:
                count(r, "min_value", c < r.min_value)
            if r.max_value is not None:
                count(r, "max_value", c > r.max_value)
        if r.allowed_values is not None:
            count(r, "allowed_values", c.isNotNull() & ~c.isin(list(r.allowed_values)))
        if r.pattern is not None:
            count(r, "pattern", c.isNotNull() & ~c.cast("string").rlike(f"^(?:{r.pattern})"))
    got = wide_aggregate(df, counters) if counters else {}
    rows += [(*key.rsplit("|", 1), severity[key], n) for key, n in got.items() if n]
    found = _table(df, rows, "column string, check string, severity string, violations bigint")
    unique = [r.name for r in present if r.unique]
    if unique:
        repeats = value_table(df, unique).groupBy("column").agg(F.sum(F.col("n") - 1).alias("violations")).where("violations > 0")
        found = found.unionByName(repeats.select("column", F.lit("unique").alias("check"), F.lit("error").alias("severity"), "violations"))
    return found


def invalid_values(df: DataFrame, column: str, allowed: Sequence[Any]) -> DataFrame:
    """Distinct values outside the allowed list with their row counts."""
    c = q(column)
    return df.where(c.isNotNull() & ~c.isin(list(allowed))).groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def validate_types(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Columns whose type differs from the expected one.

    Text columns are tested by content: the number of values that cannot be cast is reported.
    """
    for t in expected.values():
        one_of(t, COLUMN_TYPES, "expected type")
    texts = {c: t for c, t in expected.items() if c in df.columns and type_name(df.schema[c].dataType) == "string" and t in _CASTS}
    bad = wide_aggregate(df, {c: F.count_if(q(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {_CASTS[t]}) IS NULL")) for c, t in texts.items()}) if texts else {}
    rows = []
    for c, t in expected.items():
        if c not in df.columns:
            rows.append((c, "Column not found", t, None, None))
            continue
        actual = type_name(df.schema[c].dataType)
        if actual != t and not (t == "category" and actual == "string"):
            rows.append((c, "Type mismatch", t, actual, bad.get(c)))
    return _table(df, rows, "column string, error string, expected string, actual string, uncastable bigint")


def column_quality(df: DataFrame, uniqueness_threshold: float = 0.01) -> DataFrame:
    """Per column: null and unique ratios, potential id, high cardinality, constant; of numbers also infinities, min, max, mean and std."""
    aggs: dict[str, Column] = {"n": F.count(F.lit(1))}
    for c in df.columns:
        aggs[f"{c}|nulls"] = F.count_if(q(c).isNull())
        if is_numeric(df, c):
            x = q(c).cast("double")
            aggs[f"{c}|inf"] = F.count_if(F.abs(x) == float("inf"))
            aggs |= {f"{c}|min": F.min(x), f"{c}|max": F.max(x), f"{c}|mean": F.avg(x), f"{c}|std": F.stddev_samp(x)}
    got = wide_aggregate(df, aggs)
    n = max(got["n"], 1)
    rows = [(f.name, type_name(f.dataType), got[f"{f.name}|nulls"], got[f"{f.name}|nulls"] / n, got.get(f"{f.name}|inf", 0), *[_float(got.get(f"{f.name}|{s}")) for s in ("min", "max", "mean", "std")], is_numeric(df, f.name)) for f in df.schema.fields]
    base = _table(df, rows, "column string, dtype string, null_count bigint, null_ratio double, inf_count bigint, min double, max double, mean double, std double, __num boolean")
    unique = value_table(df, df.columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    out = base.join(unique, "column", "left").fillna(0, ["unique_count"])
    ratio = F.col("unique_count") / F.lit(n)
    return out.withColumns({
        "unique_ratio": ratio,
        "potential_id": (ratio > 0.99) & (F.col("null_ratio") < uniqueness_threshold),
        "high_cardinality": (F.col("unique_count") > 100) & ~F.col("__num"),
        "constant": F.col("unique_count") == 1,
    }).drop("__num")


def mixed_type_columns(df: DataFrame) -> list[str]:
    """Text columns that hold both numbers and other text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = {}
    for c in texts:
        number = F.expr(f"try_cast(`{c}` AS double) IS NOT NULL")
        aggs[f"{c}|num"] = F.count_if(q(c).isNotNull() & number)
        aggs[f"{c}|all"] = F.count(q(c))
    got = wide_aggregate(df, aggs) if texts else {}
    return [c for c in texts if 0 < got[f"{c}|num"] < got[f"{c}|all"]]


def quality_score(df: DataFrame, completeness_threshold: float = 0.95) -> DataFrame:
    """0.4 completeness + 0.3 uniqueness + 0.3 validity, with the grade."""
    mixed = mixed_type_columns(df)
    nulls = wide_aggregate(df, {"n": F.count(F.lit(1)), **{f"c|{c}": F.count(q(c)) for c in df.columns}})
    cells = nulls["n"] * len(df.columns)
    missing = cells - sum(v for k, v in nulls.items() if k != "n")
    completeness = (cells - missing) / cells if cells else 0.0
    validity = 1 - len(mixed) / len(df.columns) if df.columns else 0.0
    out = duplicate_rows(df).select(
        "row_count", F.lit(cells).cast("bigint").alias("total_cells"), F.lit(missing).cast("bigint").alias("missing_cells"), F.lit(completeness).alias("completeness"),
        F.lit(completeness >= completeness_threshold).alias("complete_enough"), "duplicate_rows", "duplicate_ratio", F.lit(float(validity)).alias("validity"),
    )
    score = F.lit(0.4 * completeness) + 0.3 * (1 - F.col("duplicate_ratio")) + F.lit(0.3 * validity)
    return out.withColumn("score", score).withColumn("grade", quality_grade(F.col("score")))


# ---- outliers --------------------------------------------------------------------------


def outliers_iqr(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Bounds Q1 - k IQR and Q3 + k IQR, count and share outside them, per numeric column."""
    columns = numeric_columns(df, columns)
    quarts = exact_quantiles(df, columns, [0.25, 0.75])
    bounds = {c: (v[0], v[1], v[0] - threshold * (v[1] - v[0]), v[1] + threshold * (v[1] - v[0])) for c, v in quarts.items() if v[0] is not None}
    got = wide_aggregate(df, {"n": F.count(F.lit(1)), **{f"c|{c}": F.count_if((q(c) < b[2]) | (q(c) > b[3])) for c, b in bounds.items()}})
    rows = [(c, got[f"c|{c}"], 100.0 * got[f"c|{c}"] / got["n"], *map(float, b), float(b[1] - b[0])) for c, b in bounds.items()]
    return _table(df, rows, "column string, outliers bigint, pct double, q1 double, q3 double, lower double, upper double, iqr double")


def outliers_zscore(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Rows further than ``threshold`` sample standard deviations from the mean; none for a constant column."""
    columns = numeric_columns(df, columns)
    got = wide_aggregate(df, {"n": F.count(F.lit(1)), **{f"m|{c}": F.avg(q(c)) for c in columns}, **{f"s|{c}": F.stddev_samp(q(c)) for c in columns}})
    tests = {c: F.count_if(F.abs((q(c) - got[f"m|{c}"]) / got[f"s|{c}"]) > threshold) for c in columns if got[f"s|{c}"]}
    counts = wide_aggregate(df, tests) if tests else {}
    rows = [(c, counts.get(c, 0), 100.0 * counts.get(c, 0) / max(got["n"], 1), _float(got[f"m|{c}"]), _float(got[f"s|{c}"])) for c in columns]
    return _table(df, rows, "column string, outliers bigint, pct double, mean double, std double")


def outlier_rows(df: DataFrame, column: str, lower: float, upper: float, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The rows outside the bounds, all or the first ``limit``."""
    out = df.where((q(column) < lower) | (q(column) > upper))
    if limit is None:
        return out
    return out.orderBy(*[q(o) for o in (order or [column])]).limit(limit)


LEAST_VALUES = 10  # a column with fewer values has no outliers
_TREES, _SAMPLE = 100, 256


def isolation_forests(df: DataFrame, columns: Sequence[str], trees: int = _TREES, sample: int = _SAMPLE, seed: int = 42) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """Per column its trees as step functions of the value: (cuts, depths), one depth more than cuts.

    A tree is grown from ``sample`` values, as the method has it; scores and thresholds are those of all rows. Drawn are, of each column, the
    ``trees * sample`` values with the smallest hash of row and seed, so the same rows give the same forest however they are partitioned.
    A column's trees are grown in one task from that draw, whose size does not depend on the table's.
    Columns with fewer than ten values have no forest.
    """
    want = trees * sample
    drawn = _smallest_hashes(df, columns, want, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "x"])
        n = np.minimum(pdf["n"].to_numpy(), want)
        pool = np.repeat(pdf["x"].to_numpy(), np.clip(want - (np.cumsum(n) - n), 0, n))
        col = int(pdf["col"].iloc[0])
        out = []
        if len(pool) >= LEAST_VALUES:
            for tree in range(trees):
                rng = np.random.default_rng([seed, col, tree])
                own = pool[tree::trees] if len(pool) == want else rng.permutation(pool)[:sample]
                cuts, depths = grown_tree(np.sort(own), rng)
                out.append((col, tree, cuts, depths))
        return pd.DataFrame(out, columns=["col", "tree", "cuts", "depths"])

    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {c: [] for c in columns}
    # At most columns x trees x sample steps come to the driver.
    for r in sorted(drawn.groupBy("col").applyInPandas(grow, "col int, tree int, cuts array<double>, depths array<double>").collect(), key=lambda r: (r["col"], r["tree"])):
        found[columns[r["col"]]].append((np.array(r["cuts"]), np.array(r["depths"])))
    return found


def _smallest_hashes(df: DataFrame, columns: Sequence[str], want: int, seed: int) -> DataFrame:
    """(col, h, x, n): per column at least its ``want`` values with the smallest row hashes (all if there are fewer), equal rows counted.

    Hashes spread evenly, so those below a bound are few times ``want``. The bound is a share of the hash range by the column's number of
    values; where equal rows leave a column short it is widened, until enough is below it or all is.
    """
    hashed = [f.name for f in df.schema.fields if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
    row = F.xxhash64(F.lit(seed), *[q(c) for c in hashed])
    counts = wide_aggregate(df, {str(i): F.count(q(c).cast("double")) for i, c in enumerate(columns)})
    share = {i: (want + 10 * want**0.5) / max(counts[str(i)], 1) for i in range(len(columns))}
    parts, left = [], list(share)
    while left:
        bounds = {i: min(int(share[i] * 2**64) - 2**63, 2**63 - 1) for i in left}
        items = F.array(*[F.when(F.col("__h") <= F.lit(bounds[i]), F.struct(F.lit(i).alias("col"), q(columns[i]).cast("double").alias("x"))) for i in left])
        few = df.withColumn("__h", row).where(F.col("__h") <= F.lit(max(bounds.values())))
        each = few.select(F.explode(items).alias("__i"), F.col("__h").alias("h")).select("__i.col", "h", "__i.x").where("x IS NOT NULL")
        found = materialise(each.groupBy("col", "h", "x").agg(F.count(F.lit(1)).alias("n")), "drawn")
        got = {r["col"]: r["n"] for r in found.groupBy("col").agg(F.sum("n").alias("n")).collect()}  # a row per column
        short = [i for i in left if got.get(i, 0) < min(want, counts[str(i)])]
        parts.append(found.where(~F.col("col").isin(short)) if short else found)
        share |= {i: 4 * share[i] for i in short}
        left = short
    return reduce(DataFrame.unionByName, parts)


def grown_tree(values: np.ndarray, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """Random cuts of sorted values down to single values, equal values or the depth limit; leaves count their expected further depth."""
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    cuts, depths = [], []

    def split(lo: int, hi: int, depth: int) -> None:
        part = values[lo:hi]
        if depth >= limit or hi - lo <= 1 or part[0] == part[-1]:
            depths.append(depth + _mean_path(hi - lo))
            return
        cut = rng.uniform(part[0], part[-1])
        mid = lo + int(np.searchsorted(part, cut, side="left"))
        mid = min(max(mid, lo + 1), hi - 1)
        split(lo, mid, depth + 1)
        cuts.append(cut)
        split(mid, hi, depth + 1)

    split(0, len(values), 0)
    return cuts, depths


def _mean_path(n: int) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def forest_scores(forest: Sequence[tuple[np.ndarray, np.ndarray]], values: np.ndarray, size: int) -> np.ndarray:
    """High where few random cuts isolate a value; ``size`` is the number of values a tree was grown from."""
    total = sum((depths[np.searchsorted(cuts, values, side="right")] for cuts, depths in forest), np.zeros(len(values)))
    return np.power(2.0, -total / len(forest) / _mean_path(size))


def isolation_scores(df: DataFrame, column: str | Sequence[str], trees: int = _TREES, sample: int = _SAMPLE, seed: int = 42) -> DataFrame:
    """Add ``isolation_score`` (one column), or ``isolation_score_<column>`` for each of several, all in one pass.

    Rows without a value keep a null score; so do all rows of a column with fewer than ten values.
    """
    columns = [column] if isinstance(column, str) else list(column)
    need_columns(df, columns)
    counts = wide_aggregate(df, {c: F.count(q(c)) for c in columns})
    forests = isolation_forests(df, columns, trees, sample, seed)
    shared = df.sparkSession.sparkContext.broadcast([(forests[c], min(sample, counts[c])) for c in columns])

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            values = np.array([np.asarray(r, float) for r in rows]).reshape(-1, len(columns))
            scored = np.full(values.shape, np.nan)
            for i, (forest, size) in enumerate(shared.value):
                known = ~np.isnan(values[:, i])
                if forest:
                    scored[known, i] = forest_scores(forest, values[known, i], size)
            yield pd.Series(list(scored))

    scored = df.withColumn("__scores", score(F.array(*[q(c).cast("double") for c in columns])))
    names = ["isolation_score"] if isinstance(column, str) else [f"isolation_score_{c}" for c in columns]
    return scored.withColumns({n: F.when(q(c).isNotNull() & ~F.isnan(F.col("__scores")[i]), F.col("__scores")[i]) for i, (n, c) in enumerate(zip(names, columns))}).drop("__scores")


def outliers_isolation(df: DataFrame, column: str, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """The rows with a value; outliers are those whose score is above the (1 - contamination) quantile, none with fewer than ten values."""
    scored = materialise(isolation_scores(df.where(q(column).isNotNull()), column, seed=seed), "isolation-scores")
    cut = exact_quantiles(scored, ["isolation_score"], [1 - min(contamination, 0.5)])["isolation_score"][0]
    return scored.withColumn("is_outlier", F.coalesce(F.col("isolation_score") > F.lit(cut), F.lit(False)))


def isolation_outliers(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """(column, values, outliers, pct, threshold) of every numeric column; passes over the table do not grow with the columns."""
    columns = numeric_columns(df, columns)
    if not columns:
        raise ParameterError("no numeric columns")
    scored = isolation_scores(df.select(*[q(c) for c in columns]), columns, seed=seed)
    names = [f"isolation_score_{c}" for c in columns]
    scored = materialise(scored.select(*[q(n) for n in names], *[q(c).isNotNull().alias(f"__has_{c}") for c in columns]), "isolation-scores")
    cuts = {c: exact[0] for c, exact in zip(columns, exact_quantiles(scored, names, [1 - min(contamination, 0.5)]).values())}
    got = wide_aggregate(scored, {**{f"n|{c}": F.count_if(q(f"__has_{c}")) for c in columns}, **{f"o|{c}": F.count_if(q(n) > F.lit(cuts[c])) for c, n in zip(columns, names) if cuts[c] is not None}})
    rows = [(c, got[f"n|{c}"], got.get(f"o|{c}", 0), 100.0 * got.get(f"o|{c}", 0) / max(got[f"n|{c}"], 1), cuts[c]) for c in columns]
    return _table(df, rows, "column string, values bigint, outliers bigint, pct double, threshold double")


# ---- drift -----------------------------------------------------------------------------


def _both_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str], whole_texts: bool = False) -> DataFrame:
    """(column, value, category, r, c): how often each value stands on either side, for all columns in one shuffle.

    Numbers are kept as ``value``, everything else as text in ``category``; long texts as digests unless they are wanted whole.
    """
    numeric = {c: is_numeric(reference, c) for c in columns}

    def stacked(df: DataFrame, side: str) -> DataFrame:
        def item(c: str) -> Column:
            value = q(c).cast("double") if numeric[c] else F.lit(None).cast("double")
            category = F.lit(None).cast("string") if numeric[c] else (q(c) if whole_texts else compact(df, c)).cast("string")
            return F.struct(F.lit(c).alias("column"), value.alias("value"), category.alias("category"))

        flags = [F.lit(int(s == side)).alias(s) for s in ("r", "c")]
        return df.select(F.explode(F.array(*[item(c) for c in columns])).alias("__i"), *flags).select("__i.*", "r", "c").where("value IS NOT NULL OR category IS NOT NULL")

    both = stacked(reference, "r").unionByName(stacked(current, "c"))
    return both.groupBy("column", "value", "category").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def _ks_table(counts: DataFrame) -> DataFrame:
    """(column, statistic, ref_n, cur_n) of the numeric columns: the largest distance between the two distribution functions."""
    sums = counts.groupBy("column").agg(F.sum("r").alias("ref_n"), F.sum("c").alias("cur_n"))
    cum = lookup_join(cumulative_counts(counts, ["column"], ["r", "c"]), sums, ["column"])
    # A side without values has no distribution: the statistic is null.
    gap = F.abs(F.try_divide(F.col("before_r") + F.col("r"), F.col("ref_n")) - F.try_divide(F.col("before_c") + F.col("c"), F.col("cur_n")))
    return cum.groupBy("column").agg(F.max(gap).alias("statistic"), F.max("ref_n").alias("ref_n"), F.max("cur_n").alias("cur_n"))


def _chi_square_table(counts: DataFrame) -> DataFrame:
    """Chi-square of current against reference counts scaled to the current total, per column.

    A category the reference lacks has no expected count: the statistic is then infinite, p is 0.
    """
    sums = counts.groupBy("column").agg(F.sum("r").alias("__r"), F.sum("c").alias("__c"))
    expected = F.col("r") * F.coalesce(F.try_divide(F.col("__c"), F.col("__r")), F.lit(0.0))
    term = F.when(F.col("r") > 0, F.coalesce(F.try_divide(F.pow(F.col("c") - expected, 2), expected), F.lit(0.0))).otherwise(F.lit(float("inf")))
    return lookup_join(counts, sums, ["column"]).groupBy("column").agg(
        F.sum(term).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"), F.count_if(F.col("r") > 0).alias("ref_unique_count"),
        F.count_if(F.col("c") > 0).alias("cur_unique_count"), F.count_if(F.col("r") == 0).alias("new_categories"), F.count_if(F.col("c") == 0).alias("missing_categories"),
    )


def _need_values(found: DataFrame, columns: Sequence[str]) -> None:
    have = {r["column"] for r in found.where("ref_n > 0 AND cur_n > 0").select("column").collect()}  # one row per column
    if missing := [c for c in columns if c not in have]:
        raise ParameterError(f"both sides need values: {missing}")


def drift_report(reference: DataFrame, current: DataFrame, columns: Sequence[str], significance_level: float = 0.05, method: str = "asymptotic") -> DataFrame:
    """One row per column with everything both tests report; the passes over the tables do not grow with the columns.

    Kolmogorov-Smirnov (p-value asymptotic or exact) with means, spreads and mean shift for numbers, chi-square with
    the numbers of new and missing categories for everything else. The categories themselves: :func:`category_changes`.
    """
    one_of(method, ("asymptotic", "exact"), "method")
    columns = list(columns)
    need_columns(reference, columns), need_columns(current, columns)
    if not columns:
        raise ParameterError("name at least one column")
    numbers = [c for c in columns if is_numeric(reference, c)]
    others = [c for c in columns if c not in numbers]
    counts = materialise(_both_sides(reference, current, columns), "drift")
    parts = []
    if numbers:
        found = materialise(_ks_table(counts.where(F.col("column").isin(numbers)).drop("category")), "drift-ks")
        _need_values(found, numbers)
        stats = [wide_aggregate(df, {f"{s}|{c}": f(q(c).cast("double")) for c in numbers for s, f in (("m", F.avg), ("s", F.stddev_samp))}) for df in (reference, current)]
        rows = [(c, *[stats[k][f"{s}|{c}"] for s in "ms" for k in (0, 1)]) for c in numbers]
        about = reference.sparkSession.createDataFrame(rows, "column string, ref_mean double, cur_mean double, ref_std double, cur_std double")
        shift = F.col("cur_mean") - F.col("ref_mean")
        found = found.join(F.broadcast(about), "column").withColumns({  # one row per column
            "test": F.lit("kolmogorov_smirnov"), "p_value": tails.ks_two_sample(F.col("statistic"), F.col("ref_n"), F.col("cur_n"), method),
            "mean_shift": shift, "mean_shift_pct": F.try_divide(shift * 100, F.col("ref_mean")),
        })
        parts.append(found)
    if others:
        found = _chi_square_table(counts.where(F.col("column").isin(others)).drop("value"))
        parts.append(found.withColumns({"test": F.lit("chi_square"), "p_value": tails.chi2_sf(F.col("statistic"), F.col("dof"))}))
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return out.withColumn("drift_detected", F.col("p_value") < significance_level)


def category_changes(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, change, rows): every category that only one side has, ``new`` or ``missing``, with its rows there."""
    need_columns(reference, columns), need_columns(current, columns)
    counts = _both_sides(reference, current, list(columns), True).withColumn("category", F.coalesce("category", F.col("value").cast("string")))
    only = counts.where("r = 0 OR c = 0")
    return only.select("column", "category", F.when(F.col("r") == 0, "new").otherwise("missing").alias("change"), F.greatest("r", "c").alias("rows"))


def ks_statistic(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Largest distance between the two empirical distribution functions."""
    found = materialise(_ks_table(_both_sides(reference, current, [column]).drop("category")), "drift-ks")
    _need_values(found, [column])
    return found.select("statistic", "ref_n", "cur_n")


_NUMERIC = ["statistic", "ref_n", "cur_n", "column", "p_value", "ref_mean", "cur_mean", "ref_std", "cur_std", "mean_shift", "mean_shift_pct", "drift_detected"]
_CATEGORICAL = ["statistic", "dof", "ref_unique_count", "cur_unique_count", "new_categories", "missing_categories", "column", "p_value", "drift_detected"]


def drift_numeric(reference: DataFrame, current: DataFrame, column: str, significance_level: float = 0.05, method: str = "asymptotic") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of one column; see :func:`drift_report`."""
    return drift_report(reference, current, [column], significance_level, method).select(*_NUMERIC)


def drift_categorical(reference: DataFrame, current: DataFrame, column: str, significance_level: float = 0.05) -> DataFrame:
    """Chi-square of one column; see :func:`drift_report`."""
    return drift_report(reference.select(q(column).cast("string").alias(column)), current.select(q(column).cast("string").alias(column)), [column], significance_level).select(*_CATEGORICAL)


def detect_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], significance_level: float = 0.05) -> DataFrame:
    """One row per column: KS for numbers, chi-square for everything else."""
    return drift_report(reference, current, columns, significance_level).select("column", "test", "statistic", "p_value", "drift_detected")
