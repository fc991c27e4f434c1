"""Column profiles, distributions, correlations and counts.

One wide aggregate serves all columns; its single row (columns x statistics numbers) is
turned into one output row per column. Exact order statistics come from the quantile
module, distinct values from one shuffle of (column, value) counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import factorial

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.operators.ordered import (
    cumulative_counts,
    lookup_join,
    q,
    row_numbers,
    running,
)
from featherloom.operators.quantiles import exact_quantiles
from featherloom.params import ParameterError, is_numeric, need_columns, numeric_columns, one_of
from featherloom.session import BROADCAST_BYTES, BROADCAST_ROWS, limit_of, materialise

_CHUNK = 200


def wide_aggregate(df: DataFrame, aggregates: dict[str, Column]) -> dict:
    """Many whole-table aggregates, at most 200 expressions per job so code generation holds."""
    names, out = list(aggregates), {}
    for i in range(0, len(names), _CHUNK):
        part = names[i : i + _CHUNK]
        row = df.agg(*[aggregates[n].alias(f"a{j}") for j, n in enumerate(part)]).first()
        out.update(zip(part, row))
    return out


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _float(v):
    return None if v is None else float(v)


def compact(df: DataFrame, column: str) -> Column:
    """A column as a grouping key: long texts are replaced by their SHA-256, so whole texts are not shuffled."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return q(column)
    return F.when(F.length(q(column)) > 64, F.concat(F.lit("sha2:"), F.sha2(q(column), 256))).otherwise(q(column))


def value_table(df: DataFrame, columns: Sequence[str], whole_values: bool = False) -> DataFrame:
    """(column, value as text, n) of all listed columns in one shuffle, combined map-side.

    Long texts appear as digests unless ``whole_values`` is set.
    """

    def key(c: str) -> Column:
        return (q(c) if whole_values else compact(df, c)).cast("string")

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), key(c).alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


# ---- describe --------------------------------------------------------------------------


def describe(df: DataFrame, columns: Sequence[str] | None = None, shape: bool = False) -> DataFrame:
    """count, mean, std, min, q1, median, q3, max, null count and % of the numeric columns.

    ``shape`` adds the bias-corrected skewness and excess kurtosis.
    """
    columns = numeric_columns(df, columns)
    aggs = {("n", ""): F.count(F.lit(1))}
    for c in columns:
        x = q(c).cast("double")
        aggs.update({(c, "count"): F.count(x), (c, "mean"): F.avg(x), (c, "std"): F.stddev_samp(x), (c, "min"): F.min(x), (c, "max"): F.max(x)})
        if shape:
            aggs.update({(c, "skew"): F.skewness(x), (c, "kurt"): F.kurtosis(x)})
    got = wide_aggregate(df, {"|".join(k): v for k, v in aggs.items()})
    quarts = exact_quantiles(df, columns, [0.25, 0.5, 0.75]) if columns else {}
    total = got["n|"]
    rows = []
    for c in columns:
        n = got[f"{c}|count"]
        row = [c, n, *[_float(got[f"{c}|{s}"]) for s in ("mean", "std", "min")], *[_float(v) for v in quarts[c]], _float(got[f"{c}|max"]),
               total - n, 100.0 * (total - n) / total if total else 0.0]
        if shape:
            row += [sample_skewness(got[f"{c}|skew"], n), sample_kurtosis(got[f"{c}|kurt"], n)]
        rows.append(tuple(row))
    schema = "column string, count bigint, mean double, std double, min double, q1 double, median double, q3 double, max double, null_count bigint, null_pct double"
    return _table(df, rows, schema + (", skewness double, kurtosis double" if shape else ""))


def sample_skewness(population: float | None, n: int) -> float | None:
    """Bias-corrected from the population form Spark computes."""
    return None if population is None or n < 3 else population * (n * (n - 1)) ** 0.5 / (n - 2)


def sample_kurtosis(population: float | None, n: int) -> float | None:
    return None if population is None or n < 4 else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6)


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, unique, top value and its frequency; equal frequencies go to the smallest value."""
    columns = list(columns or [c for c in df.columns if not is_numeric(df, c)])
    values = value_table(df, columns, whole_values=True)
    found = values.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq"),
    )
    names = _table(df, [(c,) for c in columns], "column string")
    return names.join(found, "column", "left").fillna(0, ["count", "unique"])


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null and unique counts and shares, mean, std, min, max, median, zeros, negatives."""
    columns = numeric_columns(df, columns)
    aggs = {"n": F.count(F.lit(1))}
    for c in columns:
        x = q(c).cast("double")
        aggs.update({f"{c}|count": F.count(x), f"{c}|mean": F.avg(x), f"{c}|std": F.stddev_samp(x), f"{c}|min": F.min(x), f"{c}|max": F.max(x),
                     f"{c}|zeros": F.count_if(x == 0), f"{c}|negatives": F.count_if(x < 0)})
    got = wide_aggregate(df, aggs)
    medians = exact_quantiles(df, columns, [0.5]) if columns else {}
    n = got["n"]
    rows = [
        (c, n - got[f"{c}|count"], 100.0 * (n - got[f"{c}|count"]) / max(n, 1), *[_float(got[f"{c}|{s}"]) for s in ("mean", "std", "min", "max")],
         _float(medians[c][0]), got[f"{c}|zeros"], got[f"{c}|negatives"])
        for c in columns
    ]
    stats = _table(df, rows, "column string, null_count bigint, null_pct double, mean double, std double, min double, max double, median double, zeros bigint, negatives bigint")
    unique = value_table(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    out = stats.join(unique, "column", "left").fillna(0, ["unique_count"])
    return out.withColumn("unique_pct", F.col("unique_count") / F.lit(max(n, 1)) * 100)


def profile_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null and unique counts, average, shortest and longest length of text columns."""
    columns = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    aggs = {"n": F.count(F.lit(1))}
    for c in columns:
        aggs.update({f"{c}|count": F.count(q(c)), f"{c}|avg": F.avg(F.length(q(c))), f"{c}|min": F.min(F.length(q(c))), f"{c}|max": F.max(F.length(q(c)))})
    got = wide_aggregate(df, aggs)
    n = got["n"]
    rows = [(c, n - got[f"{c}|count"], 100.0 * (n - got[f"{c}|count"]) / max(n, 1), got[f"{c}|avg"], got[f"{c}|min"], got[f"{c}|max"]) for c in columns]
    stats = _table(df, rows, "column string, null_count bigint, null_pct double, avg_length double, min_length bigint, max_length bigint")
    unique = value_table(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return stats.join(unique, "column", "left").fillna(0, ["unique_count"])


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values per column with their share of the non-null values.

    Spark keeps only k rows per column in each task before the final ranking.
    """
    values = value_table(df, columns, whole_values=True)
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    totals = values.groupBy("column").agg(F.sum("n").alias("total"))
    return ranked.join(F.broadcast(totals), "column").select(  # one row per listed column
        "column", "value", "n", "rank", (F.col("n") / F.col("total") * 100).alias("pct")
    )


def value_counts_table(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Value counts with percentages, most frequent first; optionally only the top k."""
    total = df.where(q(column).isNotNull()).count()
    counts = df.where(q(column).isNotNull()).groupBy(q(column)).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("pct", F.col("n") / F.lit(max(total, 1)) * 100).orderBy(F.desc("n"), q(column))
    return out if k is None else out.limit(k)


# ---- missing values --------------------------------------------------------------------


def missing_values(df: DataFrame, threshold_pct: float = 0.0) -> DataFrame:
    """Null count and % per column from one pass, with the severity band."""
    got = wide_aggregate(df, {"n": F.count(F.lit(1)), **{f"c|{c}": F.count(q(c)) for c in df.columns}})
    n = got["n"]
    rows = [(f.name, f.dataType.simpleString(), n - got[f"c|{f.name}"], round(100.0 * (n - got[f"c|{f.name}"]) / max(n, 1), 2)) for f in df.schema.fields]
    out = _table(df, rows, "column string, dtype string, null_count bigint, null_pct double").where(F.col("null_pct") >= threshold_pct)
    p = F.col("null_pct")
    return out.withColumn("severity", F.when(p > 50, "high").when(p > 5, "moderate").when(p > 0, "low").otherwise("none"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Totals over all cells and the number of rows that are null throughout."""
    nulls = sum((F.sum(q(c).isNull().cast("bigint")) for c in df.columns), F.lit(0))
    has = sum((F.max(q(c).isNull().cast("int")) for c in df.columns), F.lit(0))
    empty = F.lit(True)
    for c in df.columns:
        empty = empty & q(c).isNull()
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), nulls.alias("total_nulls"), has.cast("bigint").alias("cols_with_nulls"), F.count_if(empty).alias("all_null_rows"))
    cells = F.col("total_rows") * len(df.columns)
    return out.withColumns({"total_cells": cells, "overall_null_pct": F.round(F.try_divide(F.col("total_nulls") * 100.0, cells), 2)})


# ---- correlations ----------------------------------------------------------------------


def correlations(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """One row per column pair (a before b) with the pairwise-complete coefficient."""
    one_of(method, ("pearson", "spearman", "kendall"), "method")
    columns = numeric_columns(df, columns)
    pairs = list(combinations(columns, 2))
    if method == "pearson":
        got = wide_aggregate(df, {f"{a}|{b}": _corr(q(a), q(b)) for a, b in pairs})
        rows = [(a, b, _float(got[f"{a}|{b}"])) for a, b in pairs]
    elif method == "spearman":
        rows = _spearman(df, columns, pairs)
    else:
        found = _kendall(_points(df, columns, pairs))
        rows = [(a, b, found.get(i)) for i, (a, b) in enumerate(pairs)]
    return _table(df, rows, "column_a string, column_b string, r double")


def _corr(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.corr(F.when(both, a.cast("double")), F.when(both, b.cast("double")))


def _points(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, x, y, n): how often two values stand in one row, for all pairs of columns in one shuffle."""
    both = F.array(*[F.struct(F.lit(i).alias("pair"), q(a).cast("double").alias("x"), q(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])
    each = df.select(F.explode(both).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    return materialise(each.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")), "points")


def _ranks(counts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Mean ranks of (*keys, value, n)."""
    return cumulative_counts(counts, keys, ["n"]).select(*keys, "value", (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))


def _spearman(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> list[tuple]:
    """Ranks of all columns from one table of value counts; the number of jobs depends neither on columns nor on pairs.

    Without nulls every pair uses the same ranks. With nulls a pair ranks its own complete rows.
    """
    if not pairs:
        return []
    got = wide_aggregate(df, {"n": F.count(F.lit(1)), **{f"c|{c}": F.count(q(c)) for c in columns}})
    if all(got[f"c|{c}"] == got["n"] for c in columns):
        ranked = _with_ranks(df, columns)
        got = wide_aggregate(ranked, {f"{a}|{b}": F.corr(f"__rank{columns.index(a)}", f"__rank{columns.index(b)}") for a, b in pairs})
        return [(a, b, _float(got[f"{a}|{b}"])) for a, b in pairs]
    points = _points(df, columns, pairs)
    for side in ("x", "y"):
        ranks = _ranks(points.groupBy("pair", F.col(side).alias("value")).agg(F.sum("n").alias("n")), ["pair"], f"rank_{side}")
        points = points.join(ranks.withColumnRenamed("value", side), ["pair", side])
    n, x, y = (F.col(c).cast("double") for c in ("n", "rank_x", "rank_y"))
    # Ranks of a pair have the mean (m + 1) / 2 whatever the ties, so sums about it lose no digits.
    middle = points.groupBy("pair").agg(((F.sum("n") + 1) / 2).alias("middle"))
    dx, dy = x - F.col("middle"), y - F.col("middle")
    sums = points.join(F.broadcast(middle), "pair").groupBy("pair").agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"))  # one row per pair
    found = {r["pair"]: r["xy"] / (r["xx"] * r["yy"]) ** 0.5 if r["xx"] * r["yy"] > 0 else None for r in sums.collect()}
    return [(a, b, found.get(i)) for i, (a, b) in enumerate(pairs)]


def _with_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only ``__rank0``, ``__rank1``, ...: the mean ranks of complete columns.

    The ranks of columns with few distinct values are read together, within the limits of a broadcast; the others are joined by value.
    """
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), q(c).cast("double").alias("value")) for i, c in enumerate(columns)]))
    counts = df.select(items.alias("p")).select("p.*").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = materialise(_ranks(counts, ["col"], "rank"), "ranks")
    room = min(limit_of(df.sparkSession, BROADCAST_ROWS), limit_of(df.sparkSession, BROADCAST_BYTES) // 20)
    small = []
    for r in sorted(ranks.groupBy("col").count().collect(), key=lambda r: (r["count"], r["col"])):  # one row per column
        room -= r["count"]
        if room >= 0:
            small.append(r["col"])
    table = ranks.where(F.col("col").isin(small)).toArrow() if small else None
    ranked = df.select(*[q(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        if i in small:
            own = table.filter(pc.equal(table["col"], i)).select(["value", "rank"]).rename_columns([f"__x{i}", f"__rank{i}"])
            one = F.broadcast(df.sparkSession.createDataFrame(own, f"__x{i} double, __rank{i} double"))
        else:
            one = ranks.where(F.col("col") == i).select(F.col("value").alias(f"__x{i}"), F.col("rank").alias(f"__rank{i}"))
        ranked = ranked.join(one, f"__x{i}").drop(f"__x{i}")  # every value has a rank; a hot value of a shuffled join is split by AQE
    return ranked


def kendall_tau(df: DataFrame, a: str, b: str) -> float | None:
    """Tau-b of one pair; see :func:`_kendall`."""
    return _kendall(_points(df, [a, b], [(a, b)])).get(0)


def _kendall(points: DataFrame) -> dict[int, float | None]:
    """Tau-b of every pair without comparing all pairs of rows, all pairs of columns together.

    Ranks of ``y`` are read bit by bit: two rows first differ at one bit, so the ordered and
    reversed pairs are counted per (bit, higher bits) with running counts along ``x``. The work
    is rows x bits, every step an aggregate or a chunked running count.
    """
    levels = points.groupBy("pair", "y").agg(F.sum("n").alias("n"))
    ranks = materialise(row_numbers(levels, ["pair"], ["y"], "yr"), "levels")
    tops = {r["pair"]: r["top"] for r in ranks.groupBy("pair").agg(F.max("yr").alias("top")).collect()}  # one row per pair
    if not tops:
        return {}
    placed = lookup_join(points, ranks.drop("n"), ["pair", "y"])
    bits = placed.select("pair", "x", "n", "yr", F.explode(F.sequence(F.lit(0), F.lit(max(int(t).bit_length() for t in tops.values()) - 1))).alias("bit"))
    bit_on = F.expr("shiftright(yr, bit) & 1")
    cells = bits.groupBy("pair", "bit", F.expr("shiftright(yr, bit + 1)").alias("prefix"), "x").agg(
        F.sum(F.when(bit_on == 1, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(bit_on == 0, F.col("n")).otherwise(0)).alias("zeros")
    )
    before = running(cells, ["pair", "bit", "prefix"], ["x"], {"ones_before": ("sum", F.col("ones")), "zeros_before": ("sum", F.col("zeros"))}, include_current=False)

    def paired(here: str, earlier: str) -> Column:
        return F.sum((F.col(here).cast("decimal(19,0)") * F.coalesce(earlier, F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)"))

    def tied(table: DataFrame) -> DataFrame:
        return table.groupBy("pair").agg(F.sum(F.col("n").cast("decimal(19,0)") * (F.col("n") - 1).cast("decimal(19,0)") / 2).alias("ties"), F.sum("n").alias("rows"))

    counted = before.groupBy("pair").agg((paired("ones", "zeros_before") - paired("zeros", "ones_before")).alias("score"))
    ties_x = tied(points.groupBy("pair", "x").agg(F.sum("n").alias("n"))).withColumnRenamed("ties", "ties_x")
    ties_y = tied(ranks.select("pair", "n")).select("pair", F.col("ties").alias("ties_y"))
    out: dict[int, float | None] = {}
    for r in counted.join(ties_x, "pair").join(ties_y, "pair").collect():  # one row per pair
        pairs = r["rows"] * (r["rows"] - 1) / 2
        scale = ((pairs - float(r["ties_x"])) * (pairs - float(r["ties_y"]))) ** 0.5
        out[r["pair"]] = None if scale == 0 else float(r["score"]) / scale
    return out


def strong_pairs(correlation: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs with |r| at or above the threshold, strongest first, with a strength label."""
    r = F.abs("r")
    label = F.when(r >= 0.8, "Very strong").when(r >= 0.6, "Strong").otherwise("Moderate")
    return correlation.where(r >= threshold).withColumn("strength", label).orderBy(F.desc(r), "column_a", "column_b")


def target_correlations(correlation: DataFrame, target: str) -> DataFrame:
    """Every other column's coefficient with the target, ranked by |r|, with strength and direction."""
    other = F.when(F.col("column_a") == target, F.col("column_b")).otherwise(F.col("column_a"))
    rows = correlation.where((F.col("column_a") == target) | (F.col("column_b") == target)).select(other.alias("column"), "r")
    r = F.abs("r")
    label = F.when(r >= 0.7, "Strong").when(r >= 0.3, "Moderate").when(r < 0.1, "Weak").otherwise("Low")
    w = Window.orderBy(F.desc(r), "column")  # one row per column of the table
    return rows.withColumns({"strength": label, "direction": F.when(F.col("r") > 0, "positive").otherwise("negative"), "rank": F.row_number().over(w)})


# ---- distributions ---------------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin includes the maximum, empty bins are listed."""
    x = q(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        raise ParameterError(f"column {column} has no values")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("bigint")
    counts = df.where(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])  # at most `bins` rows
    return out.withColumns({"lower": F.lit(lo) + F.col("bin") * width, "upper": F.lit(lo) + (F.col("bin") + 1) * width})


_TERMS, _BOX, _REACH = 20, 1.0, 9.0  # terms of a series, width of a box and reach of a kernel, in bandwidths


def density(df: DataFrame, column: str, points: int = 100, pad: float = 0.5) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth.

    Rows are summed up in boxes one bandwidth wide: of each box its sums of Hermite terms about its middle, one aggregate of
    ``_TERMS`` sums whatever the number of points. A grid point adds the series of the boxes within nine bandwidths. The series leaves out less than
    1e-14 of a kernel's peak per row, what lies further away less than 1e-17.
    """
    x = q(column).cast("double")
    n, std, lo, hi = df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    if not std:
        raise ParameterError("density needs at least two different values")
    h = std * n ** (-0.2)
    reach = pad * (hi - lo)
    step = (hi - lo + 2 * reach) / (points - 1)
    start = lo - reach
    scale = 1.0 / (n * h * (2 * 3.141592653589793) ** 0.5)
    # exp(-(u - t)^2 / 2) = sum over k of t^k / k! * He_k(u) * exp(-u^2 / 2), t a row's and u a point's place about the middle of a box.
    box = F.floor((x - lo) / h / _BOX)
    t = (x - lo) / h - (box + 0.5) * _BOX
    sums = df.where(x.isNotNull()).select(box.alias("box"), t.alias("t")).groupBy("box").agg(*[F.sum(F.pow("t", F.lit(k)) / factorial(k)).alias(f"s{k}") for k in range(_TERMS)])
    # A box meets the points within reach of it, each by its number on the grid.
    middle = F.lit(lo) + (F.col("box") + 0.5) * _BOX * h
    first = F.greatest(F.lit(0), F.ceil((middle - _REACH * h - start) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((middle + _REACH * h - start) / step)).cast("int")
    met = sums.where(last >= first).withColumn("point", F.explode(F.sequence(first, last)))
    u = (F.lit(start) + F.col("point") * step - middle) / h
    hermite = [F.lit(1.0), F.col("u")]
    met = met.withColumn("u", u).withColumns({"h0": hermite[0], "h1": hermite[1]})
    for k in range(2, _TERMS):
        met = met.withColumn(f"h{k}", F.col("u") * F.col(f"h{k - 1}") - (k - 1) * F.col(f"h{k - 2}"))
    series = sum((F.col(f"s{k}") * F.col(f"h{k}") for k in range(1, _TERMS)), F.col("s0"))
    found = met.groupBy("point").agg((F.sum(series * F.exp(-0.5 * F.col("u") * F.col("u"))) * scale).alias("density"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"), (F.lit(start) + F.col("id") * step).alias("x"))
    return grid.join(found, "point", "left").fillna(0.0, ["density"])


# ---- counts over rows ------------------------------------------------------------------


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency table, one column per (sorted) category; rows with a null are left out."""
    return df.dropna(subset=[row, column]).groupBy(q(row)).pivot(column).count().fillna(0)


def crosstab_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """The contingency table as (row, column, n), cells that occur only: any number of categories."""
    return df.dropna(subset=[row, column]).groupBy(q(row).alias("row"), q(column).alias("column")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row, and their share."""
    keys = need_columns(df, columns or df.columns)
    sizes = df.groupBy(*[compact(df, c).alias(c) for c in keys]).agg(F.count(F.lit(1)).alias("__n"))
    out = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    return out.withColumn("duplicate_ratio", F.coalesce(F.try_divide(F.col("duplicate_rows"), F.col("row_count")), F.lit(0.0)))


def distinct_tags(df: DataFrame, tags: str) -> DataFrame:
    """Sorted distinct items of an array column."""
    return df.select(F.explode(q(tags)).alias("tag")).where("tag IS NOT NULL").distinct().orderBy("tag")


