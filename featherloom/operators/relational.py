"""Projections, filters, joins, aggregations, sorts and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.operators.ordered import (
    earliest_by,
    latest_by,
    literal_for,
    lookup_join,
    order_columns,
    q,
    reversed_columns,
    row_numbers,
)
from featherloom.operators.quantiles import exact_quantiles
from featherloom.params import ParameterError, is_numeric, need_columns, numeric_columns, one_of
from featherloom.session import broadcast_if_small

# ---- projections -----------------------------------------------------------------------


def select_cols(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[q(c) for c in need_columns(df, columns)])


def drop_cols(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*need_columns(df, columns))


def rename_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Unknown names are ignored."""
    return df.withColumnsRenamed(columns)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def cast_types(df: DataFrame, columns: Sequence[str], new_type: str) -> DataFrame:
    """int | float | str | datetime | category. Content that cannot be cast raises at run time (ANSI)."""
    one_of(new_type, ("int", "float", "str", "datetime", "category"), "new_type")
    target = {"int": "bigint", "float": "double", "datetime": "timestamp_ntz"}

    def cast(c: str) -> Column:
        if new_type == "str":
            return F.coalesce(q(c).cast("string"), F.lit(""))
        return q(c).cast(target.get(new_type, "string"))

    return df.withColumns({c: cast(c) for c in need_columns(df, columns)})


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-null value, found in one pass."""
    flags = []
    for f in df.schema.fields:
        c = F.to_json(F.struct(q(f.name))) if isinstance(f.dataType, (T.MapType, T.VariantType)) else q(f.name)
        flags.append(F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f.name))
    row = df.agg(*flags).first()
    return [name for name, constant in zip(df.columns, row) if constant]


def drop_cols_zero_var(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def preview(df: DataFrame, order: Sequence[str], head: int, tail: int) -> DataFrame:
    """First and last rows of the given order."""
    flipped = [o[1:] if o.startswith("-") else f"-{o}" for o in order]
    first = df.orderBy(*order_columns(order)).limit(head).withColumn("part", F.lit("head"))
    last = df.orderBy(*order_columns(flipped)).limit(tail).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


# ---- filters ---------------------------------------------------------------------------


def filter_rows(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """Comparison by the column's kind; null rows stay only under ``!=``."""
    need_columns(df, [column])
    kind, c = df.schema[column].dataType, q(column)
    if isinstance(kind, T.BooleanType):
        one_of(operator, ("==", "!="), "operator")
        wanted = {"true": True, "false": False}.get(str(value).lower())
        if wanted is None:
            raise ParameterError(f"{column} is boolean; compare it with True or False, not {value!r}")
        return df.where(c == F.lit(wanted) if operator == "==" else ~c.eqNullSafe(F.lit(wanted)))
    if is_numeric(df, column):
        one_of(operator, ("==", "!=", ">", "<", ">=", "<="), "operator")
        v = _number(kind, value)
        tests = {"==": c == v, "!=": ~c.eqNullSafe(v), ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}
        return df.where(tests[operator])
    one_of(operator, ("==", "!=", "contains", "not contains", "startswith", "endswith"), "operator")
    text = str(value)
    match = F.coalesce(c.rlike(text), F.lit(False))
    tests = {
        "==": c == text,
        "!=": ~c.eqNullSafe(F.lit(text)),
        "contains": match,
        "not contains": ~match,
        "startswith": c.startswith(text),
        "endswith": c.endswith(text),
    }
    return df.where(tests[operator])


_WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _number(kind: T.DataType, value) -> Column:
    """A literal of the column's own type where the value is a whole number it can hold, otherwise a double.

    Large ids then compare exactly, and the comparison reaches the scan.
    """
    bits = _WHOLE.get(type(kind))
    exact = Decimal(str(value)) if bits else Decimal("NaN")
    if exact.is_finite() and exact == exact.to_integral_value() and -(2 ** (bits - 1)) <= exact < 2 ** (bits - 1):
        return F.lit(int(exact)).cast(kind)
    return F.lit(float(value))


def drop_rows_out_of_bounds(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    if lower > upper:
        raise ParameterError("lower must not exceed upper")
    return df.where(q(column).between(lower, upper))


def drop_rows_na(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    """An empty subset keeps every row for ``any`` and none for ``all``."""
    one_of(how, ("any", "all"), "how")
    if not columns:
        return df if how == "any" else df.where(F.lit(False))
    return df.dropna(how=how, subset=list(need_columns(df, columns)))


def drop_outliers_iqr(df: DataFrame, columns: Sequence[str], bounds: dict | None = None) -> DataFrame:
    """Keep rows inside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] of every numeric column of the unfiltered input."""
    bounds = bounds or iqr_bounds(df, columns)
    keep = [q(c).between(lo, hi) for c, (lo, hi) in bounds.items()]
    return df.where(reduce(lambda a, b: a & b, keep)) if keep else df


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    numeric = numeric_columns(df, need_columns(df, columns))
    if not numeric:
        return {}
    quarts = exact_quantiles(df, numeric, [0.25, 0.75])
    return {
        c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)) for c, (q1, q3) in quarts.items() if q1 is not None
    }


def drop_rare_labels(df: DataFrame, columns: Sequence[str], min_frequency: float = 0.01) -> DataFrame:
    """Keep rows whose label makes up at least ``min_frequency`` of the non-null labels, in every column.

    At most 1/min_frequency labels can qualify, so the keep-list is small by construction.
    """
    if not 0 < min_frequency <= 1:
        raise ParameterError("min_frequency must be in (0, 1]")
    columns = need_columns(df, columns)
    totals = df.agg(*[F.count(q(c)) for c in columns]).first()
    out = df
    for c, total in zip(columns, totals):
        counts = df.where(q(c).isNotNull()).groupBy(q(c)).count()
        keep = counts.where(F.col("count") / F.lit(max(total, 1)) >= min_frequency).select(q(c))
        out = out.join(broadcast_if_small(keep), c, "left_semi")
    return out


def select_values(df: DataFrame, selection: dict[str, Sequence]) -> DataFrame:
    """AND of membership tests; an empty list means no filter on that column."""
    for c, values in selection.items():
        need_columns(df, [c])
        if values:
            df = df.where(q(c).isin(list(values)))
    return df


def select_dates(df: DataFrame, date_column: str, first=None, last=None) -> DataFrame:
    """Inclusive date range, open on either side."""
    if first is not None:
        df = df.where(q(date_column) >= literal_for(df, date_column, first))
    if last is not None:
        df = df.where(q(date_column) <= literal_for(df, date_column, last))
    return df


def training_cutoff(df: DataFrame, date_column: str, last_test_date: str) -> DataFrame:
    return df.where(q(date_column) <= literal_for(df, date_column, last_test_date))


def inference_window(df: DataFrame, date_column: str, dates: Sequence[str] | None = None) -> DataFrame:
    """Rows between the given dates; without dates, the rows of the latest date only."""
    if dates:
        return select_dates(df, date_column, min(dates), max(dates))
    latest = df.agg(F.max(q(date_column)).alias("__latest"))
    return df.join(F.broadcast(latest), q(date_column) == F.col("__latest"), "left_semi")  # a one-row table


# ---- joins -----------------------------------------------------------------------------


def merge(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None, how: str = "left"
) -> DataFrame:
    """Equi join. Right columns that also exist on the left are dropped, join keys excepted.

    Keys with equal names appear once. Null keys match each other.
    """
    one_of(how, ("left", "right", "inner", "outer"), "how")
    right_on = list(right_on or left_on)
    need_columns(left, left_on), need_columns(right, right_on)
    shared = [c for c in right.columns if c in left.columns and c not in right_on]
    slim = right.drop(*shared)
    renamed = slim.withColumnsRenamed({k: f"__r_{k}" for k in right_on})
    side = broadcast_if_small(renamed)
    cond = reduce(
        lambda a, b: a & b, [left[f"`{lk}`"].eqNullSafe(side[f"`__r_{rk}`"]) for lk, rk in zip(left_on, right_on)]
    )
    if how in ("right", "outer"):
        # an inner or left join plus the unmatched right rows: AQE can split both halves when a key is hot
        left_part = left.join(side, cond, "inner" if how == "right" else "left")
        extra = side.join(left.select(*[q(k) for k in left_on]).distinct(), cond, "left_anti")
        empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
        joined = left_part.unionByName(extra.select(*empty, *[q(c) for c in renamed.columns]))
    else:
        joined = left.join(side, cond, how)
    out = []
    for c in left.columns:
        if c in left_on and right_on[list(left_on).index(c)] == c:
            out.append(F.coalesce(q(c), q(f"__r_{c}")).alias(c) if how in ("right", "outer") else q(c))
        else:
            out.append(q(c))
    for c in slim.columns:
        if c not in right_on:
            out.append(q(c))
        elif c not in left.columns:
            out.append(q(f"__r_{c}").alias(c))
    return joined.select(*out)


def concat(*frames: DataFrame) -> DataFrame:
    """Natural full outer join on all shared columns, folded over the frames; null keys match."""

    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ParameterError("frames share no column")
        return merge(a, b, shared, how="outer")

    return reduce(pair, frames)


def keep_members(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    return df.join(broadcast_if_small(values.select(q(column)).distinct()), column, "left_semi")


def drop_members(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Anti membership; rows with a null value are kept."""
    return df.join(broadcast_if_small(values.select(q(column)).distinct()), column, "left_anti")


# ---- aggregation -----------------------------------------------------------------------

AGGREGATES = {
    "sum": lambda c, o: F.coalesce(F.sum(c), F.lit(0)),
    "mean": lambda c, o: F.avg(c),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "count": lambda c, o: F.count(c),
    "nunique": lambda c, o: F.count_distinct(c),
    "std": lambda c, o: F.stddev_samp(c),
    "var": lambda c, o: F.var_samp(c),
    "size": lambda c, o: F.count(F.lit(1)),
    "any": lambda c, o: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
    "all": lambda c, o: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
    "first": lambda c, o: earliest_by(c, o),
    "last": lambda c, o: latest_by(c, o),
}


def aggregate(
    df: DataFrame,
    dimensions: Sequence[str],
    aggregations: Sequence[tuple],
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Named aggregates ``(column, function[, new name])``; rows with a null dimension are left out.

    ``first`` and ``last`` need ``order_by``. ``median`` is exact whatever the group size.
    Without dimensions the result is one row.
    """
    from featherloom.operators.quantiles import group_quantiles

    dims = need_columns(df, dimensions)
    named, medians = [], {}
    for column, fn, *new in aggregations:
        need_columns(df, [column])
        name = new[0] if new and new[0] else f"{fn}_{column}"
        if fn == "median":
            medians[name] = column
            continue
        one_of(fn, AGGREGATES, "aggregation")
        if fn in ("first", "last") and not order_by:
            raise ParameterError(f"{fn} needs order_by")
        named.append(AGGREGATES[fn](q(column), order_by).alias(name))
    keyed = df.dropna(subset=dims) if dims else df
    base = keyed.groupBy(*[q(d) for d in dims])
    out = base.agg(*named) if named else (base.agg(F.count(F.lit(1)).alias("__rows")) if dims else None)
    if medians and not dims:
        found = exact_quantiles(df, list(dict.fromkeys(medians.values())), [0.5])
        out = out if out is not None else df.agg(F.count(F.lit(1)).alias("__rows"))
        out = out.withColumns({n: F.lit(found[c][0]).cast("double") for n, c in medians.items()})
    elif medians:
        out = lookup_join(out, group_quantiles(keyed, dims, {name: (column, 0.5) for name, column in medians.items()}), dims)
    order = [(a[2] if len(a) > 2 and a[2] else f"{a[1]}_{a[0]}") for a in aggregations]
    return out.select(*[q(d) for d in dims], *[q(n) for n in order])


# ---- sorts, limits, top-k --------------------------------------------------------------


def sort(df: DataFrame, columns: Sequence[str], ascending: bool = True) -> DataFrame:
    """One direction for all columns, nulls last."""
    need_columns(df, columns)
    return df.orderBy(*order_columns([c if ascending else f"-{c}" for c in columns]))


def top_k(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    return df.orderBy(*order_columns(order)).limit(k)


def best_by(df: DataFrame, score: str, maximise: bool, *, id_column: str) -> DataFrame:
    """The row with the best score; equal scores go to the smallest id."""
    sign = -q(score) if maximise else q(score)
    best = df.where(q(score).isNotNull()).agg(F.min_by(F.struct("*"), F.struct(sign.alias("s"), q(id_column).alias("i"))).alias("r"))
    return best.where(F.col("r").isNotNull()).select("r.*")


# ---- de-duplication and latest rows ----------------------------------------------------


def drop_rows_duplicates(
    df: DataFrame, columns: Sequence[str], keep: str | bool = "first", order_by: Sequence[str] | None = None
) -> DataFrame:
    """Keep the first or last row of each set of duplicates, or none. No columns: nothing to do.

    First and last are a row-number filter, which Spark already applies before the shuffle
    (WindowGroupLimit); none is a combining aggregate. Either way copies do not pile up in a task.
    """
    if not columns:
        return df
    need_columns(df, columns)
    if keep in ("first", "last"):
        if not order_by:
            raise ParameterError("keep needs order_by")
        return _nth_row(df, columns, order_columns(order_by) if keep == "first" else reversed_columns(order_by), 1)
    row = F.struct(*[q(c) for c in df.columns])
    base = df.groupBy(*[q(c).alias(f"__k{i}") for i, c in enumerate(columns)])
    if keep not in (False, "none", "False"):
        raise ParameterError(f"keep must be first, last or none, got {keep!r}")
    return base.agg(F.count(F.lit(1)).alias("__n"), F.any_value(row).alias("__row")).where("__n = 1").select("__row.*")


def _nth_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*[q(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == n).drop("__rn")


def remove_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def qualify(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], asc: bool = False, target: int = 1) -> DataFrame:
    """The ``target``-th row of each partition in the given order.

    Each task passes on at most ``target`` rows per partition, so a hot partition stays small.
    Beyond the target Spark does that for, rows are numbered chunk by chunk.
    """
    order = [o if asc else f"-{o}" for o in order_by]
    if target <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return _nth_row(df, partition_by, order_columns(order), target)
    return row_numbers(df, partition_by, order, "__rn").where(F.col("__rn") == target).drop("__rn")


# ---- set operations --------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    """By column name; columns one side lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*[q(c) for c in columns]) if columns else df).distinct()


def new_values(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Distinct values of the current table that the reference lacks."""
    return current.select(q(column)).where(q(column).isNotNull()).distinct().join(
        reference.select(q(column)).distinct(), column, "left_anti"
    )
