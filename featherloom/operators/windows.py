"""Ordered features per series: lags, rolling and running values, fills, distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featherloom.operators.ordered import (
    average_ranks,
    cumulative_counts,
    framed,
    group_bound,
    lookup_join,
    q,
    row_numbers,
    running,
    split_order,
    value_counts,
)
from featherloom.params import ParameterError, need_columns, one_of

ROLLING = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": F.count,
    "first": F.first_value,
    "last": F.last_value,
}


def lag(
    df: DataFrame,
    lags: dict[str, Sequence[int]],
    columns_to_order_by: Sequence[str],
    columns_to_partition_by: Sequence[str],
    fillna: bool = True,
    suffix: str | None = None,
    known_bound: int | None = None,
) -> DataFrame:
    """``{col}_lag_{n}[_{suffix}]`` per partition; missing lags become 0 unless ``fillna`` is off.

    Rows with a null partition key are left out.
    """
    need_columns(df, [*lags, *columns_to_order_by, *columns_to_partition_by])
    reach = max((n for ns in lags.values() for n in ns), default=0)
    tail = f"_{suffix}" if suffix else ""

    def build(w):
        out = {}
        for c, ns in lags.items():
            for n in ns:
                value = F.lag(q(c), n).over(w)
                out[f"{c}_lag_{n}{tail}"] = F.coalesce(value, F.lit(0).cast(df.schema[c].dataType)) if fillna else value
        return out

    keyed = df.dropna(subset=list(columns_to_partition_by)) if columns_to_partition_by else df
    return framed(keyed, columns_to_partition_by, columns_to_order_by, build, back=reach, known_bound=known_bound)


def rolling_features(
    df: DataFrame,
    target_column: str,
    partition_columns: Sequence[str],
    order_by_columns: Sequence[str],
    window_sizes: Sequence[int] = (7,),
    target_column_transformations: Sequence[str] = ("mean",),
    suffix: str = "",
    fillna: bool = True,
    known_bound: int | None = None,
) -> DataFrame:
    """Aggregates over the k rows before the current one; null (or 0) until k non-null rows exist."""
    need_columns(df, [target_column, *partition_columns, *order_by_columns])
    for fn in target_column_transformations:
        one_of(fn, ROLLING, "target_column_transformations")
    c = q(target_column)

    def build(w):
        out = {}
        for k in window_sizes:
            frame = w.rowsBetween(-k, -1)
            full = F.count(c).over(frame) == k
            for fn in target_column_transformations:
                value = F.when(full, ROLLING[fn](c).over(frame))
                name = f"rolling_{fn}_{target_column}_{k}_{suffix}"
                out[name] = F.coalesce(value.cast("double"), F.lit(0.0)) if fillna else value
        return out

    keyed = df.dropna(subset=list(partition_columns)) if partition_columns else df
    return framed(keyed, partition_columns, order_by_columns, build, back=max(window_sizes), known_bound=known_bound)


def cumulative_monthly_sum(
    df: DataFrame, target_column: str, partition_columns: Sequence[str], order_by_columns: Sequence[str],
    month_column: str = "month", year_column: str = "year", known_bound: int | None = None,
) -> DataFrame:
    """Sum of the earlier rows of the same month; 0 on its first row."""
    name = f"cumulative_monthly_sum_{target_column}"
    out = running(
        df, [*partition_columns, year_column, month_column], order_by_columns,
        {name: ("sum", q(target_column))}, include_current=False, known_bound=known_bound,
    )
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast(out.schema[name].dataType)))


def previous_month_aggregation(
    df: DataFrame, target_column: str, partition_columns: Sequence[str],
    target_column_transformations: Sequence[str] = ("mean",), window_sizes: Sequence[int] = (1,),
    month_column: str = "month", year_column: str = "year", fillna: bool = True,
) -> DataFrame:
    """Mean over the previous n observed months of a monthly aggregate, joined back to the rows."""
    keys = [*partition_columns, year_column, month_column]
    fns = {fn: ROLLING[one_of(fn, ("mean", "sum", "min", "max", "std", "var", "count"), "transformation")] for fn in target_column_transformations}
    keyed = df.dropna(subset=keys)
    monthly = keyed.groupBy(*[q(k) for k in keys]).agg(*[f(q(target_column)).alias(f"__{n}") for n, f in fns.items()])
    months = Window.partitionBy(*[q(k) for k in partition_columns]).orderBy(q(year_column), q(month_column))  # a few rows per year
    columns = {}
    for n in window_sizes:
        frame = months.rowsBetween(-n, -1)
        for fn in fns:
            value = F.when(F.count(f"__{fn}").over(frame) == n, F.avg(f"__{fn}").over(frame))
            columns[f"average_previous_{n}_{fn}_month_{target_column}"] = F.coalesce(value, F.lit(0.0)) if fillna else value
    monthly = monthly.withColumns(columns).drop(*[f"__{n}" for n in fns])
    return lookup_join(keyed, monthly, keys, "inner")


def series_age(df: DataFrame, datetime_column: str, dimension_columns: Sequence[str], output_column: str = "age", known_bound: int | None = None) -> DataFrame:
    """Running row number of each series."""
    return row_numbers(df, dimension_columns, [datetime_column], output_column, known_bound)


def recency(
    df: DataFrame, datetime_column: str, dimension_columns: Sequence[str], target_column: str,
    output_column: str = "recency", order_by: Sequence[str] = (), known_bound: int | None = None,
) -> DataFrame:
    """Rows since the last non-zero value before this row (since the series start when there is none)."""
    order = [datetime_column, *order_by]
    known_bound = group_bound(df, dimension_columns, known_bound)
    numbered = row_numbers(df, dimension_columns, order, "__rn", known_bound)
    last_hit = F.when(q(target_column) != 0, F.col("__rn"))
    out = running(numbered, dimension_columns, order, {"__hit": ("max", last_hit)}, include_current=False, known_bound=known_bound)
    rows = F.when(F.col("__rn") == 1, F.lit(0)).otherwise(F.col("__rn") - 1 - F.coalesce("__hit", F.lit(1)))
    return out.withColumn(output_column, rows.cast("bigint")).drop("__rn", "__hit")


def frequency(
    df: DataFrame, datetime_column: str, dimension_columns: Sequence[str], target_column: str,
    output_column: str = "frequency", order_by: Sequence[str] = (), known_bound: int | None = None,
) -> DataFrame:
    """Count of non-zero observations before this row."""
    hits = F.when(q(target_column) != 0, F.lit(1))
    return running(
        df, dimension_columns, [datetime_column, *order_by], {output_column: ("count", hits)},
        include_current=False, known_bound=known_bound,
    )


def remove_early_zeros(df: DataFrame, datetime_column: str, dimension_columns: Sequence[str], metric_column: str) -> DataFrame:
    """Rows from each series' first non-zero date on; all-zero series disappear."""
    first = (
        df.where(q(metric_column) != 0).groupBy(*[q(d) for d in dimension_columns]).agg(F.min(q(datetime_column)).alias("__first"))
    )
    return lookup_join(df, first, dimension_columns, "inner").where(q(datetime_column) >= F.col("__first")).drop("__first")


def flag_distances(df: DataFrame, columns: Sequence[str], date_column: str = "date", known_bound: int | None = None) -> DataFrame:
    """``distance_since_previous_*`` / ``distance_until_next_*`` in rows of the distinct-date calendar.

    Before the first flag, rows are counted from the start; after the last, from the end.
    """
    need_columns(df, [date_column, *columns])
    calendar = df.groupBy(q(date_column)).agg(*[F.max(q(c).cast("int")).alias(c) for c in columns])
    known_bound = group_bound(calendar, [], known_bound)
    ordered = row_numbers(calendar, [], [date_column], "__rn", known_bound)
    up = running(ordered, [], [date_column], {f"__p_{c}": ("max", F.when(q(c) == 1, F.col("__rn"))) for c in columns}, known_bound=known_bound)
    both = running(up, [], [f"-{date_column}"], {
        **{f"__n_{c}": ("min", F.when(q(c) == 1, F.col("__rn"))) for c in columns}, "__end": ("max", F.col("__rn")),
    }, known_bound=known_bound)
    features = both.select(
        q(date_column),
        *[(F.col("__rn") - F.coalesce(q(f"__p_{c}"), F.lit(1))).alias(f"distance_since_previous_{c}") for c in columns],
        *[(F.coalesce(q(f"__n_{c}"), F.col("__end")) - F.col("__rn")).alias(f"distance_until_next_{c}") for c in columns],
    )
    return lookup_join(df, features, [date_column])


def fill_along(
    df: DataFrame, columns: dict[str, str], group_by: Sequence[str], order_by: Sequence[str], known_bound: int | None = None
) -> DataFrame:
    """Ordered fills per group: ``ffill``, ``bfill`` or ``interpolate`` (linear by row position)."""
    need_columns(df, [*columns, *group_by, *[n for n, _ in split_order(order_by)]])
    if not order_by:
        raise ParameterError("ordered fills need order_by")
    back = [o[1:] if o.startswith("-") else f"-{o}" for o in order_by]
    for c, how in columns.items():
        one_of(how, ("ffill", "bfill", "interpolate"), "fill")
    known_bound = group_bound(df, group_by, known_bound)
    forward = {c: how for c, how in columns.items() if how != "bfill"}
    backward = {c: how for c, how in columns.items() if how != "ffill"}
    out = df
    straight = [c for c, how in columns.items() if how == "interpolate"]
    if straight:
        out = row_numbers(out, group_by, order_by, "__rn", known_bound)
    spots = {f"__pr_{c}": ("last", F.when(q(c).isNotNull(), F.col("__rn"))) for c in straight}
    if forward:
        out = running(out, group_by, order_by, {**{f"__p_{c}": ("last", q(c)) for c in forward}, **spots}, known_bound=known_bound)
    spots = {f"__nr_{c}": ("last", F.when(q(c).isNotNull(), F.col("__rn"))) for c in straight}
    if backward:
        out = running(out, group_by, back, {**{f"__n_{c}": ("last", q(c)) for c in backward}, **spots}, known_bound=known_bound)
    new = {}
    for c, how in columns.items():
        if how == "interpolate":
            p, n, pr, nr = (q(f"__{x}_{c}") for x in ("p", "n", "pr", "nr"))
            between = p + (n - p) * F.try_divide((F.col("__rn") - pr).cast("double"), (nr - pr).cast("double"))
            new[c] = F.when(q(c).isNotNull(), q(c)).when(n.isNull(), p).otherwise(between)
        else:
            new[c] = q(f"__p_{c}") if how == "ffill" else q(f"__n_{c}")
    return out.withColumns(new).select(*[q(c) for c in df.columns])


def pareto(df: DataFrame, label_column: str, amount: str) -> DataFrame:
    """Rows ranked by amount (largest first) with cumulative sum, share of the total and a label."""
    order = [f"-{amount}", f"-{label_column}"]
    total = df.agg(F.sum(q(amount))).first()[0]
    out = running(df, [], order, {"cum_flow": ("sum", q(amount)), "rank": ("count", F.lit(1))})
    return out.withColumns({
        "total": F.lit(total).cast("double"),
        "cum_pct": F.try_divide(F.col("cum_flow").cast("double"), F.lit(total).cast("double")),
        "label": F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" - "), q(label_column).cast("string"),
                          F.lit(" ( flow: "), q(amount).cast("string"), F.lit(")")),
    })


def rank_average(df: DataFrame, column: str, output_column: str = "rank") -> DataFrame:
    """Rank over the whole column, ties share the mean rank; null values get no rank."""
    ranks = average_ranks(df, column).select(F.col("value").alias(column), F.col("rank").alias(output_column))
    return lookup_join(df, ranks, [column])


def moving_average(
    df: DataFrame, keys: Sequence[str], step: str, value: str, smoothing_window: int = 10, output_column: str = "smoothed"
) -> DataFrame:
    """Centred moving average; null where the window is not full."""
    w2 = smoothing_window // 2
    frame = (-w2, smoothing_window - w2 - 1)

    def build(w):
        over = w.rowsBetween(*frame)
        return {output_column: F.when(F.count(q(value)).over(over) == smoothing_window, F.avg(q(value)).over(over))}

    return framed(df, keys, [step], build, back=w2, ahead=max(frame[1], 0))


def curve_change(df: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """First and last value of each curve and the change between them."""
    s = q(step)
    out = df.where(q(value).isNotNull()).groupBy(*[q(k) for k in keys]).agg(
        F.min_by(q(value), s).alias("first_value"), F.max_by(q(value), s).alias("last_value"),
        F.min(q(value)).alias("min_value"), F.max(q(value)).alias("max_value"), F.count(F.lit(1)).alias("steps"),
    )
    change = F.col("last_value") - F.col("first_value")
    return out.withColumns({"change": change, "change_pct": F.when(F.col("first_value") != 0, change / F.abs("first_value") * 100)})


def latest_fold(df: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """The row of the last fold for each key, found by a combining aggregate."""
    picked = df.groupBy(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(F.struct(*[q(c) for c in df.columns]), q(fold)).alias("__row")
    )
    return picked.select("__row.*")


def percentile_of_value(df: DataFrame, column: str, output_column: str = "percentile") -> DataFrame:
    """Share (in %) of rows at or below each row's value."""
    counts = cumulative_counts(value_counts(df, column), [], ["n"])
    n = df.count()
    share = counts.select(F.col("value").alias(column), ((F.col("before_n") + F.col("n")) / F.lit(max(n, 1)) * 100).alias(output_column))
    return lookup_join(df, share, [column])


