"""Series preparation: periods, dense calendars, future dates, calendar columns, segment filters.

A prepared series has one row per (dimensions, period), so its length is bounded by the
calendar: ``calendar_bound`` gives that bound to the window operators, which then need no
size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherloom.functions.scalars import PERIOD_STEPS, _wave, period_start, row_json
from featherloom.operators.ordered import literal_for, lookup_join, q
from featherloom.operators.relational import AGGREGATES
from featherloom.operators.windows import flag_distances
from featherloom.params import ParameterError, need_columns, one_of
from featherloom.session import broadcast_if_small

DIM_ID = "dim_uid"
_DAYS = {"daily": 1, "weekly": 7, "monthly": 28, "quarterly": 90, "yearly": 365}


def prepare_timeseries(
    df: DataFrame, date_column: str, dimensions: Sequence[str], metrics_name: str,
    aggregation_method: str = "sum", aggregated_metrics_name: str | None = None, periodicity: str = "daily",
) -> DataFrame:
    """One row per (period, dimensions) with one aggregated metric and ``dim_uid``."""
    need_columns(df, [date_column, *dimensions, metrics_name])
    fn = AGGREGATES[one_of(aggregation_method, ("sum", "mean", "min", "max", "count", "std", "var", "nunique"), "aggregation_method")]
    name = aggregated_metrics_name or metrics_name
    keyed = df.dropna(subset=[date_column, *dimensions])
    return (
        keyed.groupBy(period_start(q(date_column), periodicity).alias(date_column), *[q(d) for d in dimensions])
        .agg(fn(q(metrics_name), None).alias(name))
        .withColumn(DIM_ID, row_json(dimensions))
    )


def calendar_bound(df: DataFrame, date_column: str, periodicity: str = "daily") -> int:
    """The most rows a prepared series can have."""
    lo, hi = df.agg(F.min(q(date_column)), F.max(q(date_column))).first()
    return 0 if lo is None else (hi - lo).days // _DAYS[periodicity] + 1


def add_missing_dates(df: DataFrame, date_column: str, dimensions: Sequence[str], periodicity: str = "daily") -> DataFrame:
    """A row for every period from each series' first date to the last date of all; metrics null."""
    one_of(periodicity, PERIOD_STEPS, "periodicity")
    last = df.agg(F.max(q(date_column))).first()[0]
    if last is None:
        return df
    spans = df.groupBy(*[q(d) for d in dimensions]).agg(F.min(q(date_column)).alias("__first"))
    dates = F.sequence(F.col("__first"), literal_for(df, date_column, last), F.expr(PERIOD_STEPS[periodicity]))
    grid = spans.select(*[q(d) for d in dimensions], F.explode(dates).alias(date_column))
    out = grid.join(df, [*dimensions, date_column], "left")
    if DIM_ID in df.columns:
        out = out.withColumn(DIM_ID, row_json(dimensions))
    return out.select(*[q(c) for c in df.columns])


def add_inference_dates(
    df: DataFrame, last_date: str, date_column: str, dimensions: Sequence[str], metric_column: str, periodicity: str = "daily"
) -> DataFrame:
    """History plus, for every series, the periods after the last date of all up to ``last_date``, metric 0."""
    one_of(periodicity, PERIOD_STEPS, "periodicity")
    end = df.agg(F.max(q(date_column))).first()[0]
    start = literal_for(df, date_column, end) + F.expr(PERIOD_STEPS[periodicity])
    stop = literal_for(df, date_column, last_date)
    dates = F.when(start <= stop, F.sequence(start, stop, F.expr(PERIOD_STEPS[periodicity])))
    future = df.select(*[q(d) for d in dimensions]).distinct().select(
        *[q(d) for d in dimensions], F.explode(dates).alias(date_column), F.lit(0).cast(df.schema[metric_column].dataType).alias(metric_column)
    )
    if DIM_ID in df.columns:
        future = future.withColumn(DIM_ID, row_json(dimensions))
    return df.unionByName(future, allowMissingColumns=True)


# ---- calendar --------------------------------------------------------------------------

_FLAGS = ["is_holiday", "is_weekend", "is_mid_month", "is_first_workday_of_month", "is_last_workday_of_month", "is_first_workday_of_quarter"]


def build_calendar(df: DataFrame, date_column: str, holidays: Sequence[str] = (), distances: bool = True) -> DataFrame:
    """The calendar table for the date range of a column: one row per day."""
    lo, hi = df.agg(F.min(q(date_column)), F.max(q(date_column))).first()
    if lo is None:
        raise ParameterError(f"column {date_column} has no dates")
    first, last = (F.lit(v.strftime("%Y-%m-%d")).cast("timestamp_ntz") for v in (lo, hi))
    cal = df.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("date"))
    d = F.col("date")
    dow = F.weekday(d)
    cal = cal.withColumns({
        "month": F.month(d), "year": F.year(d), "week": F.weekofyear(d), "quarter": F.quarter(d),
        "day_of_week": dow, "day_of_month": F.dayofmonth(d), "day_of_year": F.dayofyear(d), "is_weekend": dow >= 5,
        "is_holiday": F.date_format(d, "yyyy-MM-dd").isin(list(holidays)) if holidays else F.lit(False),
    })
    cal = cal.withColumn("is_workday", ~F.col("is_weekend") & ~F.col("is_holiday"))
    work = F.when(F.col("is_workday"), F.lit(1))
    numbers = {}
    for unit in ("month", "quarter"):
        w = Window.partitionBy("year", unit)  # at most 92 days
        up = w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        down = w.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
        numbers[f"workday_of_{unit}"] = F.when(F.col("is_workday"), F.count(work).over(up))
        numbers[f"workday_of_{unit}_reverse"] = F.when(F.col("is_workday"), F.count(work).over(down))
    cal = cal.withColumns(numbers)
    flags = {}
    for unit in ("month", "quarter"):
        flags[f"is_first_workday_of_{unit}"] = F.coalesce(F.col(f"workday_of_{unit}") == 1, F.lit(False))
        flags[f"is_last_workday_of_{unit}"] = F.coalesce(F.col(f"workday_of_{unit}_reverse") == 1, F.lit(False))
    middle = (F.col("workday_of_month_reverse") - F.col("workday_of_month")).isin(0, 1)
    flags["is_mid_month"] = F.coalesce(middle, F.lit(False))
    waves = {}
    for name, cycle in (("month", 12), ("week", 52), ("day_of_week", 7), ("day_of_month", 31), ("day_of_year", 365)):
        waves[f"sin_{name}"], waves[f"cos_{name}"] = _wave(F.col(name), cycle)
    cal = cal.withColumns(flags).withColumns(waves)
    return flag_distances(cal, _FLAGS, "date", (hi - lo).days + 1) if distances else cal


def join_calendar(df: DataFrame, calendar: DataFrame, date_column: str = "date", renames: dict[str, str] | None = None) -> DataFrame:
    """Left join of calendar columns by day; calendar columns the table already has are dropped."""
    cal = calendar.withColumnsRenamed(renames or {})
    clash = [c for c in cal.columns if c in df.columns and c != "date"]
    cal = cal.drop(*clash).withColumnRenamed("date", "__day")
    out = df.join(broadcast_if_small(cal), F.date_trunc("day", q(date_column)).cast("timestamp_ntz") == F.col("__day"), "left")
    return out.drop("__day")


def custom_filter(
    df: DataFrame,
    workdays_to_include: Sequence[int] = (), workdays_reverse_to_include: Sequence[int] = (),
    workdays_to_exclude: Sequence[int] = (), workdays_reverse_to_exclude: Sequence[int] = (),
    keep_only_eom: bool = False, exclude_holidays: bool = False, exclude_weekends: bool = False,
    only_keep_workdays: bool = False, counterparties_to_keep: Sequence[str] = (),
    counterparties_to_remove: Sequence[str] = (), remove_zero_amount: bool = False,
    amount_col_name: str = "total_amount", counterparty_column: str = "custom_counterparty_name",
) -> DataFrame:
    """All switches become one conjunction. A missing workday number fails inclusion and passes exclusion."""
    tests: list[tuple[str, Column]] = []

    def when(on, column: str, test):
        if on:
            tests.append((column, test(q(column))))

    def among(values):
        return lambda c: F.coalesce(c.isin(list(values)), F.lit(False))

    def not_among(values):
        return lambda c: ~F.coalesce(c.isin(list(values)), F.lit(False))

    when(keep_only_eom, "is_last_workday_of_month", lambda c: c)
    when(workdays_to_include, "workday_of_month", among(workdays_to_include))
    when(workdays_reverse_to_include, "workday_of_month_reverse", among(workdays_reverse_to_include))
    when(workdays_to_exclude, "workday_of_month", not_among(workdays_to_exclude))
    when(workdays_reverse_to_exclude, "workday_of_month_reverse", not_among(workdays_reverse_to_exclude))
    when(exclude_holidays, "is_holiday", lambda c: ~c)
    when(exclude_weekends, "is_weekend", lambda c: ~c)
    when(only_keep_workdays, "is_workday", lambda c: c)
    names_kept, names_gone = ([n.lower() for n in v] for v in (counterparties_to_keep, counterparties_to_remove))
    when(names_kept, counterparty_column, lambda c: F.coalesce(F.lower(c).isin(names_kept), F.lit(False)))
    when(names_gone, counterparty_column, lambda c: ~F.coalesce(F.lower(c).isin(names_gone), F.lit(False)))
    when(remove_zero_amount, amount_col_name, lambda c: ~c.eqNullSafe(F.lit(0).cast("double")))
    need_columns(df, [c for c, _ in tests])
    for _, test in tests:
        df = df.where(test)
    return df


def segment_filter(
    df: DataFrame, segments: DataFrame, segments_to_keep: Sequence[str], date_column: str = "date",
    counterparty_column: str = "counterparty_id", direction_column: str = "direction",
    dim_value_column: str = "dim_value", segment_column: str = "segment", segment_date_column: str = "date",
) -> DataFrame:
    """Keep the rows whose (counterparty, direction, month) has one of the wanted segments; add the segment."""
    if not segments_to_keep:
        raise ParameterError("segments_to_keep is empty")
    parts = F.split(q(dim_value_column), "::")
    month = F.date_format(F.date_trunc("month", q(segment_date_column)), "yyyy-MM-dd")
    wanted = (
        segments.where(q(segment_column).isin(list(segments_to_keep)))
        .select(
            F.get(parts, F.lit(0)).alias("__cp"), F.get(parts, F.lit(1)).alias("__dir"),
            month.alias("__month"), q(segment_column).alias(segment_column),
        )
        .distinct()
    )
    keyed = df.withColumns({
        "__cp": q(counterparty_column).cast("string"), "__dir": q(direction_column).cast("string"),
        "__month": F.date_format(F.date_trunc("month", q(date_column)), "yyyy-MM-dd"),
    })
    return lookup_join(keyed, wanted, ["__cp", "__dir", "__month"], "inner").drop("__cp", "__dir", "__month")


