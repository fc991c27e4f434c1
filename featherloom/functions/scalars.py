"""Row-level expressions. All are built-in Spark functions, so they stay inside code generation."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.operators.ordered import q
from featherloom.params import ParameterError, is_numeric, need_columns, one_of

# Text formats of truncated dates.
TRUNCATED_FORMATS = {
    "year": "yyyy-01-01",
    "month": "yyyy-MM-01",
    "day": "yyyy-MM-dd",
    "hour": "yyyy-MM-dd HH:00:00",
    "minute": "yyyy-MM-dd HH:mm:00",
    "second": "yyyy-MM-dd HH:mm:ss",
}

# Period lengths of the cyclical encodings.
CYCLES = {"week": 52, "month": 12, "quarter": 4}

PERIOD_UNITS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}
PERIOD_STEPS = {
    "daily": "interval 1 day",
    "weekly": "interval 7 days",
    "monthly": "interval 1 month",
    "quarterly": "interval 3 months",
    "yearly": "interval 1 year",
}

# Names of the label bands.
COHENS_D_BANDS = [(0.2, "negligible"), (0.5, "small"), (0.8, "medium"), (None, "large")]
QUALITY_BANDS = [(0.9, "Excellent"), (0.75, "Good"), (0.6, "Fair"), (None, "Poor")]
AUC_BANDS = [(0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair"), (0.6, "Poor"), (None, "Very Poor (worse than random)")]


def trunc_date(df: DataFrame, date_col: str, truncate_to: str, output_col: str | None = None) -> DataFrame:
    """The result is text, as ``2024-01-01`` or ``2024-01-01 10:00:00``."""
    one_of(truncate_to, TRUNCATED_FORMATS, "truncate_to")
    need_columns(df, [date_col])
    return df.withColumn(output_col or date_col, F.date_format(q(date_col).cast("timestamp_ntz"), TRUNCATED_FORMATS[truncate_to]))


def period_start(column: Column, periodicity: str) -> Column:
    """Start of the day, week (Monday), month, quarter or year."""
    one_of(periodicity, PERIOD_UNITS, "periodicity")
    return F.date_trunc(PERIOD_UNITS[periodicity], column).cast("timestamp_ntz")


def _wave(column: Column, cycle: int) -> tuple[Column, Column]:
    angle = column * (2 * math.pi / cycle)
    return F.sin(angle), F.cos(angle)


def cyclical_time(df: DataFrame, datetime_column: str, granularity: str) -> DataFrame:
    one_of(granularity, CYCLES, "granularity")
    parts = {"week": F.weekofyear, "month": F.month, "quarter": F.quarter}
    sin, cos = _wave(parts[granularity](q(datetime_column)), CYCLES[granularity])
    stem = f"{datetime_column}_{granularity}"
    return df.withColumns({f"{stem}_sin": sin, f"{stem}_cos": cos})


def basic_calendar(df: DataFrame, datetime_column: str, holidays: Sequence[str] = ()) -> DataFrame:
    """Calendar columns of a date. ``holidays`` are ISO dates of the wanted countries."""
    need_columns(df, [datetime_column])
    d = q(datetime_column)
    day_of_week = F.weekday(d)
    month, week = F.month(d), F.weekofyear(d)
    out = {
        "month": month.cast("bigint"),
        "year": F.year(d).cast("bigint"),
        "week": week.cast("bigint"),
        "day_of_week": day_of_week.cast("bigint"),
        "day_of_month": F.dayofmonth(d).cast("bigint"),
        "day_of_year": F.dayofyear(d).cast("bigint"),
        "workday_of_month": day_of_week < 5,
        "is_weekend": day_of_week >= 5,
        "is_holiday": F.date_format(d, "yyyy-MM-dd").isin(list(holidays)) if holidays else F.lit(False),
        "is_first_day_of_month": F.dayofmonth(d) == 1,
        "is_last_day_of_month": F.to_date(d) == F.last_day(d),
        "is_mid_month": F.dayofmonth(d) > 15,
        "is_quarter_start": month % 3 == 1,
        "is_quarter_end": month % 3 == 0,
    }
    for name, value, cycle in (("month", month, 12), ("week", week, 52), ("day_of_week", day_of_week, 7)):
        out[f"sin_{name}"], out[f"cos_{name}"] = _wave(value, cycle)
    return df.withColumns(out)


def maths_transform(df: DataFrame, columns: Sequence[str], transformation: str) -> DataFrame:
    """square | cube | sqrt | log | inverse | inverse_sqrt | inverse_square as ``{col}_{name}``.

    Values outside a function's domain give null.
    """
    for c in need_columns(df, columns):
        if not is_numeric(df, c):
            raise ParameterError(f"column {c} is not numeric")

    def apply(c: Column) -> Column:
        x = c.cast("double")
        root = F.when(x >= 0, F.sqrt(x))
        return {
            "square": x * x,
            "cube": x * x * x,
            "sqrt": root,
            "log": F.when(x > 0, F.log(x)),
            "inverse": F.try_divide(F.lit(1.0), x),
            "inverse_sqrt": F.try_divide(F.lit(1.0), root),
            "inverse_square": F.try_divide(F.lit(1.0), x * x),
        }[one_of(transformation, ("square", "cube", "sqrt", "log", "inverse", "inverse_sqrt", "inverse_square"), "transformation")]

    return df.withColumns({f"{c}_{transformation}": apply(q(c)) for c in columns})


def flatten_json(df: DataFrame, column: str, schema: T.StructType | str | None = None, drop_source: bool = True) -> DataFrame:
    """JSON text to typed columns named ``column.path``; nested keys are dotted.

    Without a schema the keys of all rows are merged by a distributed aggregate.
    """
    need_columns(df, [column])
    if schema is None:
        schema = json_schema(df, column)
    parsed = F.from_json(q(column), schema)
    kind = df.select(parsed.alias("p")).schema["p"].dataType

    def leaves(struct: T.StructType, path: str, at: Column):
        for f in struct.fields:
            here, name = at.getField(f.name), f"{path}.{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, name, here)
            else:
                yield here.alias(name)

    staged = df.withColumn("__parsed", parsed)
    keep = [q(c) for c in df.columns if c != column or not drop_source]
    return staged.select(*keep, *leaves(kind, column, F.col("__parsed")))


def json_schema(df: DataFrame, column: str) -> str:
    """One type that holds every row's JSON, merged by a distributed aggregate."""
    text = df.agg(F.expr(f"schema_of_variant_agg(try_parse_json(`{column}`))")).first()[0]
    text = text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", text)


def parse_list(column: Column) -> Column:
    """List text to array<string>: a bracketed literal is parsed, anything else is split at commas."""
    text = F.trim(column)
    literal = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    return F.when(text.startswith("["), literal).otherwise(F.transform(F.split(column, ","), lambda x: F.trim(x)))


def split_part(column: Column, mark: str, index: int) -> Column:
    return F.get(F.split(column, mark), F.lit(index))


def row_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[q(c) for c in columns]))


def clip_zero(column: Column) -> Column:
    return F.greatest(column, F.lit(0.0))


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(q(c), F.lit(0).cast(df.schema[c].dataType)) for c in need_columns(df, columns)})


def band(column: Column, bands: Sequence[tuple[float | None, str]], ascending: bool) -> Column:
    """First band whose limit is not reached (ascending) or reached (descending)."""
    *limits, (_, rest) = bands
    out = None
    for limit, label in limits:
        test = column < limit if ascending else column >= limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(column.isNull(), F.lit(None)).otherwise(out.otherwise(rest))


def cohens_d_label(d: Column) -> Column:
    return band(F.abs(d), COHENS_D_BANDS, True)


def quality_grade(score: Column) -> Column:
    return band(score, QUALITY_BANDS, False)


def auc_label(auc: Column) -> Column:
    return band(auc, AUC_BANDS, False)
