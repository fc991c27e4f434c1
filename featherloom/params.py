"""Parameter checks done when a plan is built, before any job runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class ParameterError(ValueError):
    """A step got parameters that cannot be applied to this table."""


def need_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    wanted = list(columns)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ParameterError(f"unknown columns: {missing}")
    return wanted


def one_of(value: str, allowed: Iterable[str], what: str) -> str:
    if value not in tuple(allowed):
        raise ParameterError(f"{what} must be one of {tuple(allowed)}, got {value!r}")
    return value


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMERIC)


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return [c for c in (columns or df.columns) if is_numeric(df, c)]
