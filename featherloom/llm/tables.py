"""Small DataFrame helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.session import new_path, shuffle_partitions

__all__ = ["fresh", "need", "only", "partitions", "stored"]


def partitions(spark: SparkSession) -> int:
    return shuffle_partitions(spark)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read again."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that further columns of any name cannot clash."""
    need(df, *columns)
    return df.select(*[F.col(f"`{c}`") for c in columns])
