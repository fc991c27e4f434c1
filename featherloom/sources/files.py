"""Readers and writers: CSV, Parquet datasets, filtered table scans, appends, packed feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.functions.scalars import row_json
from featherloom.operators.ordered import q
from featherloom.params import NUMERIC, ParameterError, need_columns
from featherloom.session import new_path


def load_csv(spark: SparkSession, path: str, nrows: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Header row, types from ``schema`` or inferred; ``nrows`` limits the rows."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = nan_to_null(reader.csv(path))
    return df if nrows is None else df.limit(nrows)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as null: aggregates skip null but carry NaN on."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(q(c)), q(c)) for c in floats}) if floats else df


def store_csv(df: DataFrame, label: str) -> str:
    path = new_path(df.sparkSession, f"{label}-csv")
    df.write.option("header", True).csv(path)
    return path


def column_kinds(df: DataFrame) -> DataFrame:
    """numeric | datetime | categorical for every column."""

    def kind(t: T.DataType) -> str:
        if isinstance(t, NUMERIC):
            return "numeric"
        return "datetime" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "categorical"

    rows = [(f.name, kind(f.dataType)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string")


class DatasetStore:
    """Parquet datasets by name under one folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or new_path(spark, "datasets")).rstrip("/")

    def path(self, name: str) -> str:
        if "/" in name or name.startswith("."):
            raise ParameterError(f"bad dataset name {name!r}")
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> str:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.path(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def fetch_table(source: DataFrame | str, filters: dict | None = None, spark: SparkSession | None = None) -> DataFrame:
    """A table by name or frame with AND-ed equality filters (pushed to the scan) and lower-cased names."""
    df = spark.table(source) if isinstance(source, str) else source
    for c, v in (filters or {}).items():
        need_columns(df, [c])
        df = df.where(q(c) == F.lit(v))
    return df.toDF(*[c.lower() for c in df.columns])


def scan_members(df: DataFrame, column: str, values: Sequence, columns: Sequence[str]) -> DataFrame:
    """Membership filter and column list, both applied at the scan."""
    return df.where(q(column).isin(list(values))).select(*[q(c) for c in columns])


def append_rows(df: DataFrame, label: str, path: str | None = None, partition_by: Sequence[str] = ()) -> str:
    """Append rows with a generated ``id`` and ``created_at`` where the table does not bring its own."""
    path = path or new_path(df.sparkSession, label)
    if "id" not in df.columns:
        df = df.withColumn("id", F.uuid())
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.localtimestamp())
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def pack_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per feature row: keys, the array of column names and the row as JSON text."""
    columns = list(columns or [c for c in df.columns if c not in keys])
    return df.select(*[q(k) for k in keys], F.array(*[F.lit(c) for c in columns]).alias("columns"), row_json(columns).alias("data"))


def unpack_features(packed: DataFrame, schema: T.StructType | str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """JSON feature rows back to typed columns; without a schema it is merged over all rows."""
    from featherloom.functions.scalars import json_schema

    parsed = packed.withColumn("__f", F.from_json("data", schema if schema is not None else json_schema(packed, "data")))
    return parsed.select(*[q(k) for k in keys], "__f.*")


