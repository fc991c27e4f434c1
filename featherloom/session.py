"""Session settings and the size checks every operator shares.

A cluster run reads its shared scratch folder from ``spark.checkpoint.dir``;
a local run without that setting gets a fresh folder under ``/tmp``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits, each overridable with spark.conf.set(<key>, <number>).
GROUP_ROWS = ("spark.featherloom.groupRowLimit", 2_000_000)
BROADCAST_ROWS = ("spark.featherloom.broadcastRowLimit", 100_000)
BROADCAST_BYTES = ("spark.featherloom.broadcastByteLimit", 64 * 1024 * 1024)
COLUMN_LIMIT = ("spark.featherloom.newColumnLimit", 2_000)

_local_dirs: dict[str, str] = {}


def get_session(app: str = "featherloom", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings this library is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def limit_of(spark: SparkSession, key: tuple[str, int]) -> int:
    return int(spark.conf.get(key[0], str(key[1])))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_copy(df: DataFrame) -> DataFrame | None:
    """The table as a broadcast-marked local relation when it is proven small, otherwise None.

    At most limit + 1 rows are read. Where there are texts or nested values their sizes are summed first, so that
    rows move only once they are known to fit, to the driver and to any task.
    """
    spark = df.sparkSession
    rows, size = limit_of(spark, BROADCAST_ROWS), limit_of(spark, BROADCAST_BYTES)
    wide = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    if wide:
        # Partial sums of whole partitions: no row is moved for them.
        n, total = df.agg(F.count(F.lit(1)), F.sum(sum((_bytes_of(f) for f in wide), F.lit(0)))).first()
        if n > rows or (total or 0) > size:
            return None
    table = df.limit(rows + 1).toArrow()
    if table.num_rows > rows or table.nbytes > size:
        return None
    return F.broadcast(spark.createDataFrame(table, df.schema))


def _bytes_of(field: T.StructField) -> Column:
    """The size of a text, or of a nested value written as JSON."""
    c = F.col("`" + field.name.replace("`", "``") + "`")
    flat = c if isinstance(field.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))
    return F.coalesce(F.octet_length(flat), F.lit(0)).cast("long")


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark for broadcast only after the size check; otherwise the join shuffles and AQE splits skew."""
    small = small_copy(df)
    return df if small is None else small
