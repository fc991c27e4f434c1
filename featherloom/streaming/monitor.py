"""Model monitoring: metrics per time window from a stream, with a batch twin.

The stream appends a window's metrics to files once the watermark has passed it. Windows
still open are computed from the source by the same aggregate when the monitor is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.operators.ordered import from_naive_micros, literal_for, naive_micros, q
from featherloom.operators.quality import detect_drift


def window_metrics(df: DataFrame, timestamp: str, actual: str, prediction: str, aggregation_window: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    """Counts and error means per window; sums only, so it works on streams and batches alike."""
    y, p = q(actual).cast("double"), q(prediction).cast("double")
    e = y - p
    out = df.groupBy(F.window(q(timestamp), aggregation_window).alias("__w"), *[q(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("actual_mean"), F.avg(p).alias("prediction_mean"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(F.abs(e)).alias("__ae"), F.sum(F.abs(y)).alias("__ay"),
    )
    return out.select(
        F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[q(b) for b in by], "n", "actual_mean", "prediction_mean",
        "mae", "mse", F.sqrt("mse").alias("rmse"), F.try_divide("__ae", "__ay").alias("wmape"),
    )


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def start_monitor(
    stream: DataFrame, path: str, checkpoint: str, timestamp: str, actual: str, prediction: str, aggregation_window: str = "1 day",
    late_by: str = "1 hour", refresh: str | None = "1 minute", by: Sequence[str] = (),
):
    """Start the query. ``refresh=None`` processes what is there and stops. Rows later than ``late_by`` are dropped."""
    naive = isinstance(stream.schema[timestamp].dataType, T.TimestampNTZType)
    if naive:  # watermarks need a zoned timestamp: read the wall clock as UTC, whatever the session zone
        stream = stream.withColumn(timestamp, F.timestamp_micros(naive_micros(q(timestamp))))
    metrics = window_metrics(stream.withWatermark(timestamp, late_by), timestamp, actual, prediction, aggregation_window, by)
    if naive:
        metrics = metrics.withColumns({c: from_naive_micros(F.unix_micros(c)) for c in ("window_start", "window_end")})
    writer = metrics.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=refresh) if refresh else writer.trigger(availableNow=True)).start()


def monitor_table(
    closed: DataFrame, source: DataFrame, timestamp: str, actual: str, prediction: str, aggregation_window: str = "1 day", by: Sequence[str] = ()
) -> DataFrame:
    """Closed windows as the stream wrote them, plus the open ones computed from newer source rows."""
    end = closed.agg(F.max("window_end")).first()[0]
    newer = source if end is None else source.where(q(timestamp) >= literal_for(source, timestamp, end))
    done = closed.withColumn("state", F.lit("closed"))
    return done.unionByName(window_metrics(newer, timestamp, actual, prediction, aggregation_window, by).withColumn("state", F.lit("open")))


def drift_by_window(source: DataFrame, baseline: DataFrame, timestamp: str, columns: Sequence[str], first: str, last: str) -> DataFrame:
    """Drift of the rows in [first, last) against the baseline table, one row per column."""
    part = source.where((q(timestamp) >= literal_for(source, timestamp, first)) & (q(timestamp) < literal_for(source, timestamp, last)))
    return detect_drift(baseline, part, columns).drop("test")
