"""The monitor stream over several files: closed windows, late rows, restart."""

import datetime as dt

from conftest import rows_of
from featherloom.session import new_path
from featherloom.streaming import monitor

SCHEMA = "ts timestamp_ntz, y double, p double"


def day(d, hour=12):
    return dt.datetime(2024, 1, d, hour)


def run(spark, folder, out, checkpoint):
    stream = monitor.read_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    monitor.start_monitor(stream, out, checkpoint, "ts", "y", "p", "1 day", "1 hour", None).awaitTermination()
    return spark.read.parquet(out)


def counts(df):
    return sorted((r["window_start"].day, r["n"]) for r in df.collect())


def test_windows_close_behind_the_watermark_and_late_rows_are_dropped(spark):
    folder, out, checkpoint = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    arrive([(day(1), 10.0, 8.0), (day(1, 20), 4.0, 5.0), (day(2), 1.0, 1.0)])
    closed = run(spark, folder, out, checkpoint)
    assert counts(closed) == [(1, 2)]
    first = closed.first()
    assert (first["mae"], first["mse"], first["wmape"]) == (1.5, 2.5, 3.0 / 14.0)

    # the restarted query goes on from its checkpoint; the row of day 1 is too late now
    arrive([(day(1, 3), 100.0, 0.0), (day(2, 18), 3.0, 1.0), (day(4), 2.0, 2.0)])
    closed = run(spark, folder, out, checkpoint)
    assert counts(closed) == [(1, 2), (2, 2)]

    source = spark.read.parquet(folder)
    table = monitor.monitor_table(closed, source, "ts", "y", "p", "1 day")
    assert counts(table) == [(1, 2), (2, 2), (4, 1)]
    assert {r["state"] for r in table.collect()} == {"closed", "open"}


def test_batch_twin_gives_the_same_windows(spark):
    rows = [(day(d, h), float(d * h), float(h)) for d in (1, 2, 3, 5) for h in (0, 5, 23)]
    folder, out, checkpoint = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    source = spark.createDataFrame(rows, SCHEMA)
    source.coalesce(1).write.parquet(folder)
    table = monitor.monitor_table(run(spark, folder, out, checkpoint), source, "ts", "y", "p", "1 day").drop("state")
    assert rows_of(table) == rows_of(monitor.window_metrics(source, "ts", "y", "p", "1 day"))
