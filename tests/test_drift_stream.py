"""Drift of a stream against the batch report of each window."""

import random

import pytest
from pyspark.sql import functions as F

from featherloom.operators import quality as Q
from featherloom.session import new_path
from featherloom.streaming import drift, monitor

SCHEMA = "ts timestamp_ntz, value double, kind string"


def rows(day, n, shift, kinds, seed):
    rng = random.Random(seed)
    return [(f"2024-02-{day:02d}T{rng.randrange(24):02d}:00:00", None if rng.random() < 0.1 else round(rng.gauss(shift, 1), 1), rng.choice(kinds)) for _ in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "t string, value double, kind string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "value", "kind")


def test_windows_equal_the_batch_report(spark):
    base = frame(spark, rows(1, 200, 0, ["a", "b", "c", None], 1))
    days = {2: rows(2, 60, 0, ["a", "b", "c"], 2), 3: rows(3, 40, 2, ["a", "new"], 3), 4: rows(4, 30, 0.3, ["c"], 4)}
    folder, out, checkpoint = (new_path(spark, n) for n in ("drift-in", "drift-out", "drift-state"))
    baseline = drift.Baseline(base, ["value", "kind"])

    def run():
        stream = monitor.read_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
        drift.start_drift_monitor(stream, baseline, out, checkpoint, "ts", refresh=None).awaitTermination()

    for d in (2, 3):
        frame(spark, days[d]).coalesce(1).write.mode("append").parquet(folder)
        run()
    frame(spark, days[4] + [("2024-02-02T01:00:00", 99.0, "late")]).coalesce(1).write.mode("append").parquet(folder)
    run()  # the late row belongs to a closed window
    everything = frame(spark, [r for d in days.values() for r in d])
    table = drift.drift_table(everything, baseline, out, "ts")
    found = {(r["window_start"].day, r["column"]): r for r in table.collect()}
    assert set(found) == {(d, c) for d in days for c in ("value", "kind")}
    assert {k[0]: r["state"] for k, r in found.items()} == {2: "closed", 3: "closed", 4: "open"}
    for d in days:
        want = {r["column"]: r for r in Q.detect_drift(base, frame(spark, days[d]), ["value", "kind"]).collect()}
        for c in ("value", "kind"):
            got = found[d, c]
            assert got["statistic"] == pytest.approx(want[c]["statistic"], abs=1e-9) and got["test"] == want[c]["test"]
            assert got["p_value"] == pytest.approx(want[c]["p_value"], abs=1e-9) and got["drift_detected"] == want[c]["drift_detected"]
