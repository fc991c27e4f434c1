"""Drift of a stream against a baseline table, per time window and column.

The stream keeps a table of value counts per open window and column, Spark's own windowed state: it merges, so late rows and
restarts change nothing. When the watermark passes a window its counts are compared with the baseline's: Kolmogorov-Smirnov for
numbers, chi-square for everything else. The baseline is counted once and never copied per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.functions import tails
from featherloom.operators.ordered import from_naive_micros, literal_for, lookup_join, naive_micros, q, running
from featherloom.params import ParameterError, is_numeric, need_columns
from featherloom.session import materialise

_WINDOW = ["window_start", "window_end"]


def _items(df: DataFrame, columns: Sequence[str], kinds: dict[str, bool]) -> Column:
    def item(c: str) -> Column:
        value = q(c).cast("double") if kinds[c] else F.lit(None).cast("double")
        category = F.lit(None).cast("string") if kinds[c] else q(c).cast("string")
        return F.struct(F.lit(c).alias("column"), value.alias("value"), category.alias("category"))

    return F.explode(F.array(*[item(c) for c in columns])).alias("i")


def window_counts(df: DataFrame, timestamp: str, columns: Sequence[str], kinds: dict[str, bool], aggregation_window: str) -> DataFrame:
    """(window_start, window_end, column, value, category, c): counts only, so it works on streams and batches alike."""
    each = df.select(q(timestamp).alias("t"), _items(df, columns, kinds)).select("t", "i.*").where("value IS NOT NULL OR category IS NOT NULL")
    counts = each.groupBy(F.window("t", aggregation_window).alias("w"), "column", "value", "category").agg(F.count(F.lit(1)).alias("c"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "column", "value", "category", "c")


class Baseline:
    """The counts of a reference table: per number its running share, per category its count."""

    def __init__(self, table: DataFrame, columns: Sequence[str]):
        self.columns = list(need_columns(table, columns))
        if not self.columns:
            raise ParameterError("name at least one column")
        self.kinds = {c: is_numeric(table, c) for c in self.columns}
        each = table.select(_items(table, self.columns, self.kinds)).select("i.*").where("value IS NOT NULL OR category IS NOT NULL")
        self.counts = materialise(each.groupBy("column", "value", "category").agg(F.count(F.lit(1)).alias("r")), "drift-baseline")
        sums = self.counts.groupBy("column").agg(F.sum("r").alias("ref_n"), F.count(F.lit(1)).alias("ref_values"))
        self.totals = materialise(sums, "drift-baseline")

    def compare(self, counts: DataFrame, significance_level: float = 0.05) -> DataFrame:
        """One row per window and column of ``counts``: test, statistic, p_value, ref_n, cur_n, drift_detected."""
        group = [*_WINDOW, "column"]
        sums = counts.groupBy(*group).agg(F.sum("c").alias("cur_n"))
        # Numbers. Between two values of the window its distribution stands still and the baseline's only rises, so the largest
        # distance lies at or just before a value of the window: the baseline is looked up there only.
        mine = counts.where("value IS NOT NULL").drop("category")
        both = self.counts.where("value IS NOT NULL").select("column", "value", "r").unionByName(mine.select("column", "value", F.lit(0).cast("bigint").alias("r")))
        steps = running(both.groupBy("column", "value").agg(F.sum("r").alias("r")), ["column"], ["value"], {"upto_r": ("sum", F.col("r"))})
        placed = lookup_join(mine, steps, ["column", "value"])
        placed = running(placed, group, ["value"], {"upto_c": ("sum", F.col("c"))})
        placed = lookup_join(lookup_join(placed, sums, group), self.totals, ["column"])
        at = F.abs(F.col("upto_r") / F.col("ref_n") - F.col("upto_c") / F.col("cur_n"))
        before = F.abs((F.col("upto_r") - F.col("r")) / F.col("ref_n") - (F.col("upto_c") - F.col("c")) / F.col("cur_n"))
        ks = placed.groupBy(*group).agg(F.max(F.greatest(at, before)).alias("statistic"), F.max("ref_n").alias("ref_n"), F.max("cur_n").alias("cur_n"))
        ks = ks.withColumns({"test": F.lit("kolmogorov_smirnov"), "p_value": tails.ks_two_sample(F.col("statistic"), F.col("ref_n"), F.col("cur_n"), "asymptotic")})
        # Categories. Those the window lacks add their expected count each, together what the others leave of the total.
        mine = counts.where("category IS NOT NULL").drop("value")
        known = self.counts.where("category IS NOT NULL").select("column", "category", "r")
        placed = lookup_join(lookup_join(lookup_join(mine, known, ["column", "category"]), sums, group), self.totals, ["column"])
        expected = F.coalesce("r", F.lit(0)) * F.col("cur_n") / F.col("ref_n")
        term = F.when(expected > 0, F.pow(F.col("c") - expected, 2) / expected).otherwise(F.lit(float("inf")))
        new = F.count_if(F.col("r").isNull())
        chi = placed.groupBy(*group).agg(
            (F.sum(term) + F.greatest(F.max("cur_n") - F.sum(expected), F.lit(0.0))).alias("statistic"), (F.max("ref_values") + new - 1).alias("dof"),
            F.max("ref_n").alias("ref_n"), F.max("cur_n").alias("cur_n"),
        )
        chi = chi.withColumns({"test": F.lit("chi_square"), "p_value": tails.chi2_sf(F.col("statistic"), F.col("dof"))}).drop("dof")
        found = ks.unionByName(chi).withColumn("drift_detected", F.col("p_value") < significance_level)
        return found.select(*group, "test", "statistic", "p_value", "ref_n", "cur_n", "drift_detected")


def start_drift_monitor(
    stream: DataFrame, baseline: Baseline, path: str, checkpoint: str, timestamp: str, aggregation_window: str = "1 day", late_by: str = "1 hour",
    refresh: str | None = "1 minute", significance_level: float = 0.05,
):
    """Start the query; closed windows are appended under ``path``. ``refresh=None`` processes what is there and stops."""
    naive = isinstance(stream.schema[timestamp].dataType, T.TimestampNTZType)
    if naive:
        stream = stream.withColumn(timestamp, F.timestamp_micros(naive_micros(q(timestamp))))
    counts = window_counts(stream.withWatermark(timestamp, late_by), timestamp, baseline.columns, baseline.kinds, aggregation_window)
    if naive:
        counts = counts.withColumns({c: from_naive_micros(F.unix_micros(c)) for c in _WINDOW})

    def closed(batch: DataFrame, number: int) -> None:
        # A batch that is repeated after a failure replaces its own folder.
        stored = materialise(batch, "drift-windows")
        baseline.compare(stored, significance_level).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counts.writeStream.outputMode("append").foreachBatch(closed).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=refresh) if refresh else writer.trigger(availableNow=True)).start()


def drift_table(source: DataFrame, baseline: Baseline, path: str, timestamp: str, aggregation_window: str = "1 day", significance_level: float = 0.05) -> DataFrame:
    """Closed windows as the stream wrote them, and the open ones compared from newer source rows."""
    spark = source.sparkSession
    try:
        done = spark.read.parquet(path).drop("batch")
    except AnalysisException:  # no window has closed yet
        done = None
    end = None if done is None else done.agg(F.max("window_end")).first()[0]
    newer = source if end is None else source.where(q(timestamp) >= literal_for(source, timestamp, end))
    open_ = baseline.compare(materialise(window_counts(newer, timestamp, baseline.columns, baseline.kinds, aggregation_window), "drift-windows"), significance_level)
    open_ = open_.withColumn("state", F.lit("open"))
    return open_ if done is None else done.withColumn("state", F.lit("closed")).unionByName(open_)
