"""Linear models of all backtest folds from one pass over the rows.

A fold trains on a range of dates. What a linear, lasso or elastic-net fit needs of its rows are the sums of
products of every two columns. These are summed per date in one pass; running sums over the dates make a fold the
difference of two of them. A search over features and penalties fits every trial from the same sums. Neither
the passes over the rows nor what is written depends on the number of folds or trials.

Columns are centred and scaled by the whole table's mean and deviation first, so that the differences keep their digits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featherloom.operators.ordered import lookup_join, q
from featherloom.operators.profile import wide_aggregate
from featherloom.session import materialise

LINEAR = ("linear_regression", "lasso", "elastic_net")
_HELD = 64 << 20  # bytes of sums a task holds before it passes them on


@dataclass(frozen=True)
class Trial:
    """A model type with parameters over some of the features."""

    model_type: str
    features: tuple[str, ...]
    parameters: str = "{}"

    @classmethod
    def of(cls, model_type: str, features: Sequence[str], parameters: dict | None = None) -> Trial:
        return cls(model_type, tuple(features), json.dumps(parameters or {}, sort_keys=True))


def _penalty(trial: Trial) -> tuple[float, float, bool, int, float]:
    """(strength, share of the absolute part, intercept, sweeps, tolerance)."""
    p = json.loads(trial.parameters)
    strength = 0.0 if trial.model_type == "linear_regression" else float(p.get("alpha", 1.0))
    share = float(p.get("l1_ratio", 0.5)) if trial.model_type == "elastic_net" else 1.0
    return strength, share, bool(p.get("fit_intercept", True)), int(p.get("max_iter", 2000)), float(p.get("tol", 1e-12))


def solve(sums: np.ndarray, columns: Sequence[str], target: str, trial: Trial, centre: np.ndarray, scale: np.ndarray) -> tuple[float, list[float]] | None:
    """Intercept and a weight per column of ``columns`` (0 where the trial does not use it) from the sums of products.

    ``sums`` are of (1, columns, target), centred by ``centre`` and divided by ``scale``. Minimised is the squared error / 2n plus
    strength * (share * |w| + (1 - share) / 2 * w^2) in the columns' own units; without a penalty the least squares of least norm.
    """
    n = sums[0, 0]
    if n <= 0:
        return None
    strength, share, intercept, sweeps, tolerance = _penalty(trial)
    used = [columns.index(f) for f in trial.features]
    pick = np.array([*used, len(columns)])
    mean = sums[0, pick + 1] / n
    product = sums[np.ix_(pick + 1, pick + 1)] / n - np.outer(mean, mean)  # about the fold's own means
    unit = scale[pick]
    own_mean = centre[pick] + mean * unit
    product = product * np.outer(unit, unit)
    if not intercept:
        product = product + np.outer(own_mean, own_mean)
    xx, xy = product[:-1, :-1], product[:-1, -1]
    if strength == 0:
        deviation = np.where(unit[:-1] > 0, unit[:-1], 1.0)
        weights = np.linalg.lstsq(xx / np.outer(deviation, deviation), xy / deviation, rcond=1e-13)[0] / deviation
    else:
        weights = np.zeros(len(used))
        for _ in range(sweeps):
            before = weights.copy()
            for j in range(len(used)):
                rest = xy[j] - xx[j] @ weights + xx[j, j] * weights[j]
                below = xx[j, j] + strength * (1 - share)
                weights[j] = np.sign(rest) * max(abs(rest) - strength * share, 0.0) / below if below > 0 else 0.0
            if np.abs(weights - before).max(initial=0.0) <= tolerance * max(1.0, np.abs(weights).max(initial=0.0)):
                break
    full = np.zeros(len(columns))
    full[used] = weights
    return float(own_mean[-1] - own_mean[:-1] @ weights) if intercept else 0.0, full.tolist()


def date_sums(rows: DataFrame, date_column: str, columns: Sequence[str], centre: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(date, at, value): the sums of products of (1, columns) over each date; ``at`` numbers the cells of the upper triangle."""
    m = len(columns) + 1
    upper = np.triu_indices(m)
    schema = f"date {rows.schema[date_column].dataType.simpleString()}, at int, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        dates_type = None

        def flush() -> pa.RecordBatch:
            dates = pa.array(list(held), dates_type).take(pa.array(np.repeat(np.arange(len(held)), len(upper[0]))))
            values = np.concatenate([s[upper] for s in held.values()])
            return pa.RecordBatch.from_arrays([dates, pa.array(np.tile(np.arange(len(upper[0]), dtype=np.int32), len(held))), pa.array(values)], ["date", "at", "value"])

        for batch in batches:
            dates_type = batch.column(0).type
            table = np.ones((batch.num_rows, m))
            for i in range(1, m):
                table[:, i] = (batch.column(i).to_numpy(zero_copy_only=False) - centre[i - 1]) / scale[i - 1]
            coded = batch.column(0).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
            for k, date in enumerate(coded.dictionary):
                own = table[order[cut[k]: cut[k + 1]]]
                held[date] = held[date] + own.T @ own if date in held else own.T @ own
            if len(held) * m * m * 8 > _HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    values = [q(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)]
    return rows.select(q(date_column).alias("date"), *values).mapInArrow(run, schema).groupBy("date", "at").agg(F.sum("value").alias("value"))


def fold_models(rows: DataFrame, target: str, features: Sequence[str], date_column: str, numbered: DataFrame, bounds: DataFrame, trials: Sequence[Trial]) -> DataFrame:
    """(trial, fold, intercept, weights): every trial fitted on the training dates of every fold.

    ``rows`` have neither null features nor null targets; ``numbered`` is (date, __i) from 0; ``bounds`` is (fold, low, high): dates low <= __i < high train.
    """
    columns = [*features, target]
    stats = wide_aggregate(rows, {**{f"m{i}": F.avg(q(c).cast("double")) for i, c in enumerate(columns)}, **{f"s{i}": F.stddev_pop(q(c).cast("double")) for i, c in enumerate(columns)}})
    centre = np.array([stats[f"m{i}"] or 0.0 for i in range(len(columns))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(columns))])
    m = len(columns) + 1
    upper = np.triu_indices(m)
    sums = lookup_join(date_sums(rows, date_column, columns, centre, scale), numbered.withColumnRenamed(date_column, "date"), ["date"]).select("__i", "at", "value")
    upto = Window.partitionBy("at").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    running = materialise(sums.withColumn("value", F.sum("value").over(upto)), "date-sums")
    # A date without rows to train on has no sums: the last date before the bound that has some counts.
    days = running.select("__i").distinct()
    edges = bounds.select("fold", F.explode(F.array(F.struct(F.lit(1.0).alias("sign"), (F.col("high") - 1).alias("upto")), F.struct(F.lit(-1.0).alias("sign"), (F.col("low") - 1).alias("upto")))).alias("e")).select("fold", "e.sign", "e.upto")
    marks = edges.select("fold", "sign", "upto", F.lit(None).cast("long").alias("day")).unionByName(days.select(F.lit(None).cast("int").alias("fold"), F.lit(0.0).alias("sign"), F.col("__i").alias("upto"), F.col("__i").alias("day")))
    before = Window.orderBy("upto", F.col("fold").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # dates and folds only
    marks = marks.withColumn("day", F.last("day", ignorenulls=True).over(before)).where("fold IS NOT NULL AND day IS NOT NULL")
    parts = lookup_join(running.withColumnRenamed("__i", "day"), marks.groupBy("day").agg(F.collect_list(F.struct("fold", "sign")).alias("uses")), ["day"], "inner")
    parts = parts.select("at", "value", F.explode("uses").alias("u")).groupBy(F.col("u.fold").alias("fold"), "at").agg(F.sum(F.col("u.sign") * F.col("value")).alias("value"))
    names, wanted = list(columns[:-1]), list(trials)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((m, m))
        at = pdf["at"].to_numpy()
        table[upper[0][at], upper[1][at]] = pdf["value"].to_numpy()
        table = table + np.triu(table, 1).T
        found = [(k, solve(table, names, target, t, centre, scale)) for k, t in enumerate(wanted)]
        return pd.DataFrame([(k, int(pdf["fold"].iloc[0]), s[0], s[1]) for k, s in found if s is not None], columns=["trial", "fold", "intercept", "weights"])

    return materialise(parts.groupBy("fold").applyInPandas(fit, "trial int, fold int, intercept double, weights array<double>"), "fold-models")
