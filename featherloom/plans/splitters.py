"""Train / test and fold assignment as a column, never as lists of row positions.

Random order is a hash of the row key and the seed: the same rows get the same fold on every
run, retry and cluster size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.operators.ordered import literal_for, lookup_join, q, row_numbers
from featherloom.params import ParameterError, need_columns
from featherloom.session import materialise


def key_hash(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[q(k).cast("string") for k in keys], F.lit(str(seed))))


def _positions(df: DataFrame, keys: Sequence[str], shuffle: bool, seed: int, groups: Sequence[str] = ()) -> DataFrame:
    """0-based ``__p`` in key order or in shuffled order."""
    need_columns(df, keys)
    if shuffle:
        df = df.withColumn("__h", key_hash(keys, seed))
    order = ["__h", *keys] if shuffle else list(keys)
    return row_numbers(df, groups, order, "__p").withColumn("__p", F.col("__p") - 1).drop("__h")


def holdout(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """``split``: the last ``test_size`` share of the order is test."""
    if not 0 < test_size < 1:
        raise ParameterError("test_size must be between 0 and 1")
    cut = int(df.count() * (1 - test_size))
    return _positions(df, keys, shuffle, seed).withColumn("split", F.when(F.col("__p") < cut, "train").otherwise("test")).drop("__p")


def k_fold(df: DataFrame, keys: Sequence[str], n_splits: int = 5, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """``fold`` 0 .. k-1; sizes differ by at most one. Without shuffle, folds are consecutive blocks."""
    if n_splits < 2:
        raise ParameterError("n_splits must be at least 2")
    placed = _positions(df, keys, shuffle, seed)
    if shuffle:
        return placed.withColumn("fold", (F.col("__p") % n_splits).cast("int")).drop("__p")
    n = df.count()
    size, longer = n // n_splits, n % n_splits
    edge = longer * (size + 1)
    fold = F.when(F.col("__p") < edge, F.floor(F.col("__p") / (size + 1))).otherwise(longer + F.floor((F.col("__p") - edge) / max(size, 1)))
    return placed.withColumn("fold", fold.cast("int")).drop("__p")


def stratified_k_fold(df: DataFrame, label: str, keys: Sequence[str], n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Every label is dealt over the folds evenly."""
    return _positions(df, keys, True, seed, [label]).withColumn("fold", (F.col("__p") % n_splits).cast("int")).drop("__p")


def random_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Each row independently; no shuffle and no count."""
    share = F.conv(F.substring(key_hash(keys, seed), 1, 8), 16, 10).cast("double") / float(2**32)
    return df.withColumn("split", F.when(share < 1 - test_size, "train").otherwise("test"))


def series_holdout(df: DataFrame, date_column: str, holdout_size: int | float, ascending: bool = True) -> DataFrame:
    """Last n months (integer) or last share of the distinct dates (float) are test."""
    need_columns(df, [date_column])
    if not ascending:
        raise ParameterError("a descending holdout would test on the earliest dates; it is not supported")
    dates = df.select(q(date_column).alias("d")).where("d IS NOT NULL").distinct()
    if isinstance(holdout_size, int):
        n, last = dates.agg(F.count(F.lit(1)), F.max("d")).first()
        if holdout_size >= n:
            raise ParameterError(f"holdout_size must be smaller than the {n} dates")
        cut = F.date_trunc("month", F.add_months(literal_for(df, date_column, last), -(holdout_size - 1))).cast("timestamp_ntz")
    else:
        n = dates.count()
        at = row_numbers(dates, [], ["d"], "__n").where(F.col("__n") == int(n * (1 - holdout_size)) + 1).first()
        if at is None:
            raise ParameterError("holdout_size leaves no test dates")
        cut = literal_for(df, date_column, at["d"])
    return df.withColumn("split", F.when(q(date_column) < cut, "train").otherwise("test"))


@dataclass
class FoldDates:
    """The folds of a table's dates: ``numbered`` is (date, __i) from 0, everything else is arithmetic on the number."""

    date_column: str
    numbered: DataFrame
    dates: int
    folds: int
    steps: int
    horizon: int
    stride: int
    expanding: bool
    ascending: bool

    def _start(self, fold: Column) -> Column:
        return fold * self.stride if self.ascending else F.lit(self.dates - self.steps - self.horizon) - fold * self.stride

    def bounds(self) -> DataFrame:
        """(fold, low, high, last): dates low <= __i < high train, high <= __i < last validate."""
        fold, start = F.col("id").cast("int"), self._start(F.col("id"))
        low = F.lit(0).cast("long") if self.expanding else start
        return self.numbered.sparkSession.range(self.folds).select(fold.alias("fold"), low.alias("low"), (start + self.steps).alias("high"), (start + self.steps + self.horizon).alias("last"))

    def with_folds(self, df: DataFrame) -> DataFrame:
        """One row per (row, fold it belongs to); made while rows stream by, nothing is written or shuffled for it."""
        member = F.transform(F.sequence(F.lit(0), F.lit(self.folds - 1)), self._membership)
        places = self.numbered.select(q(self.date_column), F.filter(member, lambda m: m["split"].isNotNull()).alias("__m"))
        placed = lookup_join(df, places, [self.date_column], "inner").withColumn("__m", F.explode("__m"))
        return placed.withColumns({"fold": F.col("__m.fold"), "split": F.col("__m.split")}).drop("__m")

    def _membership(self, f: Column) -> Column:
        start, i = self._start(f), F.col("__i")
        first = F.lit(0) if self.expanding else start
        split = F.when((i >= first) & (i < start + self.steps), "train").when((i >= start + self.steps) & (i < start + self.steps + self.horizon), "validation")
        return F.struct(f.cast("int").alias("fold"), split.alias("split"))

    def ranges(self) -> list[dict]:
        """Per fold its first date, the first date that validates and the last one; a few values per fold."""
        at = lookup_join(self.bounds().select("fold", F.explode(F.array(F.col("low"), F.col("high"), F.col("last") - 1)).alias("__i")), self.numbered, ["__i"])
        found = at.groupBy("fold").agg(F.min(q(self.date_column)).alias("first"), F.max(q(self.date_column)).alias("last"), F.sort_array(F.collect_list(q(self.date_column)))[1].alias("validates"))
        return [r.asDict() for r in found.orderBy("fold").collect()]


def fold_dates(
    df: DataFrame, date_column: str, input_steps: int, forecast_horizon: int, stride: int = 1, expanding_window: bool = False,
    ascending: bool = True, min_backtest_iterations: int = 1,
) -> FoldDates:
    need_columns(df, [date_column])
    dates = df.select(q(date_column)).where(q(date_column).isNotNull()).distinct()
    numbered = materialise(row_numbers(dates, [], [date_column], "__i").select(q(date_column), (F.col("__i") - 1).alias("__i")), "dates")
    n = numbered.count()
    folds = (n - input_steps - forecast_horizon) // stride + 1
    if folds < max(min_backtest_iterations, 1):
        raise ParameterError(f"{folds} folds are possible, {min_backtest_iterations} are needed")
    return FoldDates(date_column, numbered, n, folds, input_steps, forecast_horizon, stride, expanding_window, ascending)


def backtest_folds(
    df: DataFrame, date_column: str, input_steps: int, forecast_horizon: int, stride: int = 1, expanding_window: bool = False,
    ascending: bool = True, min_backtest_iterations: int = 1,
) -> DataFrame:
    """One row per (row, fold it belongs to) with ``fold`` and ``split`` (train | validation).

    Dates get an index; the folds holding an index follow from arithmetic, so no range join is
    needed. Only the dates table is joined back, which has one row per distinct date.
    """
    return fold_dates(df, date_column, input_steps, forecast_horizon, stride, expanding_window, ascending, min_backtest_iterations).with_folds(df)
