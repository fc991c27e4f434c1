"""Tables behind cash-flow and forecast-error views. Directions are ``IN`` and ``OUT``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.operators.ordered import lookup_join, q
from featherloom.operators.relational import select_values
from featherloom.operators.windows import pareto
from featherloom.params import need_columns, one_of


def signed(direction: str, amount: str):
    """Positive for IN, negative for OUT, 0 for anything else."""
    d, a = q(direction), q(amount)
    return F.when(d == "IN", a).when(d == "OUT", -a).otherwise(F.lit(0.0))


def net_flow(df: DataFrame, account: str, date: str, direction: str, amount: str, aggregation: str = "sum") -> DataFrame:
    """Per account: the aggregate over dates of |sum(IN) - sum(OUT)|."""
    fn = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[one_of(aggregation, ("sum", "mean", "max", "min"), "aggregation")]
    per_date = df.groupBy(q(account), q(date)).agg(F.abs(F.sum(signed(direction, amount))).alias("flow"))
    return per_date.groupBy(q(account)).agg(fn("flow").alias("flow"))


def cumulative_accounts(df: DataFrame, account: str, date: str, direction: str, amount: str, aggregation: str = "sum", digits: int | None = None) -> DataFrame:
    """Accounts ranked by net flow with cumulative share and label."""
    flow = net_flow(df, account, date, direction, amount, aggregation)
    return pareto(flow if digits is None else flow.withColumn("flow", F.round("flow", digits)), account, "flow")


def volatility(df: DataFrame, account: str, direction: str, actual: str, abs_error: str) -> DataFrame:
    """Per account and direction: moments of the actuals, mean error, coefficient of variation (0 when the mean is 0)."""
    a = q(actual)
    out = df.groupBy(q(account), q(direction)).agg(
        F.avg(a).alias("mean_actuals"), F.stddev_samp(a).alias("std_actuals"), F.count(a).alias("count_transactions"),
        F.sum(a).alias("total_actuals"), F.avg(q(abs_error)).alias("mean_abs_error"),
    )
    return out.withColumn("volatility", F.when(F.col("mean_actuals") != 0, F.col("std_actuals") / F.col("mean_actuals")).otherwise(F.lit(0.0)))


def error_leaderboard(
    df: DataFrame, account: str, abs_error: str, actual: str, date: str, direction: str, credit: bool | None = None,
    best: bool = True, top_n: int | None = None,
) -> DataFrame:
    """Accounts by mean error, the best or the worst first, all or ``top_n``, with its spread and the count of non-zero actuals.

    Without a direction the actuals are first summed per date.
    """
    if credit is not None:
        df = df.where(q(direction) == ("IN" if credit else "OUT"))
    if credit is None:
        # error sums per date are kept, so mean and spread follow from one pass
        e = q(abs_error)
        daily = df.groupBy(q(account), q(date)).agg(F.sum(q(actual)).alias("__a"))
        counts = daily.groupBy(q(account)).agg(F.count_if(F.col("__a") != 0).alias("nonzero_actuals"))
        errors = df.groupBy(q(account)).agg(F.avg(e).alias("error_mean"), F.stddev_samp(e).alias("error_std"))
        ranked = errors.orderBy(F.col("error_mean").asc_nulls_last() if best else F.col("error_mean").desc_nulls_last(), q(account))
        ranked = ranked.limit(top_n) if top_n else ranked
        return lookup_join(ranked, counts, [account])
    out = df.groupBy(q(account)).agg(
        F.avg(q(abs_error)).alias("error_mean"), F.stddev_samp(q(abs_error)).alias("error_std"), F.count_if(q(actual) != 0).alias("nonzero_actuals")
    )
    ranked = out.orderBy(F.col("error_mean").asc_nulls_last() if best else F.col("error_mean").desc_nulls_last(), q(account))
    return ranked.limit(top_n) if top_n else ranked


def sums_by(df: DataFrame, x: str, ys: Sequence[str], selection: dict[str, Sequence] | None = None) -> DataFrame:
    """Sums of several series per x value after the selection, ordered by x."""
    need_columns(df, [x, *ys])
    return select_values(df, selection or {}).groupBy(q(x)).agg(*[F.sum(q(y)).alias(y) for y in ys]).orderBy(q(x))


def error_matrix(df: DataFrame, account: str, date: str, error: str, direction: str, credit: bool, wide: bool = False) -> DataFrame:
    """(account, date, error) of one direction; ``wide`` gives one column per date."""
    one = df.where(q(direction) == ("IN" if credit else "OUT"))
    if wide:
        return one.withColumn("__d", F.date_format(q(date), "yyyy-MM-dd")).groupBy(q(account)).pivot("__d").agg(F.sum(q(error)))
    return one.groupBy(q(account), q(date)).agg(F.sum(q(error)).alias("error"))


def signed_view(df: DataFrame, account: str, date: str, direction: str, amount: str, absolute: bool = False) -> DataFrame:
    """OUT amounts negated; rows of other directions are left out."""
    value = F.abs(q(amount)) if absolute else q(amount)
    return df.where(q(direction).isin("IN", "OUT")).select(
        q(account), q(date), q(direction), F.when(q(direction) == "OUT", -value).otherwise(value).alias("signed_amount")
    )


def labelled_pairs(df: DataFrame, account: str, date: str, direction: str, actual: str, forecast: str, error: str) -> DataFrame:
    """Actual / forecast pairs with a label; a direction other than IN or OUT raises at run time."""
    checked = F.when(q(direction).isin("IN", "OUT"), q(direction)).otherwise(
        F.raise_error(F.concat(F.lit("invalid direction: "), F.coalesce(q(direction), F.lit("null"))))
    )
    label = F.concat(q(account).cast("string"), F.lit(" ("), F.date_format(q(date), "yyyy-MM-dd"), F.lit(") - (error: "), q(error).cast("string"), F.lit(")"))
    return df.select(checked.alias("direction"), q(actual).alias("actual"), q(forecast).alias("forecast"), label.alias("label"))


def prediction_traces(df: DataFrame, dimensions: Sequence[str], split: str, date: str, actual: str, prediction: str) -> DataFrame:
    """Ordered actual and predicted values per series and split."""
    keys = [*dimensions, split, date]
    return df.select(*[q(k) for k in keys], q(actual), q(prediction)).orderBy(*[q(k) for k in keys])


def summarise_scores(scores: DataFrame, metric: str = "score_name", split: str = "split", fold: str = "fold", value: str = "score_value") -> DataFrame:
    """Mean over the folds of every metric and split, named ``metric__split``."""
    out = scores.groupBy(q(metric), q(split)).agg(F.avg(q(value)).alias("score_value"), F.count(F.lit(1)).alias("folds"))
    return out.select(F.concat_ws("__", q(metric), q(split)).alias("score_name"), "score_value", "folds")


def flatten_scores(scores: DataFrame, metric: str = "score_name", split: str = "split", fold: str = "fold", value: str = "score_value") -> DataFrame:
    """Score names as ``metric__split__fold``."""
    return scores.select(F.concat_ws("__", q(metric), q(split), q(fold).cast("string")).alias("score_name"), q(value).alias("score_value"))
