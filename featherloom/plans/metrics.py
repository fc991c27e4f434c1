"""Scores, curves, confusion tables and residual views, each from one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherloom.functions.scalars import auc_label
from featherloom.operators.ordered import cumulative_counts, lookup_join, q
from featherloom.operators.profile import describe, histogram
from featherloom.operators.quantiles import exact_quantiles, grouped_quantiles
from featherloom.params import is_numeric, one_of

EPSILON = 2.220446049250313e-16  # smallest relative spacing of doubles


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae, r2, mape, wmape, residual mean and (population) spread per group, one aggregate."""
    y, p = q(actual).cast("double"), q(predicted).cast("double")
    e = y - p
    rows = df.where(e.isNotNull()).groupBy(*[q(b) for b in by])
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
        F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(y))).alias("wmape"),
        F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"), F.var_pop(y).alias("__var"),
    )
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": F.when(F.col("__var") > 0, 1 - F.col("mse") / F.col("__var"))}).drop("__var")


def _pinball(y: Column, p: Column, alpha: float) -> Column:
    return F.greatest(y - p, F.lit(0.0)) * alpha + F.greatest(p - y, F.lit(0.0)) * (1 - alpha)


def d2_pinball(df: DataFrame, actual: str, predicted: str, alpha: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """1 - pinball loss / loss of the constant alpha-quantile."""
    y, p = q(actual).cast("double"), q(predicted).cast("double")
    clean = df.where(y.isNotNull() & p.isNotNull())
    if by:
        base = lookup_join(clean, grouped_quantiles(clean, by, actual, {"__q": alpha}), list(by))
        level = F.col("__q")
    else:
        base, level = clean, F.lit(exact_quantiles(clean, [actual], [alpha])[actual][0]).cast("double")
    out = base.groupBy(*[q(b) for b in by]).agg(F.avg(_pinball(y, p, alpha)).alias("pinball"), F.avg(_pinball(y, level, alpha)).alias("baseline"))
    return out.withColumn("d2_pinball", 1 - F.try_divide("pinball", "baseline"))


def absolute_net_error(df: DataFrame, date: str, direction: str, actual: str, predicted: str, net_by_date: bool = False) -> DataFrame:
    """Mean |net actual - net forecast|. By default every (date, direction) sum counts on its own;
    ``net_by_date`` nets IN against OUT first."""
    sign = F.when(q(direction) == "OUT", -1).when(q(direction) == "IN", 1).otherwise(0)
    sums = df.groupBy(q(date), q(direction)).agg(F.sum(q(actual)).alias("a"), F.sum(q(predicted)).alias("p"))
    signed = sums.select(q(date).alias("d"), (sign * F.col("a")).alias("a"), (sign * F.col("p")).alias("p"))
    if net_by_date:
        signed = signed.groupBy("d").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    return signed.agg(F.avg(F.abs(F.col("a") - F.col("p"))).alias("absolute_net_error"))


# ---- classification --------------------------------------------------------------------


def confusion_matrix(df: DataFrame, actual: str, predicted: str, normalize: str | None = None) -> DataFrame:
    """(actual, predicted, n[, share]) of every combination that occurs; share within true, pred or all."""
    counts = df.where(q(actual).isNotNull() & q(predicted).isNotNull()).groupBy(q(actual).alias("actual"), q(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    if normalize is None:
        return counts
    one_of(normalize, ("true", "pred", "all"), "normalize")
    if normalize == "all":
        total = counts.agg(F.sum("n")).first()[0] or 1
        return counts.withColumn("share", F.col("n") / F.lit(total))
    side = "actual" if normalize == "true" else "predicted"
    sums = counts.groupBy(side).agg(F.sum("n").alias("__t"))
    return lookup_join(counts, sums, [side]).withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where undefined."""
    counts = confusion_matrix(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("actual").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
    )).alias("s")).select("s.*")
    out = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    precision, recall = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1).drop("called")


def classification_metrics(df: DataFrame, actual: str, predicted: str, positive=1) -> DataFrame:
    """Accuracy with the scores of the positive class when there are two classes, macro means otherwise."""
    per_class = class_metrics(df, actual, predicted)
    hot = F.col("class") == F.lit(positive)
    two = F.count(F.lit(1)) <= 2
    score = {m: F.when(two, F.coalesce(F.max(F.when(hot, F.col(m))), F.lit(0.0))).otherwise(F.avg(m)).alias(m) for m in ("precision", "recall", "f1")}
    return per_class.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *score.values(), F.sum("support").alias("n"))


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """``regression`` for a numeric target with more than 5 % distinct values."""
    got = df.where(q(target).isNotNull()).groupBy(q(target)).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("n"))
    ratio = F.coalesce(F.try_divide("unique_count", "n"), F.lit(0.0))
    kind = F.when(ratio > 0.05, "regression").otherwise("classification") if is_numeric(df, target) else F.lit("classification")
    return got.withColumns({"unique_ratio": ratio, "problem_type": kind})


def _threshold_counts(df: DataFrame, label: str, score: str, positive) -> tuple[DataFrame, int, int]:
    """Distinct scores with positives, negatives and their running sums from the highest score down."""
    hit = F.when(q(label) == F.lit(positive), 1).otherwise(0)
    counts = df.where(q(label).isNotNull() & q(score).isNotNull()).groupBy(q(score).alias("value")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    p, n = counts.agg(F.sum("pos"), F.sum("neg")).first()
    return cumulative_counts(counts, [], ["pos", "neg"], descending=True), p or 0, n or 0


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(threshold, tpr, fpr), one row per distinct score."""
    cum, p, n = _threshold_counts(df, label, score, positive)
    return cum.select(
        F.col("value").alias("threshold"), ((F.col("before_pos") + F.col("pos")) / F.lit(max(p, 1))).alias("tpr"), ((F.col("before_neg") + F.col("neg")) / F.lit(max(n, 1))).alias("fpr")
    )


def roc_summary(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Area under the curve, its label and the threshold with the largest tpr - fpr."""
    cum, p, n = _threshold_counts(df, label, score, positive)
    tpr, fpr = (F.col("before_pos") + F.col("pos")) / F.lit(max(p, 1)), (F.col("before_neg") + F.col("neg")) / F.lit(max(n, 1))
    area = F.sum(F.col("neg").cast("double") * (F.col("before_pos") + F.col("pos") / 2)) / F.lit(float(max(p, 1)) * max(n, 1))
    best = F.max_by(F.struct(F.col("value").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr")), F.struct((tpr - fpr).alias("j"), F.col("value").alias("v")))
    out = cum.agg(area.alias("auc"), best.alias("b")).select("auc", F.col("b.threshold").alias("best_threshold"), F.col("b.tpr").alias("best_tpr"), F.col("b.fpr").alias("best_fpr"))
    return out.withColumn("interpretation", auc_label(F.col("auc")))


def precision_recall_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    cum, p, _ = _threshold_counts(df, label, score, positive)
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    out = cum.select(F.col("value").alias("threshold"), (tp / (tp + fp)).alias("precision"), (tp / F.lit(max(p, 1))).alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def precision_recall_summary(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Average precision, trapezoid area, positive share and the threshold with the best F1."""
    cum, p, n = _threshold_counts(df, label, score, positive)
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    precision, recall = tp / (tp + fp), tp / F.lit(max(p, 1))
    gain = F.col("pos") / F.lit(max(p, 1))
    previous = F.coalesce(F.try_divide(F.col("before_pos"), F.col("before_pos") + F.col("before_neg")), F.lit(1.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    best = F.max_by(F.struct(F.col("value").alias("threshold"), precision.alias("p"), recall.alias("r"), f1.alias("f1")), F.struct(f1.alias("f"), F.col("value").alias("v")))
    out = cum.agg(F.sum(gain * precision).alias("average_precision"), F.sum(gain * (precision + previous) / 2).alias("pr_auc"), best.alias("b"))
    return out.select("average_precision", "pr_auc", F.lit(p / max(p + n, 1)).alias("baseline"), F.col("b.threshold").alias("best_threshold"), F.col("b.f1").alias("best_f1"))


# ---- residuals -------------------------------------------------------------------------


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Residual and its standardised form (population spread) on every row."""
    e = q(actual).cast("double") - q(predicted).cast("double")
    mean, std = df.agg(F.avg(e), F.stddev_pop(e)).first()
    return df.withColumn("residual", e).withColumn("standardised_residual", (F.col("residual") - F.lit(mean)) / F.lit(std or 1.0))


def residual_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = q(actual).cast("double") - q(predicted).cast("double")
    return describe(df.select(e.alias("residual")), ["residual"])


def residual_histogram(df: DataFrame, actual: str, predicted: str, bins: int = 30) -> DataFrame:
    e = q(actual).cast("double") - q(predicted).cast("double")
    return histogram(df.select(e.alias("residual")), "residual", bins)


def residual_quantiles(df: DataFrame, actual: str, predicted: str, points: int = 99) -> DataFrame:
    """Residual quantiles against standard normal quantiles on an even grid of probabilities."""
    e = q(actual).cast("double") - q(predicted).cast("double")
    probs = [(i + 1) / (points + 1) for i in range(points)]
    got = exact_quantiles(df.select(e.alias("residual")), ["residual"], probs)["residual"]
    rows = [(p, NormalDist().inv_cdf(p), v) for p, v in zip(probs, got)]
    return df.sparkSession.createDataFrame(rows, "probability double, theoretical double, observed double")


# ---- comparing models and runs ---------------------------------------------------------

HIGHER_IS_BETTER = ("r2", "accuracy", "precision", "recall", "f1", "d2_pinball")


def compare_models(df: DataFrame, model: str, actual: str, predicted: str, metrics: Sequence[str] = ("rmse", "mae", "r2")) -> DataFrame:
    """Metrics per model (long), rank per metric and the number of metrics each model wins."""
    wide = regression_metrics(df, actual, predicted, [model])
    long = wide.unpivot([q(model)], list(metrics), "metric", "value")
    goodness = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("metric").orderBy(goodness, q(model))  # one row per compared model
    ranked = long.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("wins", F.sum((F.col("rank") == 1).cast("bigint")).over(Window.partitionBy(q(model))))


def run_table(scores: DataFrame, run: str = "run_id", name: str = "score_name", value: str = "score_value", names: Sequence[str] | None = None, runs: Sequence | None = None) -> DataFrame:
    """One row per run, scores as columns."""
    picked = scores.where(q(run).isin(list(runs))) if runs else scores
    return picked.groupBy(q(run)).pivot(name, list(names) if names else None).agg(F.first(q(value)))


def search_runs(runs: DataFrame, condition: str | None = None, order_by: Sequence[str] = (), max_results: int | None = None) -> DataFrame:
    """Filter with a SQL condition over the run table's columns, order and limit."""
    found = runs.where(F.expr(condition)) if condition else runs
    keys = [q(o[1:]).desc_nulls_last() if o.startswith("-") else q(o).asc_nulls_last() for o in order_by]
    found = found.orderBy(*keys) if keys else found
    return found if max_results is None else found.limit(max_results)
