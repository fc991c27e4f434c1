"""Hypothesis tests, A/B comparison, confidence intervals, corrections.

The heavy part is one aggregate (moments, counts) or a table of distinct values with running
counts (ranks). Each function returns a small DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.functions import tails
from featherloom.functions.scalars import cohens_d_label
from featherloom.operators.ordered import cumulative_counts, lookup_join, q, running, value_counts
from featherloom.operators.quantiles import exact_quantiles, grouped_quantiles
from featherloom.params import ParameterError, need_columns, one_of

ALTERNATIVES = ("two-sided", "greater", "less")


def _num(c: str) -> Column:
    return q(c).cast("double")


def _pooled(n1, s1, n2, s2) -> Column:
    return F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))


# ---- hypothesis tests ------------------------------------------------------------------


def t_test(df: DataFrame, column1: str, column2: str, alternative: str = "two-sided") -> DataFrame:
    """Two columns, equal variances, nulls left out per column."""
    one_of(alternative, ALTERNATIVES, "alternative")
    a, b = _num(column1), _num(column2)
    m = df.agg(
        F.count(a).alias("n1"), F.avg(a).alias("mean1"), F.stddev_samp(a).alias("std1"),
        F.count(b).alias("n2"), F.avg(b).alias("mean2"), F.stddev_samp(b).alias("std2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    se = _pooled(n1, F.col("std1"), n2, F.col("std2")) * F.sqrt(1 / n1 + 1 / n2)
    m = m.withColumns({"mean_diff": F.col("mean1") - F.col("mean2"), "dof": n1 + n2 - 2})
    m = m.withColumn("statistic", F.try_divide(F.col("mean_diff"), se))
    return m.withColumn("p_value", tails.t_p_value(F.col("statistic"), F.col("dof"), alternative))


def chi_square_independence(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """Chi-square of a contingency table; 2 x 2 tables get the Yates correction.

    The sum over all cells is N * sum(O^2 / (R * C)) - N, so empty cells never need to be built.
    """
    cells = contingency(df, column1, column2)
    o, r, c, n = (F.col(x) for x in ("observed", "row_total", "column_total", "n"))
    dev = F.max(F.abs(o - r * c / n))
    rows = cells.groupBy("row").agg(F.first("row_total").alias("t")).agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("t")).alias("inv")).first()
    cols = cells.groupBy("column").agg(F.first("column_total").alias("t")).agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("t")).alias("inv")).first()
    dof = (rows["k"] - 1) * (cols["k"] - 1)
    plain = F.max(n) * F.sum(o.cast("double") * o / (r.cast("double") * c)) - F.max(n)
    yates = F.pow(F.greatest(dev - 0.5, F.lit(0.0)), 2) * F.max(n) * F.lit((rows["inv"] or 0.0) * (cols["inv"] or 0.0))
    out = cells.agg((yates if dof == 1 else plain).alias("statistic"), F.max(n).alias("n"))
    out = out.withColumn("dof", F.lit(dof).cast("bigint"))
    return out.withColumn("p_value", tails.chi2_sf(F.col("statistic"), F.col("dof")))


def contingency(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """Observed and expected count of every cell that occurs."""
    cells = df.dropna(subset=[column1, column2]).groupBy(q(column1).alias("row"), q(column2).alias("column")).agg(F.count(F.lit(1)).alias("observed"))
    n = cells.agg(F.sum("observed")).first()[0] or 0
    out = lookup_join(cells, cells.groupBy("row").agg(F.sum("observed").alias("row_total")), ["row"])
    out = lookup_join(out, cells.groupBy("column").agg(F.sum("observed").alias("column_total")), ["column"])
    return out.withColumns({"n": F.lit(n).cast("bigint"), "expected": F.col("row_total") * F.col("column_total") / F.lit(float(max(n, 1)))})


def anova(df: DataFrame, column: str, group_column: str) -> DataFrame:
    """One-way analysis of variance over the groups."""
    groups = group_moments(df, column, group_column)
    n, m, s = F.col("count"), F.col("mean"), F.coalesce(F.col("std"), F.lit(0.0))
    k, total, grand = groups.agg(F.count(F.lit(1)), F.sum(n), F.sum(n * m) / F.sum(n)).first()
    if k < 2:
        raise ParameterError("analysis of variance needs at least two groups")
    out = groups.agg(F.sum(n * F.pow(m - F.lit(grand), 2)).alias("ss_between"), F.sum((n - 1) * s * s).alias("ss_within"))
    out = out.withColumns({"n_groups": F.lit(k), "dof_between": F.lit(k - 1), "dof_within": F.lit(total - k)})
    f = F.try_divide(F.col("ss_between") / F.col("dof_between"), F.col("ss_within") / F.col("dof_within"))
    out = out.withColumn("statistic", f)
    return out.withColumn("p_value", tails.f_sf(F.col("statistic"), F.col("dof_between"), F.col("dof_within")))


def group_moments(df: DataFrame, column: str, group_column: str) -> DataFrame:
    x = _num(column)
    return df.dropna(subset=[column, group_column]).groupBy(q(group_column)).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def mann_whitney(df: DataFrame, column1: str, column2: str, alternative: str = "two-sided") -> DataFrame:
    """U of the first column; normal tail with tie and continuity correction."""
    one_of(alternative, ALTERNATIVES, "alternative")
    values = df.select(F.explode(F.array(
        F.struct(_num(column1).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(_num(column2).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")),
    )).alias("p")).select("p.*").where("v IS NOT NULL")
    counts = values.groupBy(F.col("v").alias("value")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = cumulative_counts(counts.withColumn("n", F.col("a") + F.col("b")), [], ["n"])
    n = F.col("n").cast("double")
    out = counts.agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * (F.col("before_n") + (n + 1) / 2)).alias("r1"), F.sum(n * n * n - n).alias("ties")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    u = {"two-sided": F.greatest(u1, n1 * n2 - u1), "greater": u1, "less": n1 * n2 - u1}[alternative]
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, spread)
    p = tails.normal_sf(z)
    p = F.least(F.lit(1.0), 2 * p) if alternative == "two-sided" else p
    medians = exact_quantiles(df, list(dict.fromkeys([column1, column2])), [0.5])
    return out.select(
        u1.alias("statistic"), p.alias("p_value"), "n1", "n2",
        F.lit(medians[column1][0]).cast("double").alias("median1"), F.lit(medians[column2][0]).cast("double").alias("median2"),
    )


def wilcoxon(df: DataFrame, column1: str, column2: str, alternative: str = "two-sided") -> DataFrame:
    """Signed ranks of the differences of complete pairs, zero differences left out."""
    one_of(alternative, ALTERNATIVES, "alternative")
    d = _num(column1) - _num(column2)
    diffs = df.select(d.alias("d")).where("d IS NOT NULL")
    pairs = diffs.count()
    counts = diffs.where("d <> 0").groupBy(F.abs("d").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus")
    )
    counts = cumulative_counts(counts, [], ["n"])
    rank, n = F.col("before_n") + (F.col("n") + 1) / 2, F.col("n").cast("double")
    out = counts.agg(
        F.sum("n").alias("n"), F.sum(rank * F.col("plus")).alias("w_plus"), F.sum(rank * F.col("minus")).alias("w_minus"), F.sum(n * n * n - n).alias("ties")
    )
    m = F.col("n").cast("double")
    spread = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("ties") / 2) / 24)
    z = F.try_divide(F.col("w_plus") - m * (m + 1) / 4, spread)
    statistic = F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    return out.select(
        statistic.alias("statistic"), tails.normal_p_value(z, alternative).alias("p_value"), F.lit(pairs).alias("n_pairs"), z.alias("z"), "w_plus", "w_minus"
    )


def kruskal(df: DataFrame, column: str, group_column: str) -> DataFrame:
    """H with tie correction."""
    counts = value_counts(df.dropna(subset=[group_column]), column, [group_column])
    ranked = cumulative_counts(counts.groupBy("value").agg(F.sum("n").alias("m")), [], ["m"])
    m = F.col("m").cast("double")
    total, ties = ranked.agg(F.sum("m"), F.sum(m * m * m - m)).first()
    ranks = ranked.select("value", (F.col("before_m") + (F.col("m") + 1) / 2).alias("rank"))
    sums = lookup_join(counts, ranks, ["value"]).groupBy(q(group_column)).agg(F.sum(F.col("rank") * F.col("n")).alias("r"), F.sum("n").alias("n"))
    out = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("n_groups"))
    n = float(total)
    h = (F.lit(12.0 / (n * (n + 1))) * F.col("s") - 3 * (n + 1)) / F.lit(1 - float(ties) / (n**3 - n))
    out = out.select(h.alias("statistic"), "n_groups")
    return out.withColumn("p_value", tails.chi2_sf(F.col("statistic"), F.col("n_groups") - 1))


def group_medians(df: DataFrame, column: str, group_column: str) -> DataFrame:
    clean = df.dropna(subset=[column, group_column])
    counts = clean.groupBy(q(group_column)).agg(F.count(F.lit(1)).alias("count"))
    return lookup_join(counts, grouped_quantiles(clean, [group_column], column, {"median": 0.5}), [group_column])


# ---- A/B comparison --------------------------------------------------------------------


def _two_groups(df: DataFrame, group: str, metric: str, control: str, treatment: str, aggs: dict) -> DataFrame:
    """One row with the aggregates of both groups, prefixed control_ / treatment_."""
    x, g = _num(metric), q(group).cast("string")
    out = {}
    for prefix, name in (("control", str(control)), ("treatment", str(treatment))):
        value = F.when(g == name, x)
        out.update({f"{prefix}_{k}": fn(value) for k, fn in aggs.items()})
    return df.where(g.isin(str(control), str(treatment))).agg(*[c.alias(k) for k, c in out.items()])


def ab_test_continuous(df: DataFrame, group_column: str, metric_column: str, control: str, treatment: str, alpha: float = 0.05) -> DataFrame:
    """Pooled t, Cohen's d with label, interval of the difference, relative lift."""
    need_columns(df, [group_column, metric_column])
    aggs = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    m = _two_groups(df, group_column, metric_column, control, treatment, aggs)
    n1, n2, m1, m2 = (F.col(c) for c in ("control_n", "treatment_n", "control_mean", "treatment_mean"))
    m = m.withColumn("pooled_std", _pooled(n1, F.col("control_std"), n2, F.col("treatment_std")))
    m = m.withColumns({"difference": m2 - m1, "se": F.col("pooled_std") * F.sqrt(1 / n1 + 1 / n2), "dof": n1 + n2 - 2})
    m = m.withColumns({
        "statistic": F.try_divide(m1 - m2, F.col("se")),
        "cohens_d": F.when(F.col("pooled_std") > 0, F.col("difference") / F.col("pooled_std")).otherwise(F.lit(0.0)),
        "relative_lift_pct": F.when(m1 != 0, F.col("difference") / m1 * 100).otherwise(F.lit(0.0)),
        "margin": tails.t_ppf(1 - alpha / 2, F.col("dof")) * F.col("se"),
    })
    return m.withColumns({
        "p_value": tails.t_p_value(F.col("statistic"), F.col("dof")), "ci_lower": F.col("difference") - F.col("margin"),
        "ci_upper": F.col("difference") + F.col("margin"), "effect": cohens_d_label(F.col("cohens_d")),
    })


def ab_test_binary(df: DataFrame, group_column: str, metric_column: str, control: str, treatment: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Two-proportion z (pooled), unpooled interval, lift, smallest detectable effect."""
    need_columns(df, [group_column, metric_column])
    m = _two_groups(df, group_column, metric_column, control, treatment, {"n": F.count, "successes": F.sum})
    n1, n2 = F.col("control_n"), F.col("treatment_n")
    m = m.withColumns({"control_rate": F.try_divide("control_successes", n1), "treatment_rate": F.try_divide("treatment_successes", n2)})
    r1, r2 = F.col("control_rate"), F.col("treatment_rate")
    pooled = (F.col("control_successes") + F.col("treatment_successes")) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    z = F.when(se > 0, (r2 - r1) / se).otherwise(F.lit(0.0))
    za, zb = tails.normal_ppf_value(1 - alpha / 2), tails.normal_ppf_value(power)
    margin = F.sqrt(r1 * (1 - r1) / n1 + r2 * (1 - r2) / n2) * za
    mde = F.sqrt(r1 * (1 - r1) * (1 / n1 + 1 / n2)) * (za + zb)
    m = m.withColumns({"difference": r2 - r1, "statistic": z, "margin": margin, "min_detectable_effect": mde})
    return m.withColumns({
        "p_value": tails.normal_p_value(F.col("statistic")), "ci_lower": F.col("difference") - F.col("margin"), "ci_upper": F.col("difference") + F.col("margin"),
        "relative_lift_pct": F.when(r1 > 0, F.col("difference") / r1 * 100).otherwise(F.lit(0.0)),
    })


# ---- confidence intervals --------------------------------------------------------------


def _bounds(df: DataFrame, centre: Column, margin: Column) -> DataFrame:
    return df.withColumns({"margin": margin, "lower": centre - margin, "upper": centre + margin})


def ci_mean(df: DataFrame, column: str, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Student t interval, for the table or per group."""
    x = _num(column)
    m = df.groupBy(*[q(b) for b in by]).agg(F.count(x).alias("n"), F.avg(x).alias("estimate"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("standard_error"))
    return _bounds(m, F.col("estimate"), tails.t_ppf(0.5 + confidence / 2, F.col("n") - 1) * F.col("standard_error"))


def _wilson(p: Column, n: Column, z: float) -> tuple[Column, Column]:
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    return centre, z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / base


def ci_proportion(df: DataFrame, column: str, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Wilson score interval, kept inside [0, 1]."""
    x = _num(column)
    m = df.groupBy(*[q(b) for b in by]).agg(F.count(x).alias("n"), F.sum(x).cast("bigint").alias("successes"))
    m = m.withColumn("estimate", F.try_divide("successes", "n"))
    centre, margin = _wilson(F.col("estimate"), F.col("n"), tails.normal_ppf_value(0.5 + confidence / 2))
    return m.withColumns({"margin": margin, "lower": F.greatest(F.lit(0.0), centre - margin), "upper": F.least(F.lit(1.0), centre + margin)})


def values_at_ranks(df: DataFrame, column: str, ranks: DataFrame) -> DataFrame:
    """The value at each 0-based rank of a column (``ranks`` has one bigint column ``rank``).

    Ranks and value groups are merged along one order and the last value seen is carried on.
    """
    counts = cumulative_counts(value_counts(df, column), [], ["n"])
    lo, hi = ranks.agg(F.min("rank"), F.max("rank")).first()
    near = counts.where((F.col("before_n") <= hi) & (F.col("before_n") + F.col("n") > lo))
    groups = near.select(F.col("before_n").alias("pos"), F.lit(0).alias("kind"), F.col("value").cast("double").alias("value"))
    wanted = ranks.select(F.col("rank").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("value")).distinct()
    carried = running(groups.unionByName(wanted), [], ["pos", "kind"], {"found": ("last", F.col("value"))})
    return carried.where("kind = 1").select(F.col("pos").alias("rank"), F.col("found").alias("value"))


def ci_median(df: DataFrame, column: str, confidence: float = 0.95, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile bootstrap of the median.

    The middle order statistics of a resample of n rows are drawn directly: uniform order
    statistics are beta distributed, and row floor(n * u) of the sorted column is what the
    resample holds there. So a replicate needs two ranks, whatever n is.
    """
    clean = df.where(q(column).isNotNull())
    n = clean.count()
    if not n:
        raise ParameterError("no values")
    rng = np.random.default_rng(seed)
    k = (n + 1) // 2  # 1-based lower middle
    u1 = rng.beta(k, n - k + 1, resamples)
    u2 = 1 - (1 - u1) * rng.uniform(size=resamples) ** (1.0 / (n - k)) if n % 2 == 0 else u1
    low, high = ((np.minimum(u, 1 - 1e-16) * n).astype("int64").clip(0, n - 1) for u in (u1, u2))
    draws = df.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(low, high)], "a bigint, b bigint")
    values = values_at_ranks(clean, column, draws.select(F.explode(F.array("a", "b")).alias("rank")))
    medians = lookup_join(draws, values.select(F.col("rank").alias("a"), F.col("value").alias("va")), ["a"])
    medians = lookup_join(medians, values.select(F.col("rank").alias("b"), F.col("value").alias("vb")), ["b"])
    half = (1 - confidence) / 2
    middle = exact_quantiles(clean, [column], [0.5])[column][0]
    out = medians.agg(F.percentile((F.col("va") + F.col("vb")) / 2, [half, 1 - half]).alias("p"))
    return out.select(F.lit(middle).cast("double").alias("estimate"), F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"), F.lit(n).alias("n"))


def ci_std(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """Chi-square interval of the standard deviation."""
    x = _num(column)
    m = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("estimate"))
    half = (1 - confidence) / 2
    spread = (F.col("n") - 1) * F.col("estimate") * F.col("estimate")
    return m.withColumns({
        "lower": F.sqrt(spread / tails.chi2_ppf(1 - half, F.col("n") - 1)), "upper": F.sqrt(spread / tails.chi2_ppf(half, F.col("n") - 1)),
    })


def ci_difference(df: DataFrame, column: str, group_column: str, confidence: float = 0.95) -> DataFrame:
    """Difference of the means of exactly two groups (second minus first by name), pooled variance."""
    groups = group_moments(df, column, group_column).orderBy(q(group_column)).limit(3).collect()
    if len(groups) != 2:
        raise ParameterError("a difference needs exactly two groups")
    (g1, n1, m1, s1), (g2, n2, m2, s2) = (tuple(r) for r in groups)
    m = df.sparkSession.createDataFrame([(str(g1), str(g2), n1, n2, m1, m2, s1, s2)], "group1 string, group2 string, n1 bigint, n2 bigint, mean1 double, mean2 double, std1 double, std2 double")
    pooled = _pooled(F.col("n1"), F.col("std1"), F.col("n2"), F.col("std2"))
    m = m.withColumns({"estimate": F.col("mean2") - F.col("mean1"), "standard_error": pooled * F.sqrt(1 / F.col("n1") + 1 / F.col("n2"))})
    return _bounds(m, F.col("estimate"), tails.t_ppf(0.5 + confidence / 2, F.col("n1") + F.col("n2") - 2) * F.col("standard_error"))


# ---- one-sample tests ------------------------------------------------------------------


def one_sample_t(df: DataFrame, column: str, test_value: float, alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    one_of(alternative, ALTERNATIVES, "alternative")
    x = _num(column)
    m = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    m = m.withColumns({"standard_error": F.col("std") / F.sqrt("n"), "difference": F.col("mean") - test_value, "dof": F.col("n") - 1})
    m = m.withColumns({
        "statistic": F.try_divide("difference", "standard_error"),
        "cohens_d": F.when(F.col("std") > 0, F.col("difference") / F.col("std")).otherwise(F.lit(0.0)),
    })
    m = _bounds(m, F.col("mean"), tails.t_ppf(1 - alpha / 2, F.col("dof")) * F.col("standard_error"))
    return m.withColumns({"p_value": tails.t_p_value(F.col("statistic"), F.col("dof"), alternative), "effect": cohens_d_label(F.col("cohens_d"))})


def one_proportion_z(df: DataFrame, column: str, test_value: float, alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    one_of(alternative, ALTERNATIVES, "alternative")
    if not 0 <= test_value <= 1:
        raise ParameterError("the hypothesised proportion must be between 0 and 1")
    x = _num(column)
    m = df.agg(F.count(x).alias("n"), F.sum(x).cast("bigint").alias("successes")).withColumn("estimate", F.try_divide("successes", "n"))
    se = F.sqrt(F.lit(test_value * (1 - test_value)) / F.col("n"))
    m = m.withColumn("statistic", F.when(se > 0, (F.col("estimate") - test_value) / se).otherwise(F.lit(0.0)))
    centre, margin = _wilson(F.col("estimate"), F.col("n"), tails.normal_ppf_value(1 - alpha / 2))
    return m.withColumns({
        "p_value": tails.normal_p_value(F.col("statistic"), alternative), "lower": F.greatest(F.lit(0.0), centre - margin), "upper": F.least(F.lit(1.0), centre + margin),
    })


def goodness_of_fit_cells(df: DataFrame, column: str, test_value: float) -> DataFrame:
    """Per category: observed and expected count, residual and standardised residual.

    A value between 0 and 1 is the expected share of every category, anything else its count.
    """
    clean = df.where(q(column).isNotNull())
    total = clean.count()
    expected = test_value * total if 0 < test_value < 1 else float(test_value)
    counts = clean.groupBy(q(column).alias("category")).agg(F.count(F.lit(1)).alias("observed"))
    residual = F.col("observed") - F.lit(expected)
    return counts.withColumns({
        "expected": F.lit(expected), "residual": residual, "standardised_residual": residual / F.lit(expected**0.5) if expected > 0 else F.lit(0.0),
    })


def goodness_of_fit(df: DataFrame, column: str, test_value: float) -> DataFrame:
    cells = goodness_of_fit_cells(df, column, test_value)
    out = cells.agg(F.sum(F.pow("residual", 2) / F.col("expected")).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"), F.sum("observed").alias("n"))
    return out.withColumn("p_value", tails.chi2_sf(F.col("statistic"), F.col("dof")))


# ---- multiple comparisons --------------------------------------------------------------


def adjust_p_values(tests: DataFrame, p_column: str, id_column: str, method: str = "holm", family: Sequence[str] = ()) -> DataFrame:
    """Adjusted p per row of a table of tests: bonferroni, holm or fdr (Benjamini-Hochberg)."""
    one_of(method, ("bonferroni", "holm", "fdr"), "method")
    sizes = tests.groupBy(*[q(f) for f in family]).agg(F.count(q(p_column)).alias("__m"))
    if family:
        sized = lookup_join(tests, sizes, list(family))
    else:
        sized = tests.withColumn("__m", F.lit(sizes.first()[0]))
    p, m = q(p_column), F.col("__m")
    if method == "bonferroni":
        return sized.withColumn("p_adjusted", F.least(F.lit(1.0), p * m)).drop("__m")
    ranked = running(sized, family, [p_column, id_column], {"__rank": ("count", p)})
    if method == "holm":
        out = running(ranked, family, [p_column, id_column], {"p_adjusted": ("max", p * (m - F.col("__rank") + 1))})
    else:
        out = running(ranked, family, [f"-{p_column}", f"-{id_column}"], {"p_adjusted": ("min", p * m / F.col("__rank"))})
    return out.withColumn("p_adjusted", F.when(p.isNotNull(), F.least(F.lit(1.0), F.col("p_adjusted")))).drop("__m", "__rank")
