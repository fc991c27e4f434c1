"""Profiles, flows, quality, drift and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.operators import flows as L
from featherloom.operators import profile as P
from featherloom.operators import quality as Q
from featherloom.operators import stats as H
from featherloom.queries import query
from featherloom.queries.shared import FLOWS, GAPPY, chi2_point_sql, f_p_sql, flows, gappy_events, normal_p_sql, rounded, t_975_sql, t_p_sql

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_column(columns, expr, table, joiner=" UNION ALL "):
    return joiner.join(f"SELECT '{c}' AS \"column\", {expr.replace('$', c)} FROM {table.replace('$', c)}" for c in columns)


# ---- profiles --------------------------------------------------------------------------


@query("a4_describe_numeric", _per_column(NUMBERS, """count($) AS count, round(avg($), 4) AS mean, round(stddev_samp($), 4) AS std, min($) AS min,
  round(quantile_cont($, .25), 4) AS q1, round(median($), 4) AS median, round(quantile_cont($, .75), 4) AS q3, max($) AS max, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_pct""", "lineitem"))
def _(t):
    return rounded(P.describe(t.lineitem, NUMBERS), 4)


@query("a5_describe_all", " UNION ALL ".join(f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM orders) AS count, (SELECT count(DISTINCT {c}) FROM orders) AS "unique",
  {c}::VARCHAR AS top, count(*) AS freq FROM orders GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) = 1""" for c in ("o_orderstatus", "o_orderpriority")))
def _(t):
    return P.describe_categorical(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("a6_profile_numeric", _per_column(["value", "user_id"], """count(*) - count($) AS null_count, round(100.0 * (count(*) - count($)) / count(*), 6) AS null_pct,
  round(avg($), 6) AS mean, round(stddev_samp($), 6) AS std, min($)::DOUBLE AS min, max($)::DOUBLE AS max, round(median($), 6) AS median,
  count_if($ = 0)::BIGINT AS zeros, count_if($ < 0)::BIGINT AS negatives, count(DISTINCT $) AS unique_count, round(100.0 * count(DISTINCT $) / count(*), 6) AS unique_pct""", GAPPY))
def _(t):
    return rounded(P.profile_numeric(gappy_events(t), ["value", "user_id"]))


@query("a7_profile_text", _per_column(["text", "lang", "source"], """count(*) - count($) AS null_count, 100.0 * (count(*) - count($)) / count(*)::DOUBLE AS null_pct,
  round(avg(length($)), 6) AS avg_length, min(length($)) AS min_length, max(length($)) AS max_length, count(DISTINCT $) AS unique_count""", "documents"))
def _(t):
    return rounded(P.profile_text(t.documents, ["text", "lang", "source"]))


@query("a7_top_values", " UNION ALL ".join(f"""(SELECT '{c}' AS "column", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 2 QUALIFY rank <= 5)""" for c in ("p_brand", "p_type", "l_returnflag")))
def _(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(P.top_values(joined, ["p_brand", "p_type", "l_returnflag"]))


@query("a8_missing_values", f"""SELECT * FROM (SELECT 'value' AS "column", 'double' AS dtype, count(*) - count(value) AS null_count, round(100.0 * (count(*) - count(value)) / count(*), 2) AS null_pct,
  CASE WHEN 100.0 * (count(*) - count(value)) / count(*) > 50 THEN 'high' WHEN 100.0 * (count(*) - count(value)) / count(*) > 5 THEN 'moderate' ELSE 'low' END AS severity FROM {GAPPY})""")
def _(t):
    return P.missing_values(gappy_events(t), 0.5)


@query("a8_missing_summary", f"""SELECT count(*) AS total_rows, count(*) - count(value) AS total_nulls, 1::BIGINT AS cols_with_nulls, 0::BIGINT AS all_null_rows, count(*) * 6 AS total_cells,
  round((count(*) - count(value)) * 100.0 / (count(*) * 6), 2) AS overall_null_pct FROM {GAPPY}""")
def _(t):
    return P.missing_summary(gappy_events(t))


def _pairs_sql(fn, table, columns):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({fn.replace('$a', a).replace('$b', b)}, 6) AS r FROM {table}" for i, a in enumerate(columns) for b in columns[i + 1 :]
    )


@query("a9_correlation_pearson", _pairs_sql("corr($a, $b)", "lineitem", NUMBERS))
def _(t):
    return rounded(P.correlations(t.lineitem, NUMBERS))


@query("a9_correlation_pairwise_nulls", f"SELECT 'event_id' AS column_a, 'value' AS column_b, round(corr(event_id, value), 6) AS r FROM {GAPPY} WHERE value IS NOT NULL")
def _(t):
    return rounded(P.correlations(gappy_events(t), ["event_id", "value"]))


_RANKED = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS) + " FROM lineitem)"


@query("a10_correlation_spearman", _pairs_sql("corr($a, $b)", _RANKED, NUMBERS))
def _(t):
    return rounded(P.correlations(t.lineitem, NUMBERS, "spearman"))


@query("a11_correlation_kendall", """WITH p AS (SELECT l_quantity AS x, l_linenumber AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
  s AS (SELECT sum(a.n * b.n * sign((a.x - b.x) * (a.y - b.y))) / 2 AS s FROM p a, p b),
  t AS (SELECT sum(n) AS n FROM p), tx AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM p GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM p GROUP BY y))
  SELECT 'l_quantity' AS column_a, 'l_linenumber' AS column_b, round(s / sqrt((n * (n - 1) / 2 - tx.v) * (n * (n - 1) / 2 - ty.v)), 6) AS r FROM s, t, tx, ty""")
def _(t):
    return rounded(P.correlations(t.lineitem, ["l_quantity", "l_linenumber"], "kendall"))


GROSS = "(SELECT *, l_extendedprice * (1 + l_tax) AS gross, l_extendedprice * l_quantity AS volume FROM lineitem)"
WIDE = ["l_quantity", "l_extendedprice", "l_tax", "gross", "volume"]


def gross(t):
    p = F.col("l_extendedprice")
    return t.lineitem.withColumns({"gross": p * (1 + F.col("l_tax")), "volume": p * F.col("l_quantity")})


@query("a12_strong_pairs", f"""SELECT *, CASE WHEN abs(r) >= 0.8 THEN 'Very strong' WHEN abs(r) >= 0.6 THEN 'Strong' ELSE 'Moderate' END AS strength
  FROM ({_pairs_sql("corr($a, $b)", GROSS, WIDE)}) WHERE abs(r) >= 0.3""")
def _(t):
    return rounded(P.strong_pairs(P.correlations(gross(t), WIDE), 0.3))


@query("a12_target_ranking", f"""SELECT CASE WHEN column_a = 'l_quantity' THEN column_b ELSE column_a END AS "column", r,
  CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.3 THEN 'Moderate' WHEN abs(r) < 0.1 THEN 'Weak' ELSE 'Low' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, row_number() OVER (ORDER BY abs(r) DESC) AS rank
  FROM ({_pairs_sql("corr($a, $b)", GROSS, WIDE)}) WHERE column_a = 'l_quantity' OR column_b = 'l_quantity'""")
def _(t):
    return rounded(P.target_correlations(P.correlations(gross(t), WIDE), "l_quantity"))


@query("a13_distribution", _per_column(["o_totalprice"], """count($) AS count, round(avg($), 4) AS mean, round(stddev_samp($), 4) AS std, min($) AS min, round(quantile_cont($, .25), 4) AS q1,
  round(median($), 4) AS median, round(quantile_cont($, .75), 4) AS q3, max($) AS max, round(skewness($), 4) AS skewness, round(kurtosis($), 4) AS kurtosis""", "orders"))
def _(t):
    return rounded(P.describe(t.orders, ["o_totalprice"], shape=True).drop("null_count", "null_pct"), 4)


@query("a14_histogram", """WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders),
  c AS (SELECT least(floor((o_totalprice - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM orders, b GROUP BY 1)
  SELECT r.bin, coalesce(n, 0) AS n, round(lo + r.bin * w, 4) AS lower, round(lo + (r.bin + 1) * w, 4) AS upper FROM range(30) r(bin) LEFT JOIN c ON c.bin = r.bin, b""")
def _(t):
    return rounded(P.histogram(t.orders, "o_totalprice", 30), 4)


@query("a15_density", """WITH s AS (SELECT count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h, min(value) AS lo, max(value) AS hi FROM events),
  g AS (SELECT i::INT AS point, lo - 0.5 * (hi - lo) + 2 * (hi - lo) * i / 99 AS x, h, n FROM s, range(100) r(i))
  SELECT point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((value - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM g, events GROUP BY 1, 2""")
def _(t):
    return rounded(P.density(t.events, "value"))


@query("a16_value_counts", "SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1")
def _(t):
    return rounded(P.value_counts_table(t.events, "event_type"))


@query("a25_crosstab_cells", "SELECT user_id AS \"row\", event_type AS \"column\", count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return P.crosstab_cells(t.events, "user_id", "event_type")


@query("a25_crosstab", """SELECT l_returnflag, count_if(l_linestatus = 'F')::BIGINT AS "F", count_if(l_linestatus = 'O')::BIGINT AS "O" FROM lineitem GROUP BY 1""")
def _(t):
    return P.crosstab(t.lineitem, "l_returnflag", "l_linestatus")


@query("a27_duplicate_rows", """SELECT count(*) AS row_count, count(*) - count(DISTINCT (text, lang)) AS duplicate_rows,
  round((count(*) - count(DISTINCT (text, lang))) / count(*), 6) AS duplicate_ratio FROM documents""")
def _(t):
    return rounded(P.duplicate_rows(t.documents, ["text", "lang"]))


@query("a28_distinct_tags", "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS tag FROM part ORDER BY 1")
def _(t):
    return P.distinct_tags(t.part.select(F.split("p_type", " ").alias("tags")), "tags")


# ---- flows -----------------------------------------------------------------------------

NET = f"""(SELECT counterparty_id, sum(flow) AS flow FROM (SELECT counterparty_id, date, abs(sum(CASE WHEN direction = 'IN' THEN total_amount ELSE -total_amount END)) AS flow
  FROM {FLOWS} GROUP BY 1, 2) GROUP BY 1)"""
ERRORS = f"(SELECT *, abs(total_amount - forecast) AS abs_error FROM {FLOWS})"


def with_errors(t):
    return flows(t).withColumn("abs_error", F.abs(F.col("total_amount") - F.col("forecast")))


@query("a17_net_flow", f"SELECT counterparty_id, round(flow, 2) AS flow FROM {NET}")
def _(t):
    return rounded(L.net_flow(flows(t), "counterparty_id", "date", "direction", "total_amount"), 2)


@query("a17_cumulative_accounts", f"""WITH f AS (SELECT counterparty_id, round(flow) AS flow FROM {NET})
  SELECT counterparty_id, flow, sum(flow) OVER w AS cum_flow, sum(flow) OVER () AS total, round(sum(flow) OVER w / sum(flow) OVER (), 6) AS cum_pct, row_number() OVER w AS rank
  FROM f WINDOW w AS (ORDER BY flow DESC, counterparty_id DESC)""")
def _(t):
    return rounded(L.cumulative_accounts(flows(t), "counterparty_id", "date", "direction", "total_amount", digits=0).drop("label"))


@query("a18_volatility", f"""SELECT counterparty_id, direction, round(avg(total_amount), 4) AS mean_actuals, round(stddev_samp(total_amount), 4) AS std_actuals, count(*) AS count_transactions,
  round(sum(total_amount), 2) AS total_actuals, round(avg(abs_error), 4) AS mean_abs_error, round(stddev_samp(total_amount) / avg(total_amount), 4) AS volatility FROM {ERRORS} GROUP BY 1, 2""")
def _(t):
    return rounded(L.volatility(with_errors(t), "counterparty_id", "direction", "total_amount", "abs_error").withColumn("total_actuals", F.round("total_actuals", 2)), 4)


@query("a19_error_leaderboard", f"""SELECT counterparty_id, round(avg(abs_error), 4) AS error_mean, round(stddev_samp(abs_error), 4) AS error_std, count_if(total_amount <> 0)::BIGINT AS nonzero_actuals
  FROM {ERRORS} WHERE direction = 'IN' GROUP BY 1 ORDER BY avg(abs_error), 1 LIMIT 10""")
def _(t):
    return rounded(L.error_leaderboard(with_errors(t), "counterparty_id", "abs_error", "total_amount", "date", "direction", True, top_n=10), 4)


@query("a19_error_leaderboard_worst", f"""WITH e AS (SELECT counterparty_id, avg(abs_error) AS m, stddev_samp(abs_error) AS s FROM {ERRORS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
  c AS (SELECT counterparty_id, count_if(a <> 0)::BIGINT AS n FROM (SELECT counterparty_id, date, sum(total_amount) AS a FROM {FLOWS} GROUP BY 1, 2) GROUP BY 1)
  SELECT e.counterparty_id, round(m, 4) AS error_mean, round(s, 4) AS error_std, n AS nonzero_actuals FROM e JOIN c ON e.counterparty_id = c.counterparty_id""")
def _(t):
    return rounded(L.error_leaderboard(with_errors(t), "counterparty_id", "abs_error", "total_amount", "date", "direction", None, best=False, top_n=10), 4)


@query("a20_sums_by_date", f"""SELECT date, round(sum(total_amount), 2) AS total_amount, round(sum(forecast), 2) AS forecast FROM {FLOWS} WHERE direction IN ('IN') GROUP BY 1""")
def _(t):
    return rounded(L.sums_by(flows(t), "date", ["total_amount", "forecast"], {"direction": ["IN"], "counterparty_id": []}), 2)


@query("a21_error_matrix", f"SELECT counterparty_id, date, round(sum(abs_error), 2) AS error FROM {ERRORS} WHERE direction = 'OUT' GROUP BY 1, 2")
def _(t):
    return rounded(L.error_matrix(with_errors(t), "counterparty_id", "date", "abs_error", "direction", False), 2)


@query("a22_signed_view", f"SELECT counterparty_id, date, direction, CASE WHEN direction = 'OUT' THEN -total_amount ELSE total_amount END AS signed_amount FROM {FLOWS}")
def _(t):
    return L.signed_view(flows(t), "counterparty_id", "date", "direction", "total_amount")


@query("a23_labelled_pairs", f"""SELECT direction, total_amount AS actual, forecast, counterparty_id || ' (' || strftime(date, '%Y-%m-%d') || ') - (error: ' || round(abs_error)::BIGINT || ')' AS label FROM {ERRORS}""")
def _(t):
    base = with_errors(t).withColumn("abs_error", F.round("abs_error").cast("bigint"))
    return L.labelled_pairs(base, "counterparty_id", "date", "direction", "total_amount", "forecast", "abs_error")


SPLIT = "CASE WHEN year(date) < 2000 THEN 'train' WHEN year(date) = 2000 THEN 'validation' ELSE 'test' END"


def split_by_year(t):
    y = F.year("date")
    return with_errors(t).withColumn("split", F.when(y < 2000, "train").when(y == 2000, "validation").otherwise("test"))


@query("a29_prediction_traces", f"""SELECT counterparty_id, {SPLIT} AS split, date, round(sum(total_amount), 2) AS total_amount, round(sum(forecast), 2) AS forecast FROM {FLOWS} GROUP BY 1, 2, 3""")
def _(t):
    daily = split_by_year(t).groupBy("counterparty_id", "split", "date").agg(F.sum("total_amount").alias("total_amount"), F.sum("forecast").alias("forecast"))
    return rounded(L.prediction_traces(daily, ["counterparty_id"], "split", "date", "total_amount", "forecast"), 2)


SCORES = f"""(SELECT 'mae' AS score_name, {SPLIT} AS split, counterparty_id % 5 AS fold, avg(abs_error) AS score_value FROM {ERRORS} GROUP BY 2, 3
  UNION ALL SELECT 'bias', {SPLIT}, counterparty_id % 5, avg(total_amount - forecast) FROM {ERRORS} GROUP BY 2, 3)"""


def scores(t):
    base = split_by_year(t).groupBy("split", (F.col("counterparty_id") % 5).alias("fold")).agg(
        F.avg("abs_error").alias("mae"), F.avg(F.col("total_amount") - F.col("forecast")).alias("bias"))
    return base.unpivot(["split", "fold"], ["mae", "bias"], "score_name", "score_value")


@query("a24_score_summary", f"""SELECT score_name || '__' || split AS score_name, round(avg(score_value), 4) AS score_value, count(*) AS folds FROM {SCORES} s GROUP BY s.score_name, split""")
def _(t):
    return rounded(L.summarise_scores(scores(t)), 4)


@query("a24_flattened_scores", f"SELECT score_name || '__' || split || '__' || fold AS score_name, round(score_value, 4) AS score_value FROM {SCORES}")
def _(t):
    return rounded(L.flatten_scores(scores(t)), 4)


# ---- quality ---------------------------------------------------------------------------


@query("q1_validate_schema", f"""SELECT 'value' AS "column", 'null' AS "check", 'error' AS severity, count(*) - count(value) AS violations FROM {GAPPY}
  UNION ALL SELECT 'value', 'min_value', 'error', count_if(value < 5)::BIGINT FROM {GAPPY} UNION ALL SELECT 'value', 'max_value', 'error', count_if(value > 90)::BIGINT FROM {GAPPY}
  UNION ALL SELECT 'event_type', 'allowed_values', 'error', count_if(event_type NOT IN ('click', 'view', 'signup'))::BIGINT FROM {GAPPY}
  UNION ALL SELECT 'event_type', 'pattern', 'error', count_if(NOT regexp_matches(event_type, '^(?:[a-s]+$)'))::BIGINT FROM {GAPPY}
  UNION ALL SELECT 'user_id', 'unique', 'error', count(*) - count(DISTINCT user_id) FROM {GAPPY} UNION ALL SELECT 'user_id', 'type', 'warning', count(user_id) FROM {GAPPY}
  UNION ALL SELECT 'country', 'missing_column', 'error', 1::BIGINT UNION ALL SELECT 'ts', 'extra_column', 'warning', 1::BIGINT UNION ALL SELECT 'props', 'extra_column', 'warning', 1::BIGINT""")
def _(t):
    rules = [
        Q.ColumnRule("event_id", "integer", nullable=False, unique=True),
        Q.ColumnRule("value", "float", nullable=False, min_value=5, max_value=90),
        Q.ColumnRule("event_type", "category", allowed_values=["click", "view", "signup"], pattern="[a-s]+$"),
        Q.ColumnRule("user_id", "string", unique=True),
        Q.ColumnRule("country", "string"),
    ]
    return Q.validate_schema(gappy_events(t), rules)


@query("q1_invalid_values", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def _(t):
    return Q.invalid_values(t.events, "event_type", ["click", "view"])


@query("q2_validate_types", """SELECT 'p_size' AS "column", 'Type mismatch' AS error, 'string' AS expected, 'integer' AS actual, NULL::BIGINT AS uncastable
  UNION ALL SELECT 'code', 'Type mismatch', 'integer', 'string', count_if(try_cast(code AS BIGINT) IS NULL)::BIGINT
    FROM (SELECT CASE WHEN p_size > 40 THEN p_brand ELSE p_size::VARCHAR END AS code FROM part)
  UNION ALL SELECT 'colour', 'Column not found', 'string', NULL, NULL""")
def _(t):
    base = t.part.withColumn("code", F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.col("p_size").cast("string")))
    return Q.validate_types(base, {"p_partkey": "integer", "p_size": "string", "code": "integer", "colour": "string", "p_name": "string"})


@query("q3_quality_score", f"""WITH s AS (SELECT count(*) AS n, count(value) AS v, count(DISTINCT (user_id, event_type, value)) AS d FROM {GAPPY}),
  r AS (SELECT n AS row_count, n * 3 AS total_cells, n - v AS missing_cells, (n * 3 - (n - v)) / (n * 3) AS completeness FROM s)
  SELECT row_count, total_cells, missing_cells, round(completeness, 6) AS completeness, completeness >= 0.95 AS complete_enough,
    (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM {GAPPY})) FROM {GAPPY}) AS duplicate_rows,
    round((SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM {GAPPY})) FROM {GAPPY}) / row_count, 6) AS duplicate_ratio, 1.0::DOUBLE AS validity,
    round(0.4 * completeness + 0.3 * (1 - (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM {GAPPY})) FROM {GAPPY}) / row_count) + 0.3, 6) AS score,
    'Excellent' AS grade FROM r""")
def _(t):
    return rounded(Q.quality_score(gappy_events(t).select("user_id", "event_type", "value")))


@query("q3_column_quality", """WITH n AS (SELECT count(*) AS n FROM part) SELECT c AS "column", d AS dtype, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_ratio, 0::BIGINT AS inf_count, u AS unique_count,
  round(u / n, 6) AS unique_ratio, u / n > 0.99 AS potential_id, u > 100 AND d = 'string' AS high_cardinality, u = 1 AS constant, lo AS min, hi AS max, round(m, 6) AS mean, round(s, 6) AS std
  FROM n, (SELECT 'p_partkey' AS c, 'integer' AS d, count(DISTINCT p_partkey) AS u, min(p_partkey)::DOUBLE AS lo, max(p_partkey)::DOUBLE AS hi, avg(p_partkey) AS m, stddev_samp(p_partkey) AS s FROM part UNION ALL SELECT 'p_name', 'string', count(DISTINCT p_name), NULL, NULL, NULL, NULL FROM part
    UNION ALL SELECT 'p_brand', 'string', count(DISTINCT p_brand), NULL, NULL, NULL, NULL FROM part UNION ALL SELECT 'p_type', 'string', count(DISTINCT p_type), NULL, NULL, NULL, NULL FROM part
    UNION ALL SELECT 'p_size', 'integer', count(DISTINCT p_size), min(p_size), max(p_size), avg(p_size), stddev_samp(p_size) FROM part
    UNION ALL SELECT 'p_retailprice', 'float', count(DISTINCT p_retailprice), min(p_retailprice), max(p_retailprice), avg(p_retailprice), stddev_samp(p_retailprice) FROM part)""")
def _(t):
    return rounded(Q.column_quality(t.part))


@query("q4_outliers_iqr", _per_column(["l_extendedprice", "l_tax"], """count_if($ < q1 - 0.4 * (q3 - q1) OR $ > q3 + 0.4 * (q3 - q1))::BIGINT AS outliers,
  round(100.0 * count_if($ < q1 - 0.4 * (q3 - q1) OR $ > q3 + 0.4 * (q3 - q1)) / count(*), 4) AS pct, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3,
  round(any_value(q1 - 0.4 * (q3 - q1)), 4) AS lower, round(any_value(q3 + 0.4 * (q3 - q1)), 4) AS upper, round(any_value(q3 - q1), 4) AS iqr""",
  "lineitem, (SELECT quantile_cont($, .25) AS q1, quantile_cont($, .75) AS q3 FROM lineitem)"))
def _(t):
    return rounded(Q.outliers_iqr(t.lineitem, ["l_extendedprice", "l_tax"], 0.4), 4)


@query("q5_outliers_zscore", """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, avg(l_quantity) AS m2, stddev_samp(l_quantity) AS s2 FROM lineitem)
  SELECT 'l_extendedprice' AS "column", count_if(abs((l_extendedprice - m) / s) > 1.7)::BIGINT AS outliers, round(100.0 * count_if(abs((l_extendedprice - m) / s) > 1.7) / count(*), 4) AS pct,
    round(any_value(m), 4) AS mean, round(any_value(s), 4) AS std FROM lineitem, s
  UNION ALL SELECT 'l_quantity', count_if(abs((l_quantity - m2) / s2) > 1.7)::BIGINT, round(100.0 * count_if(abs((l_quantity - m2) / s2) > 1.7) / count(*), 4), round(any_value(m2), 4), round(any_value(s2), 4) FROM lineitem, s""")
def _(t):
    return rounded(Q.outliers_zscore(t.lineitem, ["l_extendedprice", "l_quantity"], 1.7), 4)


@query("q5_outlier_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 480000 ORDER BY o_totalprice, o_orderkey LIMIT 100")
def _(t):
    return Q.outlier_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 5000, 480000, limit=100, order=["o_totalprice", "o_orderkey"])


@query("q6_isolation_outliers", """SELECT count(*) AS n, TRUE AS share_kept, TRUE AS extremes_found FROM events""")
def _(t):
    out = Q.outliers_isolation(t.events.select("event_id", "value"), "value", 0.05)
    share = F.count_if("is_outlier") / F.count(F.lit(1))
    return out.agg(F.count(F.lit(1)).alias("n"), ((share > 0) & (share <= 0.05)).alias("share_kept"), F.max_by("is_outlier", "value").alias("extremes_found"))


@query("q6_isolation_columns")
def _(t):
    return Q.isolation_outliers(t.lineitem, contamination=0.05)


BEFORE, AFTER = "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16')", "(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')"


def halves(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return t.events.where(F.col("ts") < cut), t.events.where(F.col("ts") >= cut)


@query("q7_drift_numeric", f"""WITH v AS (SELECT value, count_if(r = 1) AS a, count_if(r = 0) AS b FROM (SELECT value, 1 AS r FROM {BEFORE} UNION ALL SELECT value, 0 FROM {AFTER}) GROUP BY 1),
  c AS (SELECT sum(a) OVER (ORDER BY value) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY value) / sum(b) OVER () AS g FROM v),
  s AS (SELECT avg(value) AS rm, stddev_samp(value) AS rs, count(*) AS rn FROM {BEFORE}), u AS (SELECT avg(value) AS cm, stddev_samp(value) AS cs, count(*) AS cn FROM {AFTER}),
  d AS (SELECT max(abs(f - g)) AS d FROM c), p AS (SELECT least(1, greatest(0, 2 * sum(pow(-1, k - 1) * exp(-2 * k * k * d * d * rn * cn / (rn + cn))))) AS p FROM d, s, u, range(1, 101) r(k))
  SELECT 'value' AS "column", round(d, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS drift_detected, rn AS ref_n, cn AS cur_n, round(rm, 6) AS ref_mean, round(cm, 6) AS cur_mean, round(rs, 6) AS ref_std, round(cs, 6) AS cur_std,
    round(cm - rm, 6) AS mean_shift, round((cm - rm) / rm * 100, 6) AS mean_shift_pct FROM s, u, d, p""")
def _(t):
    return rounded(Q.drift_numeric(*halves(t), "value"))


@query("q8_drift_categorical", f"""WITH c AS (SELECT event_type, count_if(ts < TIMESTAMP '2024-01-16') AS r, count_if(ts >= TIMESTAMP '2024-01-16') AS c FROM events GROUP BY 1),
  s AS (SELECT sum(c) / sum(r) AS k FROM c) SELECT 'event_type' AS "column", round(sum(pow(c - r * k, 2) / (r * k)), 6) AS statistic, count(*) - 1 AS dof, count_if(r > 0)::BIGINT AS ref_unique_count,
  count_if(c > 0)::BIGINT AS cur_unique_count, count_if(r = 0)::BIGINT AS new_categories, count_if(c = 0)::BIGINT AS missing_categories,
  round(exp(-sum(pow(c - r * k, 2) / (r * k)) / 2) * (1 + sum(pow(c - r * k, 2) / (r * k)) / 2), 6) AS p_value, exp(-sum(pow(c - r * k, 2) / (r * k)) / 2) * (1 + sum(pow(c - r * k, 2) / (r * k)) / 2) < 0.05 AS drift_detected FROM c, s""")
def _(t):
    return rounded(Q.drift_categorical(*halves(t), "event_type"))  # five categories: with four degrees of freedom the tail is elementary


@query("q8_category_changes", f"""WITH c AS (SELECT user_id || '-' || event_type || '-' || event_id % 40 AS visit, count_if(ts < TIMESTAMP '2024-01-16') AS r, count_if(ts >= TIMESTAMP '2024-01-16') AS c FROM events GROUP BY 1)
  SELECT 'visit' AS "column", visit AS category, CASE WHEN r = 0 THEN 'new' ELSE 'missing' END AS change, greatest(r, c)::BIGINT AS rows FROM c WHERE r = 0 OR c = 0""")
def _(t):
    visit = F.concat_ws("-", F.col("user_id").cast("string"), "event_type", (F.col("event_id") % 40).cast("string"))
    return Q.category_changes(*(h.select(visit.alias("visit")) for h in halves(t)), ["visit"])


def _ks_sql(c):
    return f"""(WITH v AS (SELECT {c} AS x, count_if(r = 1) AS a, count_if(r = 0) AS b FROM (SELECT {c}, 1 AS r FROM {BEFORE} UNION ALL SELECT {c}, 0 FROM {AFTER}) GROUP BY 1),
      s AS (SELECT max(abs(f - g)) AS d, any_value(n) AS n, any_value(m) AS m FROM (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS g, sum(a) OVER () AS n, sum(b) OVER () AS m FROM v))
      SELECT '{c}' AS "column", 'kolmogorov_smirnov' AS test, d AS statistic, (SELECT least(1, greatest(0, 2 * sum(pow(-1, k - 1) * exp(-2 * k * k * d * d * n * m / (n + m))))) FROM range(1, 101) r(k)) AS p_value FROM s)"""


@query("q8_drift_report", f"""WITH c AS (SELECT event_type, count_if(ts < TIMESTAMP '2024-01-16') AS r, count_if(ts >= TIMESTAMP '2024-01-16') AS c FROM events GROUP BY 1), k AS (SELECT sum(c) / sum(r) AS k FROM c),
  x AS (SELECT sum(pow(c - r * k, 2) / (r * k)) AS x FROM c, k), r AS (SELECT * FROM {_ks_sql('value')} UNION ALL SELECT * FROM {_ks_sql('user_id')} UNION ALL SELECT 'event_type', 'chi_square', x, exp(-x / 2) * (1 + x / 2) FROM x)
  SELECT "column", test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS drift_detected FROM r""")
def _(t):
    return rounded(Q.detect_drift(*halves(t), ["value", "user_id", "event_type"]))


# ---- statistics ------------------------------------------------------------------------


@query("h1_t_test", f"""WITH m AS (SELECT count(l_discount) AS n1, avg(l_discount) AS m1, var_samp(l_discount) AS v1, count(l_tax) AS n2, avg(l_tax) AS m2, var_samp(l_tax) AS v2 FROM lineitem)
  SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(m1 - m2, 6) AS mean_diff, n1 + n2 - 2 AS dof,
  round(sqrt(v1), 6) AS std1, round(sqrt(v2), 6) AS std2, round(t, 4) AS statistic, round({t_p_sql('t', '(n1 + n2 - 2)')}, 6) AS p_value
  FROM (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t FROM m)""")
def _(t):
    out = H.t_test(t.lineitem, "l_discount", "l_tax")
    return rounded(out.withColumn("statistic", F.round("statistic", 4)))


@query("h2_chi_square", """WITH c AS (SELECT event_type, user_id % 4 AS g, count(*) AS o FROM events GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c),
  e AS (SELECT o, sum(o) OVER (PARTITION BY event_type) * sum(o) OVER (PARTITION BY g) / n AS e FROM c, n)
  SELECT round(x, 6) AS statistic, n, 12::BIGINT AS dof, round(exp(-x / 2) * (pow(x / 2, 0) / 1 + pow(x / 2, 1) / 1 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6 + pow(x / 2, 4) / 24 + pow(x / 2, 5) / 120), 6) AS p_value FROM (SELECT sum(pow(o - e, 2) / e) AS x, sum(o)::BIGINT AS n FROM e)""")
def _(t):
    base = t.events.withColumn("g", F.col("user_id") % 4)
    return rounded(H.chi_square_independence(base, "event_type", "g"))


@query("h2_chi_square_yates", f"""WITH c AS (SELECT event_type = 'click' AS k, user_id % 2 AS g, count(*) AS o FROM events GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c),
  e AS (SELECT o, sum(o) OVER (PARTITION BY k) * sum(o) OVER (PARTITION BY g) / n AS e FROM c, n)
  SELECT round(x, 6) AS statistic, n, 1::BIGINT AS dof, round({normal_p_sql('sqrt(x)')}, 6) AS p_value FROM (SELECT sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e) AS x, sum(o)::BIGINT AS n FROM e)""")
def _(t):
    base = t.events.select((F.col("event_type") == "click").alias("k"), (F.col("user_id") % 2).alias("g"))
    return rounded(H.chi_square_independence(base, "k", "g"))


@query("h2_expected_counts", """WITH c AS (SELECT event_type AS "row", user_id % 4 AS "column", count(*) AS observed FROM events GROUP BY 1, 2)
  SELECT "row", "column", observed, (sum(observed) OVER (PARTITION BY "row"))::BIGINT AS row_total, (sum(observed) OVER (PARTITION BY "column"))::BIGINT AS column_total, (sum(observed) OVER ())::BIGINT AS n,
  round(sum(observed) OVER (PARTITION BY "row") * sum(observed) OVER (PARTITION BY "column") / sum(observed) OVER (), 6) AS expected FROM c""")
def _(t):
    return rounded(H.contingency(t.events.withColumn("g", F.col("user_id") % 4), "event_type", "g"))


@query("h3_anova", f"""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm FROM g)
  SELECT round(b, 4) AS ss_between, round(w, 4) AS ss_within, k::INT AS n_groups, (k - 1)::INT AS dof_between, (n - k)::INT AS dof_within, round(f, 6) AS statistic, round({f_p_sql('f', '(k - 1)', '(n - k)')}, 6) AS p_value
  FROM (SELECT *, (b / (k - 1)) / (w / (n - k)) AS f FROM (SELECT sum(g.n * pow(m - gm, 2)) AS b, sum((g.n - 1) * v) AS w, any_value(k) AS k, any_value(t.n)::BIGINT AS n FROM g, t))""")
def _(t):
    out = H.anova(t.events, "value", "event_type")
    return rounded(out.withColumns({"ss_between": F.round("ss_between", 4), "ss_within": F.round("ss_within", 4)}))


@query("h3_group_stats", "SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def _(t):
    return rounded(H.group_moments(t.events, "value", "event_type"))


@query("h4_mann_whitney", f"""WITH v AS (SELECT l_discount AS x, 1 AS g FROM lineitem UNION ALL SELECT l_tax, 2 FROM lineitem),
  r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM v), s AS (SELECT count_if(g = 1)::DOUBLE AS n1, count_if(g = 2)::DOUBLE AS n2, sum(CASE WHEN g = 1 THEN r END) AS r1 FROM r),
  t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY x)),
  z AS (SELECT *, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s, t)
  SELECT round(r1 - n1 * (n1 + 1) / 2, 2) AS statistic, n1::BIGINT AS n1, n2::BIGINT AS n2, round(least(1, CASE WHEN z < 0 THEN 2 - {normal_p_sql('z')} ELSE {normal_p_sql('z')} END), 6) AS p_value,
  (SELECT median(l_discount) FROM lineitem) AS median1, (SELECT median(l_tax) FROM lineitem) AS median2 FROM z""")
def _(t):
    return rounded(H.mann_whitney(t.lineitem, "l_discount", "l_tax")).withColumn("statistic", F.round("statistic", 2))


@query("h5_wilcoxon", f"""WITH d AS (SELECT l_extendedprice - l_quantity * 1500 AS d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0)
,
  s AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*)::DOUBLE AS m FROM r), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY abs(d))),
  z AS (SELECT *, (w_plus - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24) AS z FROM s, t)
  SELECT least(w_plus, w_minus) AS statistic, (SELECT count(*) FROM d) AS n_pairs, w_plus, w_minus, round(z, 6) AS z, round({normal_p_sql('z')}, 6) AS p_value FROM z""")
def _(t):
    base = t.lineitem.withColumn("forecast", F.col("l_quantity") * 1500)
    return H.wilcoxon(base, "l_extendedprice", "forecast").withColumns({c: F.round(c, 6) for c in ("z", "p_value")})


@query("h6_kruskal", """WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem),
  s AS (SELECT g, sum(r) AS r, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(pow(c, 3) - c) AS t, sum(c) AS n FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_quantity))
  SELECT round(h, 4) AS statistic, n_groups, round(exp(-h / 2), 4) AS p_value FROM (SELECT (12 / (any_value(t.n) * (any_value(t.n) + 1)) * sum(r * r / s.n) - 3 * (any_value(t.n) + 1)) / (1 - any_value(t) / (pow(any_value(t.n), 3) - any_value(t.n))) AS h, count(*) AS n_groups FROM s, t)""")
def _(t):
    return rounded(H.kruskal(t.lineitem, "l_quantity", "l_returnflag"), 4)


@query("h6_group_medians", "SELECT l_suppkey, count(*) AS count, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1")
def _(t):
    return rounded(H.group_medians(t.lineitem, "l_extendedprice", "l_suppkey"))


AB = """WITH m AS (SELECT count_if(event_type = 'click')::BIGINT AS n1, avg(value) FILTER (event_type = 'click') AS m1, var_samp(value) FILTER (event_type = 'click') AS v1,
  count_if(event_type = 'view')::BIGINT AS n2, avg(value) FILTER (event_type = 'view') AS m2, var_samp(value) FILTER (event_type = 'view') AS v2 FROM events),
  p AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS s FROM m)"""


@query("h7_ab_continuous", AB + f""" SELECT n1 AS control_n, n2 AS treatment_n, round(m1, 6) AS control_mean, round(m2, 6) AS treatment_mean, round(s, 6) AS pooled_std, round(m2 - m1, 6) AS difference,
  round((m1 - m2) / (s * sqrt(1 / n1 + 1 / n2)), 6) AS statistic, round((m2 - m1) / s, 6) AS cohens_d, round((m2 - m1) / m1 * 100, 6) AS relative_lift_pct,
  CASE WHEN abs((m2 - m1) / s) < 0.2 THEN 'negligible' WHEN abs((m2 - m1) / s) < 0.5 THEN 'small' WHEN abs((m2 - m1) / s) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
  round({t_p_sql('((m1 - m2) / (s * sqrt(1 / n1 + 1 / n2)))', '(n1 + n2 - 2)')}, 6) AS p_value, round(m2 - m1 - {t_975_sql('(n1 + n2 - 2)')} * s * sqrt(1 / n1 + 1 / n2), 6) AS ci_lower,
  round(m2 - m1 + {t_975_sql('(n1 + n2 - 2)')} * s * sqrt(1 / n1 + 1 / n2), 6) AS ci_upper FROM p""")
def _(t):
    out = H.ab_test_continuous(t.events, "event_type", "value", "click", "view")
    return rounded(out.select("control_n", "treatment_n", "control_mean", "treatment_mean", "pooled_std", "difference", "statistic", "cohens_d", "relative_lift_pct", "effect", "p_value", "ci_lower", "ci_upper"))


@query("h8_ab_binary", f"""WITH m AS (SELECT count_if(l_linestatus = 'F')::BIGINT AS n1, count_if(l_linestatus = 'F' AND l_returnflag = 'A')::BIGINT AS s1, count_if(l_linestatus = 'O')::BIGINT AS n2, count_if(l_linestatus = 'O' AND l_returnflag = 'A')::BIGINT AS s2 FROM lineitem),
  r AS (SELECT *, s1 / n1 AS r1, s2 / n2 AS r2, (s1 + s2) / (n1 + n2) AS p FROM m)
  SELECT n1 AS control_n, n2 AS treatment_n, s1::DOUBLE AS control_successes, s2::DOUBLE AS treatment_successes, round(r1, 6) AS control_rate, round(r2, 6) AS treatment_rate, round(r2 - r1, 6) AS difference,
  round((r2 - r1) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 6) AS statistic, round(1.959963984540054 * sqrt(r1 * (1 - r1) / n1 + r2 * (1 - r2) / n2), 6) AS margin,
  round((1.959963984540054 + 0.8416212335729143) * sqrt(r1 * (1 - r1) * (1 / n1 + 1 / n2)), 6) AS min_detectable_effect, round((r2 - r1) / r1 * 100, 6) AS relative_lift_pct,
  round({normal_p_sql('((r2 - r1) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))')}, 6) AS p_value, round(r2 - r1 - 1.959963984540054 * sqrt(r1 * (1 - r1) / n1 + r2 * (1 - r2) / n2), 6) AS ci_lower,
  round(r2 - r1 + 1.959963984540054 * sqrt(r1 * (1 - r1) / n1 + r2 * (1 - r2) / n2), 6) AS ci_upper FROM r""")
def _(t):
    base = t.lineitem.withColumn("hit", (F.col("l_returnflag") == "A").cast("int"))
    return rounded(H.ab_test_binary(base, "l_linestatus", "hit", "F", "O"))


@query("h9_ci_mean", f"""WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS se FROM events GROUP BY 1), b AS (SELECT *, {t_975_sql('(n - 1)')} * se AS margin FROM g)
  SELECT event_type, n, round(m, 6) AS estimate, round(se, 6) AS standard_error, round(margin, 6) AS margin, round(m - margin, 6) AS lower, round(m + margin, 6) AS upper FROM b""")
def _(t):
    return rounded(H.ci_mean(t.events, "value", 0.95, ["event_type"]))


@query("h10_ci_proportion", """WITH m AS (SELECT count(toxic) AS n, sum(toxic) AS s, sum(toxic) / count(toxic) AS p, 1.959963984540054 AS z FROM labels),
  w AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS c, z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n) AS g FROM m)
  SELECT n, s::BIGINT AS successes, round(p, 6) AS estimate, round(g, 6) AS margin, round(greatest(0, c - g), 6) AS lower, round(least(1, c + g), 6) AS upper FROM w""")
def _(t):
    return rounded(H.ci_proportion(t.labels, "toxic"))


@query("h11_ci_median", "SELECT round(median(o_totalprice), 4) AS estimate, count(*) AS n, TRUE AS inside FROM orders")
def _(t):
    out = H.ci_median(t.orders, "o_totalprice")
    inside = (F.col("lower") < F.col("estimate")) & (F.col("estimate") < F.col("upper"))
    return rounded(out.select("estimate", "n", inside.alias("inside")), 4)


@query("h12_ci_std", f"""WITH m AS (SELECT count(value) AS n, stddev_samp(value) AS s, 1.959963984540054 AS z, -1.959963984540054 AS y FROM events)
  SELECT n, round(s, 6) AS estimate, round(s * sqrt((n - 1) / {chi2_point_sql('z', '(n - 1)')}), 6) AS lower, round(s * sqrt((n - 1) / {chi2_point_sql('y', '(n - 1)')}), 6) AS upper FROM m""")
def _(t):
    return rounded(H.ci_std(t.events, "value"))


@query("h13_ci_difference", f"""WITH m AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), f AS (SELECT * FROM m WHERE g = 'F'), o AS (SELECT * FROM m WHERE g = 'O'),
  d AS (SELECT f.g AS group1, o.g AS group2, f.n AS n1, o.n AS n2, o.m - f.m AS e, sqrt(((f.n - 1) * f.v + (o.n - 1) * o.v) / (f.n + o.n - 2) * (1 / f.n + 1 / o.n)) AS se FROM f, o)
  SELECT group1, group2, n1, n2, round(e, 4) AS estimate, round(se, 4) AS standard_error, round({t_975_sql('(n1 + n2 - 2)')} * se, 4) AS margin, round(e - {t_975_sql('(n1 + n2 - 2)')} * se, 4) AS lower, round(e + {t_975_sql('(n1 + n2 - 2)')} * se, 4) AS upper FROM d""")
def _(t):
    out = H.ci_difference(t.lineitem, "l_extendedprice", "l_linestatus")
    return rounded(out.select("group1", "group2", "n1", "n2", "estimate", "standard_error", "margin", "lower", "upper"), 4)


@query("h14_one_sample_t", f"""WITH m AS (SELECT count(value) AS n, avg(value) AS m, stddev_samp(value) AS s, stddev_samp(value) / sqrt(count(value)) AS se FROM events)
  SELECT n, round(m, 6) AS mean, round(s, 6) AS std, round((m - 50) / se, 4) AS statistic, round((m - 50) / s, 6) AS cohens_d, round({t_p_sql('((m - 50) / se)', '(n - 1)')}, 6) AS p_value,
  round(m - {t_975_sql('(n - 1)')} * se, 6) AS lower, round(m + {t_975_sql('(n - 1)')} * se, 6) AS upper FROM m""")
def _(t):
    out = H.one_sample_t(t.events, "value", 50.0).select("n", "mean", "std", F.round("statistic", 4).alias("statistic"), "cohens_d", "p_value", "lower", "upper")
    return rounded(out)


@query("h15_one_proportion", f"""WITH m AS (SELECT count(quality) AS n, sum(quality) AS s, sum(quality) / count(quality) AS p, 1.959963984540054 AS z FROM labels),
  w AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS c, z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n) AS g FROM m)
  SELECT n, s::BIGINT AS successes, round(p, 6) AS estimate, round((p - 0.5) / sqrt(0.25 / n), 6) AS statistic, round({normal_p_sql('((p - 0.5) / sqrt(0.25 / n))')}, 6) AS p_value, round(greatest(0, c - g), 6) AS lower, round(least(1, c + g), 6) AS upper FROM w""")
def _(t):
    return rounded(H.one_proportion_z(t.labels, "quality", 0.5))


@query("h16_goodness_of_fit", """SELECT round(x, 6) AS statistic, dof, n, round(exp(-x / 2) * (pow(x / 2, 0) / 1 + pow(x / 2, 1) / 1), 6) AS p_value FROM
  (SELECT sum(pow(o - 0.2 * n, 2) / (0.2 * n)) AS x, count(*) - 1 AS dof, sum(o)::BIGINT AS n FROM (SELECT count(*) AS o, sum(count(*)) OVER () AS n FROM events GROUP BY event_type))""")
def _(t):
    return rounded(H.goodness_of_fit(t.events, "event_type", 0.2))


@query("h16_fit_cells", """SELECT event_type AS category, o AS observed, 0.2 * n AS expected, round(o - 0.2 * n, 6) AS residual, round((o - 0.2 * n) / sqrt(0.2 * n), 6) AS standardised_residual
  FROM (SELECT event_type, count(*) AS o, (sum(count(*)) OVER ())::DOUBLE AS n FROM events GROUP BY 1)""")
def _(t):
    return rounded(H.goodness_of_fit_cells(t.events, "event_type", 0.2))


P_VALUES = "(SELECT l_suppkey, 0 + round(pow(avg(l_discount) * 8, 9), 9) AS p FROM lineitem GROUP BY 1)"


def p_values(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.pow(F.avg("l_discount") * 8, 9), 9).alias("p"))


@query("h17_bonferroni", f"SELECT l_suppkey, p, round(least(1, p * count(*) OVER ()), 6) AS p_adjusted FROM {P_VALUES}")
def _(t):
    out = H.adjust_p_values(p_values(t), "p", "l_suppkey", "bonferroni")
    return out.withColumn("p_adjusted", F.round("p_adjusted", 6))


@query("h17_holm", f"""SELECT l_suppkey, p, round(least(1, max(a) OVER (ORDER BY p, l_suppkey)), 6) AS p_adjusted
  FROM (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, l_suppkey) + 1) AS a FROM {P_VALUES})""")
def _(t):
    out = H.adjust_p_values(p_values(t), "p", "l_suppkey", "holm")
    return out.withColumn("p_adjusted", F.round("p_adjusted", 6))


@query("h17_fdr", f"""SELECT l_suppkey, p, round(least(1, min(a) OVER (ORDER BY p DESC, l_suppkey DESC)), 6) AS p_adjusted
  FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_suppkey) AS a FROM {P_VALUES})""")
def _(t):
    out = H.adjust_p_values(p_values(t), "p", "l_suppkey", "fdr")
    return out.withColumn("p_adjusted", F.round("p_adjusted", 6))


