"""Splits, metrics, curves, models, forecasts, explanations, monitoring."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.plans import classifiers as C
from featherloom.plans import explain as Z
from featherloom.plans import forecast as B
from featherloom.plans import metrics as M
from featherloom.plans import models as ML
from featherloom.plans import splitters as P
from featherloom.plans.chain import FeatureChain
from featherloom.queries import query
from featherloom.queries.analysis import ERRORS, SCORES, scores, with_errors
from featherloom.queries.series import daily
from featherloom.queries.shared import DAILY, FLOWS, flows, rounded
from featherloom.session import new_path
from featherloom.sources.files import append_rows
from featherloom.streaming import drift, monitor

# ---- splits ----------------------------------------------------------------------------

HASH = "md5(o_orderkey || '|42')"


@query("b1_holdout", f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {HASH}, o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8) THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(t):
    return P.holdout(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("b1_holdout_ordered", """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.75) THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(t):
    return P.holdout(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 0.25, shuffle=False).select("o_orderkey", "split")


@query("b2_k_fold", f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {HASH}, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def _(t):
    return P.k_fold(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("b2_k_fold_blocks", "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey)::INT - 1 AS fold FROM orders")
def _(t):
    return P.k_fold(t.orders.select("o_orderkey"), ["o_orderkey"], 7, shuffle=False)


@query("b3_stratified_k_fold", f"SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def _(t):
    return P.stratified_k_fold(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query("b4_series_holdout_months", """SELECT o_orderkey, CASE WHEN o_orderdate < (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 2 MONTH FROM orders) THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(t):
    return P.series_holdout(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 3).select("o_orderkey", "split")


@query("b4_series_holdout_share", """WITH d AS (SELECT o_orderdate AS d, row_number() OVER (ORDER BY o_orderdate) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT o_orderdate FROM orders))
  SELECT o_orderkey, CASE WHEN o_orderdate < (SELECT d FROM d WHERE n = floor(c * 0.8) + 1) THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(t):
    return P.series_holdout(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 0.2).select("o_orderkey", "split")


def _folds_sql(table, first, date="date"):
    return f"""(WITH d AS (SELECT {date} AS date, row_number() OVER (ORDER BY {date}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {date} FROM {table})),
      f AS (SELECT d.date, k::INT AS fold, CASE WHEN i < s + 10 THEN 'train' ELSE 'validation' END AS split FROM d, LATERAL (SELECT unnest(range((n - 15) // 5 + 1)) AS k), LATERAL (SELECT {first} AS s)
        WHERE i >= FLOOR_ AND i < s + 15) SELECT * FROM f)"""


@query("b5_backtest_sliding", "SELECT date, event_type, fold, split FROM " + DAILY + " JOIN " + _folds_sql(DAILY, "k * 5").replace("FLOOR_", "s") + " USING (date)")
def _(t):
    return P.backtest_folds(daily(t).select("date", "event_type"), "date", 10, 5, 5)


@query("b5_backtest_expanding_backward", "SELECT date, event_type, fold, split FROM " + DAILY + " JOIN " + _folds_sql(DAILY, "n - 15 - k * 5").replace("FLOOR_", "0") + " USING (date)")
def _(t):
    return P.backtest_folds(daily(t).select("date", "event_type"), "date", 10, 5, 5, expanding_window=True, ascending=False)


@query("b6_random_split", f"""SELECT o_orderkey, CASE WHEN ('0x' || substr({HASH}, 1, 8))::BIGINT / 4294967296 < 0.8 THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(t):
    return P.random_split(t.orders.select("o_orderkey"), ["o_orderkey"])


# ---- metrics ---------------------------------------------------------------------------


@query("b7_b8_b9_regression_metrics", f"""SELECT direction, count(*) AS n, round(avg(pow(total_amount - forecast, 2)), 2) AS mse, round(avg(abs_error), 4) AS mae, round(avg(abs_error / greatest(abs(total_amount), 2.220446049250313e-16)), 4) AS mape,
  round(sum(abs_error) / sum(abs(total_amount)), 6) AS wmape, round(avg(total_amount - forecast), 4) AS residual_mean, round(stddev_pop(total_amount - forecast), 4) AS residual_std,
  round(sqrt(avg(pow(total_amount - forecast, 2))), 4) AS rmse, round(1 - avg(pow(total_amount - forecast, 2)) / var_pop(total_amount), 4) AS r2 FROM {ERRORS} GROUP BY 1""")
def _(t):
    out = M.regression_metrics(flows(t), "total_amount", "forecast", ["direction"])
    return rounded(out.withColumns({"mse": F.round("mse", 2), "wmape": F.round("wmape", 6), **{c: F.round(c, 4) for c in ("mae", "mape", "residual_mean", "residual_std", "rmse", "r2")}}))


@query("b10_d2_pinball", f"""WITH q AS (SELECT quantile_cont(total_amount, .3) AS q FROM {FLOWS}),
  l AS (SELECT avg(CASE WHEN total_amount > forecast THEN .3 * (total_amount - forecast) ELSE .7 * (forecast - total_amount) END) AS a, avg(CASE WHEN total_amount > q THEN .3 * (total_amount - q) ELSE .7 * (q - total_amount) END) AS b FROM {FLOWS}, q)
  SELECT round(a, 4) AS pinball, round(b, 4) AS baseline, round(1 - a / b, 4) AS d2_pinball FROM l""")
def _(t):
    return rounded(M.d2_pinball(flows(t), "total_amount", "forecast", 0.3), 4)


@query("b10_d2_pinball_by_group", f"""WITH q AS (SELECT counterparty_id, median(total_amount) AS q FROM {FLOWS} GROUP BY 1),
  l AS (SELECT counterparty_id, avg(abs(total_amount - forecast)) / 2 AS a, avg(abs(total_amount - q)) / 2 AS b FROM {FLOWS} JOIN q USING (counterparty_id) GROUP BY 1)
  SELECT counterparty_id, round(a, 4) AS pinball, round(b, 4) AS baseline, round(1 - a / b, 4) AS d2_pinball FROM l""")
def _(t):
    return rounded(M.d2_pinball(flows(t), "total_amount", "forecast", 0.5, ["counterparty_id"]), 4)


@query("b11_absolute_net_error", f"SELECT round(avg(abs(a - p)), 4) AS absolute_net_error FROM (SELECT date, direction, sum(total_amount) AS a, sum(forecast) AS p FROM {FLOWS} GROUP BY 1, 2)")
def _(t):
    return rounded(M.absolute_net_error(flows(t), "date", "direction", "total_amount", "forecast"), 4)


@query("b11_absolute_net_error_by_date", f"""SELECT round(avg(abs(a - p)), 4) AS absolute_net_error FROM (SELECT date, sum(CASE WHEN direction = 'IN' THEN total_amount ELSE -total_amount END) AS a,
  sum(CASE WHEN direction = 'IN' THEN forecast ELSE -forecast END) AS p FROM {FLOWS} GROUP BY 1)""")
def _(t):
    return rounded(M.absolute_net_error(flows(t), "date", "direction", "total_amount", "forecast", net_by_date=True), 4)


JUDGED = "(SELECT doc_id, quality, toxic, (n_chars % 1000) / 1000 AS score, ((n_chars % 1000) >= 400)::INT AS guess FROM labels JOIN documents USING (doc_id))"


def judged(t):
    score = F.col("n_chars") % 1000
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", (score / 1000).alias("score"), (score >= 400).cast("int").alias("guess"))


@query("b12_classification", f"""WITH c AS (SELECT count_if(quality = 1 AND guess = 1) AS tp, count_if(quality = 0 AND guess = 1) AS fp, count_if(quality = 1 AND guess = 0) AS fn, count_if(quality = guess) AS ok, count(*) AS n FROM {JUDGED})
  SELECT round(ok / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, n FROM c""")
def _(t):
    return rounded(M.classification_metrics(judged(t), "quality", "guess"))


CLASSES = "(SELECT l_returnflag AS y, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE chr((65 + l_linenumber * 13 % 18)::INT) END AS p FROM lineitem)"


def classes(t):
    other = F.chr((65 + F.col("l_linenumber") * 13 % 18).cast("int"))
    return t.lineitem.select(F.col("l_returnflag").alias("y"), F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise(other).alias("p"))


@query("a26_confusion_matrix", f"SELECT y AS actual, p AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM {CLASSES} GROUP BY 1, 2")
def _(t):
    return rounded(M.confusion_matrix(classes(t), "y", "p", "true"))


@query("a26_class_metrics", f"""WITH c AS (SELECT y, p, count(*) AS n FROM {CLASSES} GROUP BY 1, 2), k AS (SELECT y AS class FROM c UNION SELECT p FROM c),
  s AS (SELECT class, (SELECT coalesce(sum(n), 0) FROM c WHERE y = class AND p = class)::BIGINT AS tp, (SELECT coalesce(sum(n), 0) FROM c WHERE y = class)::BIGINT AS support, (SELECT coalesce(sum(n), 0) FROM c WHERE p = class) AS called FROM k)
  SELECT class, tp, support, round(CASE WHEN called > 0 THEN tp / called ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
    round(CASE WHEN tp > 0 THEN 2 * tp / (called + support) ELSE 0 END, 6) AS f1 FROM s""")
def _(t):
    return rounded(M.class_metrics(classes(t), "y", "p"))


@query("b12_classification_macro", f"""WITH c AS (SELECT y, p, count(*) AS n FROM {CLASSES} GROUP BY 1, 2), k AS (SELECT y AS class FROM c UNION SELECT p FROM c),
  s AS (SELECT class, (SELECT coalesce(sum(n), 0) FROM c WHERE y = class AND p = class) AS tp, (SELECT coalesce(sum(n), 0) FROM c WHERE y = class) AS support, (SELECT coalesce(sum(n), 0) FROM c WHERE p = class) AS called FROM k)
  SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(CASE WHEN called > 0 THEN tp / called ELSE 0 END), 6) AS precision, round(avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END), 6) AS recall,
    round(avg(CASE WHEN tp > 0 THEN 2 * tp / (called + support) ELSE 0 END), 6) AS f1, sum(support)::BIGINT AS n FROM s""")
def _(t):
    return rounded(M.classification_metrics(classes(t), "y", "p", "A"))


@query("b13_problem_type", "SELECT count(DISTINCT o_totalprice) AS unique_count, count(o_totalprice) AS n, round(count(DISTINCT o_totalprice) / count(o_totalprice), 6) AS unique_ratio, 'regression' AS problem_type FROM orders")
def _(t):
    return rounded(M.problem_type(t.orders, "o_totalprice"))


CURVE = f"""(SELECT score, sum(sum(quality)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - quality)) OVER (ORDER BY score DESC) AS fp, sum(quality) AS pos, sum(1 - quality) AS neg,
  sum(sum(quality)) OVER () AS p, sum(sum(1 - quality)) OVER () AS n FROM {JUDGED} GROUP BY 1)"""


@query("b14_roc_curve", f"SELECT score AS threshold, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM {CURVE}")
def _(t):
    return rounded(M.roc_curve(judged(t), "quality", "score"))


@query("b14_roc_summary", f"""WITH c AS (SELECT *, tp / p AS tpr, fp / n AS fpr FROM {CURVE}), a AS (SELECT round(sum(neg * (tp - pos / 2)) / any_value(p * n), 6) AS auc FROM c)
  SELECT auc, (SELECT arg_max(score, (tpr - fpr, score)) FROM c) AS best_threshold, (SELECT round(arg_max(tpr, (tpr - fpr, score)), 6) FROM c) AS best_tpr, (SELECT round(arg_max(fpr, (tpr - fpr, score)), 6) FROM c) AS best_fpr,
  CASE WHEN auc >= 0.9 THEN 'Excellent' WHEN auc >= 0.8 THEN 'Good' WHEN auc >= 0.7 THEN 'Fair' WHEN auc >= 0.6 THEN 'Poor' ELSE 'Very Poor (worse than random)' END AS interpretation FROM a""")
def _(t):
    return rounded(M.roc_summary(judged(t), "quality", "score"))


@query("b15_precision_recall_curve", f"SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END, 6) AS f1 FROM {CURVE}")
def _(t):
    return rounded(M.precision_recall_curve(judged(t), "quality", "score"))


@query("b15_precision_recall_summary", f"""WITH c AS (SELECT *, tp / (tp + fp) AS pr, coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), 1) AS before, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END AS f FROM {CURVE})
  SELECT round(sum(pos / p * pr), 6) AS average_precision, round(sum(pos / p * (pr + before) / 2), 6) AS pr_auc, round(any_value(p / (p + n)), 6) AS baseline, arg_max(score, (round(f, 12), score)) AS best_threshold, round(max(f), 6) AS best_f1 FROM c""")
def _(t):
    return rounded(M.precision_recall_summary(judged(t), "quality", "score"))


@query("b16_residuals", f"""WITH e AS (SELECT l_orderkey, l_linenumber, total_amount - forecast AS e FROM {FLOWS}), s AS (SELECT avg(e) AS m, stddev_pop(e) AS s FROM e)
  SELECT l_orderkey, l_linenumber, round(e, 4) AS residual, round((e - m) / s, 6) AS standardised_residual FROM e, s""")
def _(t):
    out = M.residuals(flows(t), "total_amount", "forecast").select("l_orderkey", "l_linenumber", "residual", "standardised_residual")
    return rounded(out.withColumn("residual", F.round("residual", 4)))


@query("b16_residual_summary", f"""SELECT 'residual' AS "column", count(e) AS count, round(avg(e), 4) AS mean, round(stddev_samp(e), 4) AS std, round(min(e), 4) AS min, round(quantile_cont(e, .25), 4) AS q1, round(median(e), 4) AS median,
  round(quantile_cont(e, .75), 4) AS q3, round(max(e), 4) AS max, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_pct FROM (SELECT total_amount - forecast AS e FROM {FLOWS})""")
def _(t):
    return rounded(M.residual_summary(flows(t), "total_amount", "forecast"), 4)


@query("b16_residual_histogram", f"""WITH e AS (SELECT total_amount - forecast AS e FROM {FLOWS}), b AS (SELECT min(e) AS lo, (max(e) - min(e)) / 30 AS w FROM e), c AS (SELECT least(floor((e - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM e, b GROUP BY 1)
  SELECT r.bin, coalesce(n, 0) AS n, round(lo + r.bin * w, 4) AS lower, round(lo + (r.bin + 1) * w, 4) AS upper FROM range(30) r(bin) LEFT JOIN c ON c.bin = r.bin, b""")
def _(t):
    return rounded(M.residual_histogram(flows(t), "total_amount", "forecast"), 4)


@query("b16_residual_quantiles", f"""SELECT round(p / 100, 4) AS probability, round((SELECT quantile_cont(total_amount - forecast, [{', '.join(str((i + 1) / 100) for i in range(99))}]) FROM {FLOWS})[p], 4) AS observed FROM range(1, 100) r(p)""")
def _(t):
    return rounded(M.residual_quantiles(flows(t), "total_amount", "forecast").drop("theoretical"), 4)


# ---- models ----------------------------------------------------------------------------


@query("b20_linear_regression", """WITH r AS (SELECT regr_slope(p_retailprice, p_partkey) AS k, regr_intercept(p_retailprice, p_partkey) AS c FROM part)
  SELECT p_partkey, p_retailprice, round(c + k * p_partkey, 4) AS prediction FROM part, r""")
def _(t):
    base = t.part.select("p_partkey", "p_retailprice")
    return rounded(ML.fit_model(base, "linear_regression", "p_retailprice", ["p_partkey"]).predict(base), 4)


@query("b20_every_model", "SELECT m AS model_type, count(*) AS n, TRUE AS beats_mean FROM part, unnest(['linear_regression', 'lasso', 'elastic_net', 'huber', 'decision_tree', 'random_forest', 'gradient_boosting', 'xgboost']) u(m) GROUP BY 1")
def _(t):
    base = t.part.select("p_partkey", "p_size", "p_retailprice")
    penalties = {"lasso": {"alpha": 0.1}, "elastic_net": {"alpha": 0.1}}  # everything else by its defaults
    spread = base.agg(F.stddev_pop("p_retailprice")).first()[0]
    parts = []
    for m in ML.MODEL_TYPES:
        scored = ML.fit_model(base, m, "p_retailprice", ["p_partkey", "p_size"], penalties.get(m)).predict(base)
        row = M.regression_metrics(scored, "p_retailprice", "prediction")
        parts.append(row.select(F.lit(m).alias("model_type"), "n", (F.col("rmse") < spread).alias("beats_mean")))
    return reduce(DataFrame.unionByName, parts)


EVENT_HASH = "md5(event_id || '|42')"


@query("b21_train", f"""WITH s AS (SELECT event_id, user_id::DOUBLE AS x, value AS y, CASE WHEN ('0x' || substr({EVENT_HASH}, 1, 8))::BIGINT / 4294967296 < 0.8 THEN 'train' ELSE 'test' END AS split FROM events),
  r AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS c FROM s WHERE split = 'train')
  SELECT split, count(*) AS n, round(sqrt(avg(pow(y - c - k * x, 2))), 4) AS rmse, round(avg(abs(y - c - k * x)), 4) AS mae FROM s, r GROUP BY 1""")
def _(t):
    _, metrics = ML.train(t.events.select("event_id", "user_id", "value"), "value", ["event_id"])
    return rounded(metrics.select("split", "n", "rmse", "mae"), 4)


@query("b22_importance", "SELECT 1 AS rank, 'p_partkey' AS feature, count(*) AS n FROM part UNION ALL SELECT 2, 'p_size', count(*) FROM part")
def _(t):
    model = ML.fit_model(t.part, "decision_tree", "p_retailprice", ["p_size", "p_partkey"])
    return model.importance_table(t.spark, 2).select("rank", "feature").withColumn("n", F.lit(t.part.count()))


@query("b22_importance_of_weights", """WITH m AS (SELECT var_pop(p_size) AS xx, covar_pop(p_size, p_partkey) AS xz, var_pop(p_partkey) AS zz, covar_pop(p_size, p_retailprice) AS xy, covar_pop(p_partkey, p_retailprice) AS zy FROM part),
  w AS (SELECT 'p_size' AS feature, abs((xy * zz - zy * xz) / (xx * zz - xz * xz)) AS importance FROM m UNION ALL SELECT 'p_partkey', abs((zy * xx - xy * xz) / (xx * zz - xz * xz)) FROM m)
  SELECT (row_number() OVER (ORDER BY importance DESC, feature))::INT AS rank, feature, round(importance, 6) AS importance FROM w""")
def _(t):
    return rounded(ML.fit_model(t.part, "linear_regression", "p_retailprice", ["p_size", "p_partkey"]).importance_table(t.spark))


@query("b18_cross_validate", f"""WITH s AS (SELECT user_id::DOUBLE AS x, value AS y, (row_number() OVER (ORDER BY {EVENT_HASH}, event_id) - 1) % 5 AS fold FROM events),
  r AS (SELECT f.fold, regr_slope(y, x) AS k, regr_intercept(y, x) AS c FROM range(5) f(fold) JOIN s ON s.fold <> f.fold GROUP BY 1),
  m AS (SELECT fold, sqrt(avg(pow(y - c - k * x, 2))) AS rmse, avg(abs(y - c - k * x)) AS mae FROM s JOIN r USING (fold) GROUP BY 1)
  SELECT 'rmse' AS metric, round(avg(rmse), 4) AS mean, round(stddev_pop(rmse), 4) AS std, round(min(rmse), 4) AS min, round(max(rmse), 4) AS max, count(*) AS folds FROM m
  UNION ALL SELECT 'mae', round(avg(mae), 4), round(stddev_pop(mae), 4), round(min(mae), 4), round(max(mae), 4), count(*) FROM m""")
def _(t):
    out = ML.cross_validate(t.events.select("event_id", "user_id", "value"), "linear_regression", "value", ["user_id"], ["event_id"])
    return rounded(out.where("metric IN ('rmse', 'mae')"), 4)


# Gaussian naive Bayes: per class the share of rows, and mean and variance of each feature (plus 1e-9 of the largest variance of any feature).
def _bayes_sql(train: str, test: str, fold: str) -> str:
    """Predictions of the rows of ``test`` by a model of the rows of ``train``, per ``fold``."""
    return f"""(WITH u AS (SELECT fold, 1e-9 * greatest(var_pop(q), var_pop(d), var_pop(x)) AS e FROM {train} GROUP BY 1),
      m AS (SELECT fold, y, ln(count(*) / sum(count(*)) OVER (PARTITION BY fold)) AS prior, avg(q) AS mq, avg(d) AS md, avg(x) AS mx, var_pop(q) + any_value(e) AS vq, var_pop(d) + any_value(e) AS vd, var_pop(x) + any_value(e) AS vx FROM {train} JOIN u USING (fold) GROUP BY fold, y)
      SELECT t.{fold} AS fold, t.k, t.y, arg_max(m.y, prior - 0.5 * (ln(vq) + ln(vd) + ln(vx) + pow(t.q - mq, 2) / vq + pow(t.d - md, 2) / vd + pow(t.x - mx, 2) / vx)) AS p FROM {test} t JOIN m ON m.fold = t.{fold} GROUP BY ALL)"""


_VISITS = "(SELECT event_type AS y, event_id AS k, user_id::DOUBLE AS q, value AS d, hour(ts)::DOUBLE AS x FROM events)"


def visits(t):
    return t.events.select(F.col("event_type").alias("y"), F.col("event_id").alias("k"), F.col("user_id").cast("double").alias("q"), F.col("value").alias("d"), F.hour("ts").cast("double").alias("x"))


_PLACED = f"(SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(k || '|42'), k) - 1) % 5 AS own FROM {_VISITS})"
_TRAINED = f"(SELECT f.fold, s.* FROM range(5) f(fold) JOIN {_PLACED} s ON s.own <> f.fold)"


@query("b18_cross_validate_classes", f"""WITH s AS (SELECT * FROM {_bayes_sql(_TRAINED, _PLACED, 'own')}), c AS (SELECT fold, y, p, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT fold, y AS class FROM c UNION SELECT fold, p FROM c),
  r AS (SELECT fold, class, coalesce((SELECT sum(n) FROM c WHERE c.fold = k.fold AND y = class AND p = class), 0) AS tp, coalesce((SELECT sum(n) FROM c WHERE c.fold = k.fold AND y = class), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE c.fold = k.fold AND p = class), 0) AS called FROM k),
  f AS (SELECT fold, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN called > 0 THEN tp / called ELSE 0 END) AS precision, avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END) AS recall, avg(2 * tp / (called + support)) AS f1 FROM r GROUP BY 1)
  SELECT metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, count(*) AS folds FROM (UNPIVOT f ON accuracy, precision, recall, f1 INTO NAME metric VALUE value) GROUP BY 1""")
def _(t):
    return rounded(C.cross_validate_classifier(visits(t), "naive_bayes", "y", ["q", "d", "x"], ["k"]), 4)


@query("b26_class_shares", f"""WITH s AS (SELECT * FROM {_bayes_sql(f'(SELECT 0 AS fold, * FROM {_VISITS})', f'(SELECT 0 AS fold, * FROM {_VISITS})', 'fold')})
  SELECT p AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY 1""")
def _(t):
    rows = visits(t)
    return rounded(C.class_shares(C.fit_classifier(rows, "naive_bayes", "y", ["q", "d", "x"]).predict(rows)))


# ---- backtests and search --------------------------------------------------------------


def day_events(t):
    return t.events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), "event_id", "user_id", "value")


FOLDS = {"input_steps": 10, "forecast_horizon": 5, "stride": 5}
DAYS = "(SELECT date_trunc('day', ts) AS date, event_id, user_id, value FROM events)"


def _backtest_sql(x):
    return f"""(WITH p AS (SELECT e.*, e.{x}::DOUBLE AS x, fold, split FROM {DAYS} e JOIN {_folds_sql(DAYS, 'k * 5').replace('FLOOR_', 's')} USING (date)),
      r AS (SELECT fold, regr_slope(value, x) AS k, regr_intercept(value, x) AS c FROM p WHERE split = 'train' GROUP BY 1)
      SELECT fold, split, count(*) AS n, sqrt(avg(pow(value - c - k * x, 2))) AS rmse, avg(abs(value - c - k * x)) AS mae FROM p JOIN r USING (fold) GROUP BY 1, 2)"""


@query("b17_backtest", f"SELECT fold, split, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae FROM {_backtest_sql('user_id')}")
def _(t):
    _, found, _ = B.backtest(day_events(t), "linear_regression", "value", ["user_id"], "date", ["event_id"], FOLDS, refit=False)
    return rounded(found.select("fold", "split", "n", "rmse", "mae"), 4)


@query("s12_score_sink", f"""SELECT fold, split, 'rmse' AS score_name, round(rmse, 4) AS score_value, 'run1' AS run_id FROM {_backtest_sql('user_id')}
  UNION ALL SELECT fold, split, 'mae', round(mae, 4), 'run1' FROM {_backtest_sql('user_id')}""")
def _(t):
    _, found, _ = B.backtest(day_events(t), "linear_regression", "value", ["user_id"], "date", ["event_id"], FOLDS, refit=False)
    path = append_rows(B.long_scores(found, "run1"), "hpt_scores")
    rows = t.spark.read.parquet(path).where("score_name IN ('rmse', 'mae')")
    return rounded(rows.select("fold", "split", "score_name", "score_value", "run_id"), 4)


@query("b23_search", f"""SELECT 0 AS trial, 'user_id' AS features, round(avg(rmse), 4) AS value FROM {_backtest_sql('user_id')} WHERE split = 'validation' AND fold >= 2
  UNION ALL SELECT 1, 'event_id', round(avg(rmse), 4) FROM {_backtest_sql('event_id')} WHERE split = 'validation' AND fold >= 2""")
def _(t):
    trials = [{"parameters": {}, "features": ["user_id"]}, {"parameters": {}, "features": ["event_id"]}]
    out = B.search(day_events(t), "linear_regression", "value", ["user_id", "event_id"], "date", ["event_id"], FOLDS, trials=trials, last_folds=2)
    return rounded(out.select("trial", "features", "value"), 4)


SPACE = {"alpha": {"type": "float", "low": 0.001, "high": 10.0, "log": True}, "l1_ratio": {"type": "categorical", "choices": [0.1, 0.5, 0.9]}, "max_iter": {"type": "int", "low": 20, "high": 60, "step": 20}}
DRAWN = B.drawn_trials(["user_id", "event_id"], ["event_id"], SPACE)


def _shrunk(z):
    return f"sign({z}) * greatest(abs({z}) - alpha * l1, 0)"


_TRIALS_SQL = ", ".join(
    "({}, {!r}::DOUBLE, {!r}::DOUBLE, {}, {}, '{}', '{}')".format(
        i, t["parameters"]["alpha"], t["parameters"]["l1_ratio"], int("user_id" in t["features"]), int("event_id" in t["features"]), json.dumps(t["parameters"], sort_keys=True), ",".join(t["features"]))
    for i, t in enumerate(DRAWN)
)


# Both weights of a trial by twenty rounds of coordinate descent on the moments of each fold.
@query("b23_random_search", f"""WITH RECURSIVE p AS (SELECT e.user_id::DOUBLE AS x, e.event_id::DOUBLE AS z, e.value AS y, fold, split FROM {DAYS} e JOIN {_folds_sql(DAYS, 'k * 5').replace('FLOOR_', 's')} USING (date)),
  m AS (SELECT fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, covar_pop(x, z) AS xz, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM p WHERE split = 'train' GROUP BY 1),
  t(trial, alpha, l1, ux, uz, parameters, features) AS (VALUES {_TRIALS_SQL}),
  w AS (SELECT trial, fold, 0 AS k, 0::DOUBLE AS b, 0::DOUBLE AS c FROM t, m UNION ALL
    SELECT trial, fold, k + 1, b, uz * {_shrunk('zy - xz * b')} / (zz + alpha * (1 - l1)) FROM (SELECT trial, fold, k, alpha, l1, uz, zy, xz, zz, ux * {_shrunk('xy - xz * c')} / (xx + alpha * (1 - l1)) AS b FROM w JOIN m USING (fold) JOIN t USING (trial) WHERE k < 20)),
  s AS (SELECT trial, fold, sqrt(avg(pow(y - (my - b * mx - c * mz) - b * x - c * z, 2))) AS rmse FROM w JOIN m USING (fold) JOIN p USING (fold) WHERE k = 20 AND split = 'validation' GROUP BY ALL)
  SELECT trial, parameters, features, round(avg(rmse), 4) AS value FROM s JOIN t USING (trial) GROUP BY ALL""")
def _(t):
    return rounded(B.search(day_events(t), "elastic_net", "value", ["user_id", "event_id"], "date", ["event_id"], FOLDS, SPACE, optional_features=["event_id"]), 4)


@query("b16_w16_final_predictions", f"""WITH p AS (SELECT e.*, fold, split FROM {DAYS} e JOIN {_folds_sql(DAYS, 'k * 3').replace('FLOOR_', 's').replace('(n - 15) // 5', '(n - 15) // 3')} USING (date))
  SELECT event_id, max(fold) AS fold, 'validation' AS split FROM p WHERE split = 'validation' GROUP BY 1 UNION ALL SELECT event_id, NULL, 'test' FROM {DAYS} WHERE date >= TIMESTAMP '2024-01-29'""")
def _(t):
    rows = P.backtest_folds(day_events(t), "date", 10, 5, 3)
    test = day_events(t).where("date >= timestamp_ntz'2024-01-29'").select("event_id", F.lit("test").alias("split"))
    return B.final_predictions(rows.select("event_id", "fold", "split"), test, ["event_id"]).select("event_id", "fold", "split")


# ---- selection, runs -------------------------------------------------------------------

RUNS = f"""(SELECT direction AS experiment_id, 'run' || counterparty_id % 10 AS run_id, 'validation' AS split, 'mae' AS score_name, avg(abs_error) AS score_value FROM {ERRORS} GROUP BY 1, 2
  UNION ALL SELECT direction, 'run' || counterparty_id % 10, 'validation', 'bias', avg(total_amount - forecast) FROM {ERRORS} GROUP BY 1, 2)"""


def runs(t):
    base = with_errors(t).groupBy(F.col("direction").alias("experiment_id"), F.concat(F.lit("run"), (F.col("counterparty_id") % 10).cast("string")).alias("run_id")).agg(
        F.avg("abs_error").alias("mae"), F.avg(F.col("total_amount") - F.col("forecast")).alias("bias"))
    return base.unpivot(["experiment_id", "run_id"], ["mae", "bias"], "score_name", "score_value").withColumn("split", F.lit("validation"))


@query("b24_model_selection", f"""WITH b AS (SELECT experiment_id, arg_min(run_id, (score_value, run_id)) AS best FROM {RUNS} WHERE score_name = 'mae' GROUP BY 1), w AS (SELECT experiment_id, arg_max(run_id, (score_value, run_id)) AS old FROM {RUNS} WHERE score_name = 'mae' AND experiment_id = 'IN' GROUP BY 1)
  SELECT experiment_id, old AS run_id, 'disabled' AS status FROM w UNION ALL SELECT experiment_id, best, 'enabled' FROM b""")
def _(t):
    found = runs(t)
    worst = B.best_run(found.where("experiment_id = 'IN'"), "mae", "maximize").select(
        F.lit("IN").alias("experiment_id"), "run_id", F.lit("enabled").alias("status"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    return B.selection_changes(found, worst, "mae")


@query("b27_compare_models", f"""WITH p AS (SELECT 'a' AS model, total_amount AS y, forecast AS p FROM {FLOWS} UNION ALL SELECT 'b', total_amount, 50000 FROM {FLOWS} UNION ALL SELECT 'c', total_amount, total_amount * 0.9 FROM {FLOWS}),
  m AS (SELECT model, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2 FROM p GROUP BY 1),
  l AS (SELECT model, 'rmse' AS metric, rmse AS value, rmse AS g FROM m UNION ALL SELECT model, 'mae', mae, mae FROM m UNION ALL SELECT model, 'r2', r2, -r2 FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY g, model) AS rank FROM l)
  SELECT model, metric, round(value, 4) AS value, rank, sum((rank = 1)::INT) OVER (PARTITION BY model)::BIGINT AS wins FROM r""")
def _(t):
    y = F.col("total_amount")
    stacked = [flows(t).select(F.lit(n).alias("model"), y.alias("y"), p.alias("p")) for n, p in (("a", F.col("forecast")), ("b", F.lit(50000.0)), ("c", y * 0.9))]
    return rounded(M.compare_models(reduce(DataFrame.unionByName, stacked), "model", "y", "p"), 4)


@query("b28_compare_runs", f"""SELECT run_id, round(max(CASE WHEN score_name = 'mae' THEN score_value END), 4) AS mae, round(max(CASE WHEN score_name = 'bias' THEN score_value END), 4) AS bias FROM {RUNS} WHERE experiment_id = 'IN' AND run_id IN ('run1', 'run2', 'run3') GROUP BY 1""")
def _(t):
    return rounded(M.run_table(runs(t).where("experiment_id = 'IN'"), names=["mae", "bias"], runs=["run1", "run2", "run3"]), 4)


@query("b29_search_runs", f"""WITH w AS (SELECT run_id, max(CASE WHEN score_name = 'mae' THEN score_value END) AS mae, max(CASE WHEN score_name = 'bias' THEN score_value END) AS bias FROM {RUNS} WHERE experiment_id = 'OUT' GROUP BY 1)
  SELECT run_id, round(mae, 4) AS mae, round(bias, 4) AS bias FROM w WHERE mae > 100 AND bias > 0 OR bias < -50 ORDER BY w.mae DESC LIMIT 5""")
def _(t):
    table = M.run_table(runs(t).where("experiment_id = 'OUT'"), names=["mae", "bias"])
    return rounded(M.search_runs(table, "(mae > 100 AND bias > 0) OR bias < -50", ["-mae"], 5), 4)


@query("a24_b24_best_score", f"SELECT arg_min(fold, (round(score_value, 6), fold)) AS run_id, round(min(score_value), 4) AS score_value FROM {SCORES} WHERE score_name = 'mae' AND split = 'validation'")
def _(t):
    found = scores(t).withColumnRenamed("fold", "run_id")
    return rounded(B.best_run(found, "mae"), 4)


# ---- forecasts -------------------------------------------------------------------------

LAG_STEPS = [{"name": "Lag", "parameters": {"lags": {"value": [7]}, "columns_to_order_by": ["date"], "columns_to_partition_by": ["event_type"]}}]
FUTURE = f"""(SELECT date, event_type, value FROM {DAILY} UNION ALL SELECT unnest(generate_series((SELECT max(date) FROM {DAILY}) + INTERVAL 1 DAY, TIMESTAMP '2024-02-05', INTERVAL 1 DAY)), event_type, 0 FROM (SELECT DISTINCT event_type FROM events))"""
LAGGED = "(SELECT *, coalesce(lag(value, 7) OVER (PARTITION BY event_type ORDER BY date), 0) AS x FROM $)"


@query("b25_forecast_inference", f"""WITH r AS (SELECT regr_slope(value, x) AS k, regr_intercept(value, x) AS c FROM {LAGGED.replace('$', DAILY)}), f AS (SELECT * FROM {LAGGED.replace('$', FUTURE)} WHERE date BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-02-05')
  SELECT event_type, date, 'predictions' AS prediction_name, round(greatest(c + k * x, 0), 4) AS prediction_value FROM f, r""")
def _(t):
    series = daily(t).drop("dim_uid")
    chain = FeatureChain(LAG_STEPS)
    features = chain.fit_transform(series)
    model = ML.fit_model(features, "linear_regression", "value", ["value_lag_7"])
    rows = B.infer(series, model, chain, "date", ["event_type"], "value", "2024-02-05", "2024-02-01")
    return rounded(rows.select(F.get_json_object("dimensions", "$.event_type").alias("event_type"), "date", "prediction_name", "prediction_value"), 4)


@query("s11_prediction_sink", f"""WITH r AS (SELECT regr_slope(value, x) AS k, regr_intercept(value, x) AS c FROM {LAGGED.replace('$', DAILY)}), f AS (SELECT * FROM {LAGGED.replace('$', FUTURE)} WHERE date = TIMESTAMP '2024-02-05')
  SELECT 'i1' AS inference_id, to_json({{'event_type': event_type}})::VARCHAR AS dimensions, date, round(greatest(c + k * x, 0), 4) AS prediction_value FROM f, r""")
def _(t):
    series = daily(t).drop("dim_uid")
    chain = FeatureChain(LAG_STEPS)
    model = ML.fit_model(chain.fit_transform(series), "linear_regression", "value", ["value_lag_7"])
    rows = B.infer(series, model, chain, "date", ["event_type"], "value", "2024-02-05", ids={"inference_id": "i1"})
    back = t.spark.read.parquet(append_rows(rows, "inference"))
    return rounded(back.select("inference_id", "dimensions", "date", "prediction_value"), 4)


@query("b19_test_period_forecast", f"""WITH h AS (SELECT * FROM {LAGGED.replace('$', DAILY)}), r AS (SELECT regr_slope(value, x) AS k, regr_intercept(value, x) AS c FROM h WHERE date < TIMESTAMP '2024-01-25')
  SELECT event_type, date, 'test' AS split, round(greatest(c + k * x, 0), 4) AS prediction FROM h, r WHERE date >= TIMESTAMP '2024-01-25'""")
def _(t):
    series = daily(t).drop("dim_uid")
    past, test = series.where("date < timestamp_ntz'2024-01-25'"), series.where("date >= timestamp_ntz'2024-01-25'")
    chain = FeatureChain(LAG_STEPS)
    model = ML.fit_model(chain.fit_transform(past), "linear_regression", "value", ["value_lag_7"])
    rows, _ = B.forecast_test_period(model, chain, past, test, "date", "value")
    return rounded(rows.select("event_type", "date", "split", "prediction"), 4)


@query("b31_workflow", f"""WITH r AS (SELECT regr_slope(value, x) AS k, regr_intercept(value, x) AS c FROM {LAGGED.replace('$', DAILY)} WHERE date <= TIMESTAMP '2024-01-24'), f AS (SELECT * FROM {LAGGED.replace('$', FUTURE)} WHERE date BETWEEN TIMESTAMP '2024-02-03' AND TIMESTAMP '2024-02-05')
  SELECT event_type, date, round(greatest(c + k * x, 0), 4) AS prediction_value FROM f, r""")
def _(t):
    source = t.events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), "event_type", "value")
    work = B.Workspace(t.spark)
    work.create_use_case("u1", "events")
    work.create_experiment("e1", "u1", {
        "date_column": "date", "dimensions": ["event_type"], "metric": "value", "last_train_date": "2024-01-24", "last_test_date": "2024-01-30",
        "steps": LAG_STEPS, "features": ["value_lag_7"], "folds": {"input_steps": 12, "forecast_horizon": 4, "stride": 4},
    })
    work.build_features("e1", source, "fs1")
    work.tune("e1", "fs1", {"run1": ("linear_regression", {})})
    work.select("e1")
    rows = work.infer("e1", source, "2024-02-05", "2024-02-03")
    return rounded(rows.select(F.get_json_object("dimensions", "$.event_type").alias("event_type"), "date", "prediction_value"), 4)


@query("b26_batch_scoring", """WITH r AS (SELECT regr_slope(p_retailprice, p_partkey) AS k, regr_intercept(p_retailprice, p_partkey) AS c FROM part), p AS (SELECT c + k * p_partkey AS p FROM part, r)
  SELECT count(*) AS n, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std, round(min(p), 4) AS min, round(max(p), 4) AS max FROM p""")
def _(t):
    model = ML.fit_model(t.part, "linear_regression", "p_retailprice", ["p_partkey"])
    path = new_path(t.spark, "model")
    model.save(t.spark, path)
    scored = ML.batch_predict(t.part, ML.FittedModel.load(t.spark, path))
    return rounded(ML.prediction_summary(scored), 4)


# ---- explanations ----------------------------------------------------------------------

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def formula(df):
    """A fixed linear model, so that SQL can state every explanation."""
    return df.withColumn("prediction", 2 * F.col("l_quantity") - 30 * F.col("l_discount") + 5 * F.col("l_tax"))


@query("z1_partial_dependence", """WITH b AS (SELECT avg(2 * l_quantity - 30 * l_discount + 5 * l_tax) AS m, avg(2 * l_quantity) AS mq, avg(30 * l_discount) AS md, quantile_cont(l_extendedprice, .05) AS lo, quantile_cont(l_extendedprice, .95) AS hi FROM lineitem),
  q AS (SELECT row_number() OVER (ORDER BY l_discount) - 1 AS i, l_discount AS v FROM (SELECT DISTINCT l_discount FROM lineitem))
  SELECT 'l_discount' AS feature, i::INT AS point, v AS grid_value, round(m + md - 30 * v, 4) AS average_prediction FROM q, b
  UNION ALL SELECT 'l_extendedprice', i::INT, round(lo + (hi - lo) * i / 49, 4), round(m, 4) FROM range(50) r(i), b""")
def _(t):
    base = t.lineitem.select(*FEATURES, "l_extendedprice")
    out = Z.partial_dependence(base, formula, ["l_discount", "l_extendedprice"], reads=FEATURES)
    return rounded(out, 4)


@query("z1_dependence_trend", """WITH b AS (SELECT avg(2 * l_quantity - 30 * l_discount + 5 * l_tax) AS m, avg(30 * l_discount) AS md FROM lineitem), q AS (SELECT DISTINCT l_discount AS v FROM lineitem)
  SELECT 'l_discount' AS feature, min(v) AS grid_min, max(v) AS grid_max, round(min(m + md - 30 * v), 4) AS effect_min, round(max(m + md - 30 * v), 4) AS effect_max, 'decreasing' AS trend FROM q, b""")
def _(t):
    return rounded(Z.dependence_trend(Z.partial_dependence(t.lineitem.select(*FEATURES), formula, ["l_discount"])).drop("slope"), 4)


def supplier_lines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *FEATURES)


@query("z2_contributions", """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, f AS feature, round(CASE f WHEN 'l_quantity' THEN 2 * (l_quantity - q) WHEN 'l_discount' THEN -30 * (l_discount - d) ELSE 5 * (l_tax - x) END, 4) + 0.0 AS contribution
  FROM lineitem, m, unnest(['l_quantity', 'l_discount', 'l_tax']) u(f)""")
def _(t):
    return rounded(Z.feature_contributions(supplier_lines(t), formula, FEATURES, ["l_orderkey", "l_linenumber", "l_partkey"]), 4)


@query("z3_difference_contributions", """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, f AS feature, round(CASE f WHEN 'l_quantity' THEN l_quantity - q WHEN 'l_discount' THEN l_discount - d ELSE l_tax - x END, 6) + 0.0 AS contribution
  FROM lineitem, m, unnest(['l_quantity', 'l_discount', 'l_tax']) u(f)""")
def _(t):
    return rounded(Z.feature_contributions(supplier_lines(t), formula, FEATURES, ["l_orderkey", "l_linenumber", "l_partkey"], "difference"), 6)


def parts(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("l_quantity"), (F.col("p_retailprice") / 1000).alias("l_discount"), (F.col("p_partkey") % 7).cast("double").alias("l_tax"))


PARTS = "(SELECT p_partkey, p_size::DOUBLE AS q, p_retailprice / 1000 AS d, (p_partkey % 7)::DOUBLE AS x FROM part)"


@query("z4_explain_row", f"""WITH p AS (SELECT * FROM {PARTS}), r AS (SELECT * FROM p WHERE p_partkey = 77), l AS (SELECT 'l_quantity' AS feature, q AS v, 2 AS k FROM p UNION ALL SELECT 'l_discount', d, -30 FROM p UNION ALL SELECT 'l_tax', x, 5 FROM p),
  s AS (SELECT 'l_quantity' AS feature, q AS v FROM r UNION ALL SELECT 'l_discount', d FROM r UNION ALL SELECT 'l_tax', x FROM r)
  SELECT feature, round(s.v, 6) AS value, round(avg(l.v), 6) AS mean, round(stddev_samp(l.v), 6) AS std, round(s.v - avg(l.v), 6) AS deviation, round((s.v - avg(l.v)) / stddev_samp(l.v), 6) AS z_score,
  round(100.0 * count_if(l.v <= s.v) / count(*), 6) AS percentile, round(abs(any_value(k) * (s.v - avg(l.v))), 6) AS importance FROM l JOIN s USING (feature) GROUP BY feature, s.v""")
def _(t):
    return rounded(Z.explain_row(parts(t), formula, FEATURES, "p_partkey", 77))


@query("z4_prediction_context", f"""WITH p AS (SELECT p_partkey, 2 * q - 30 * d + 5 * x AS p FROM {PARTS}) SELECT round(max(CASE WHEN p_partkey = 77 THEN p END), 6) AS prediction, round(avg(p), 6) AS baseline, round(stddev_pop(p), 6) AS std,
  round((max(CASE WHEN p_partkey = 77 THEN p END) - avg(p)) / stddev_pop(p), 6) AS z_score FROM p""")
def _(t):
    return rounded(Z.prediction_context(parts(t), formula, "p_partkey", 77))


@query("t5_nearest_rows", f"""WITH p AS (SELECT * FROM {PARTS}), s AS (SELECT stddev_samp(q) AS sq, stddev_samp(d) AS sd, stddev_samp(x) AS sx FROM p), r AS (SELECT * FROM p WHERE p_partkey = 77)
  SELECT p.p_partkey, round(sqrt(pow((p.q - r.q) / sq, 2) + pow((p.d - r.d) / sd, 2) + pow((p.x - r.x) / sx, 2)), 6) AS distance FROM p, s, r WHERE p.p_partkey <> 77 ORDER BY sqrt(pow((p.q - r.q) / sq, 2) + pow((p.d - r.d) / sd, 2) + pow((p.x - r.x) / sx, 2)), 1 LIMIT 5""")
def _(t):
    return rounded(Z.nearest_rows(parts(t), FEATURES, "p_partkey", 77).select("p_partkey", "distance"))


@query("z5_shapley", f"""WITH p AS (SELECT * FROM {PARTS}), m AS (SELECT avg(q) AS q, avg(d) AS d, avg(x) AS x FROM p)
  SELECT p_partkey, f AS feature, round(CASE f WHEN 'l_quantity' THEN 2 * (p.q - m.q) WHEN 'l_discount' THEN -30 * (p.d - m.d) ELSE 5 * (p.x - m.x) END, 4) + 0.0 AS shapley_value FROM p, m, unnest(['l_quantity', 'l_discount', 'l_tax']) u(f)""")
def _(t):
    return rounded(Z.shapley_values(parts(t), formula, FEATURES, ["p_partkey"]), 4)


@query("z5_shapley_importance", f"""WITH p AS (SELECT * FROM {PARTS}), m AS (SELECT avg(q) AS q, avg(d) AS d, avg(x) AS x FROM p)
  SELECT f AS feature, round(avg(abs(CASE f WHEN 'l_quantity' THEN 2 * (p.q - m.q) WHEN 'l_discount' THEN -30 * (p.d - m.d) ELSE 5 * (p.x - m.x) END)), 6) AS mean_abs_shapley FROM p, m, unnest(['l_quantity', 'l_discount', 'l_tax']) u(f) GROUP BY 1""")
def _(t):
    return rounded(Z.shapley_importance(Z.shapley_values(parts(t), formula, FEATURES, ["p_partkey"])))


@query("z5_shapley_of_trees")
def _(t):
    """A forest over line items: values by paths, no copies of rows."""
    rows = supplier_lines(t)
    model = ML.fit_model(t.lineitem, "random_forest", "l_extendedprice", FEATURES, {"n_estimators": 20, "max_depth": 6})
    return Z.shapley_values(rows, model.predict, FEATURES, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("z6_local_surrogate", f"""SELECT 'l_quantity' AS feature, round(2 * stddev_samp(q), 4) AS weight_per_std, 2.0::DOUBLE AS weight FROM {PARTS} UNION ALL SELECT 'l_discount', round(-30 * stddev_samp(d), 4), -30.0 FROM {PARTS}
  UNION ALL SELECT 'l_tax', round(5 * stddev_samp(x), 4), 5.0 FROM {PARTS}""")
def _(t):
    return rounded(Z.local_surrogate(parts(t), formula, FEATURES, "p_partkey", 77), 4)


# ---- monitoring ------------------------------------------------------------------------

MONITOR = """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS actual_mean, round(avg(user_id), 6) AS prediction_mean,
  round(avg(abs(value - user_id)), 6) AS mae, round(avg(pow(value - user_id, 2)), 6) AS mse, round(sqrt(avg(pow(value - user_id, 2))), 6) AS rmse, round(sum(abs(value - user_id)) / sum(abs(value)), 6) AS wmape FROM events GROUP BY ALL"""


@query("m1_monitor_batch", MONITOR)
def _(t):
    return rounded(monitor.window_metrics(t.events, "ts", "value", "user_id", "1 day", ["event_type"]))


@query("m1_monitor_stream", MONITOR)
def _(t):
    out, checkpoint = new_path(t.spark, "monitor"), new_path(t.spark, "monitor-checkpoint")
    stream = monitor.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    monitor.start_monitor(stream, out, checkpoint, "ts", "value", "user_id", "1 day", "1 hour", None, ["event_type"]).awaitTermination()
    table = monitor.monitor_table(t.spark.read.parquet(out), t.events, "ts", "value", "user_id", "1 day", ["event_type"])
    return rounded(table.drop("state"))


@query("m1_drift_by_window", """WITH c AS (SELECT event_type, count_if(ts < TIMESTAMP '2024-01-08') AS r, count_if(ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27') AS c FROM events GROUP BY 1), s AS (SELECT sum(c) / sum(r) AS k FROM c)
, x AS (SELECT sum(pow(c - r * k, 2) / (r * k)) AS x FROM c, s),
  b AS (SELECT value, ts < TIMESTAMP '2024-01-08' AS old FROM events WHERE ts < TIMESTAMP '2024-01-08' OR ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27'),
  v AS (SELECT value, count_if(old) AS r, count_if(NOT old) AS c FROM b GROUP BY 1), f AS (SELECT sum(r) OVER (ORDER BY value) / sum(r) OVER () - sum(c) OVER (ORDER BY value) / sum(c) OVER () AS gap FROM v),
  d AS (SELECT (SELECT max(abs(gap)) FROM f) AS d, count_if(old) AS n, count_if(NOT old) AS m FROM b), k AS (SELECT d, least(1, greatest(0, 2 * sum(pow(-1, i - 1) * exp(-2 * i * i * d * d * n * m / (n + m))))) AS p FROM d, range(1, 101) t(i) GROUP BY d, n, m)
  SELECT 'event_type' AS "column", round(x, 6) AS statistic, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value, exp(-x / 2) * (1 + x / 2) < 0.05 AS drift_detected FROM x UNION ALL SELECT 'value', round(d, 6), round(p, 6), p < 0.05 FROM k""")
def _(t):
    baseline = t.events.where("ts < timestamp_ntz'2024-01-08'")
    return rounded(monitor.drift_by_window(t.events, baseline, "ts", ["event_type", "value"], "2024-01-20", "2024-01-27"))




# Every day from the 8th on against the days before it.
@query("m1_drift_stream", """WITH e AS (SELECT date_trunc('day', ts) AS day, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-08'), b AS (SELECT event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-08'),
  days AS (SELECT day, count(*) AS m, (SELECT count(*) FROM b) AS n FROM e GROUP BY 1),
  x AS (SELECT day, event_type, (SELECT count(*) FROM b WHERE b.event_type = t.event_type) AS r, (SELECT count(*) FROM e WHERE e.day = days.day AND e.event_type = t.event_type) AS c, m, n FROM days, (SELECT DISTINCT event_type FROM events) t),
  chi AS (SELECT day, sum(pow(c - r * m / n, 2) / (r * m / n)) AS s, any_value(m) AS m, any_value(n) AS n FROM x GROUP BY 1),
  u AS (SELECT day, value, 0 AS old FROM e UNION ALL SELECT day, value, 1 FROM b, days), v AS (SELECT day, value, count_if(old = 1) AS r, count_if(old = 0) AS c FROM u GROUP BY ALL),
  f AS (SELECT day, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY day) - sum(c) OVER w / sum(c) OVER (PARTITION BY day)) AS gap FROM v WINDOW w AS (PARTITION BY day ORDER BY value)),
  ks AS (SELECT day, d, m, n, (SELECT least(1, greatest(0, 2 * sum(pow(-1, i - 1) * exp(-2 * i * i * d * d * n * m / (n + m))))) FROM range(1, 101) t(i)) AS p FROM (SELECT day, max(gap) AS d FROM f GROUP BY 1) JOIN days USING (day))
  SELECT day AS window_start, 'event_type' AS "column", round(s, 6) AS statistic, round(exp(-s / 2) * (1 + s / 2), 6) AS p_value, n AS ref_n, m AS cur_n FROM chi UNION ALL SELECT day, 'value', round(d, 6), round(p, 6), n, m FROM ks""")
def _(t):
    baseline = drift.Baseline(t.events.where("ts < timestamp_ntz'2024-01-08'"), ["event_type", "value"])
    stream = monitor.read_stream(t.spark, t.folder, t.events.schema, "events.parquet").where("ts >= timestamp_ntz'2024-01-08'")
    out, checkpoint = new_path(t.spark, "drift"), new_path(t.spark, "drift-checkpoint")
    drift.start_drift_monitor(stream, baseline, out, checkpoint, "ts", refresh=None).awaitTermination()
    table = drift.drift_table(t.events.where("ts >= timestamp_ntz'2024-01-08'"), baseline, out, "ts")
    return rounded(table.select("window_start", "column", "statistic", "p_value", "ref_n", "cur_n"))
