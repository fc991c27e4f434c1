"""Projections, filters, joins, aggregations, sorts, sets, scalars and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.functions import scalars as X
from featherloom.operators import relational as R
from featherloom.queries import query
from featherloom.queries.shared import FLOWS, GAPPY, flows, gappy_events, longs, rounded
from featherloom.sources import files

# ---- sources and sinks -----------------------------------------------------------------


@query("s1_csv_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(t):
    source = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return longs(files.load_csv(t.spark, files.store_csv(source, "orders")), "o_orderkey", "o_custkey")


@query("s1_csv_column_kinds", """SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'categorical'),
  ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) v(column_name, kind)""")
def _(t):
    return files.column_kinds(files.load_csv(t.spark, files.store_csv(t.customer, "customer")))


@query("s2_parquet_round_trip", "SELECT * FROM lineitem")
def _(t):
    store = files.DatasetStore(t.spark)
    store.save(t.lineitem, "lineitem")
    return store.load("lineitem")


@query("s3_table_equality_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(t):
    named = t.orders.toDF(*[c.upper() for c in t.orders.columns])
    found = files.fetch_table(named, {"O_ORDERSTATUS": "F", "O_ORDERPRIORITY": "1-URGENT"})
    return found.select("o_orderkey", "o_totalprice")


@query("s4_membership_scan", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 14)")
def _(t):
    return files.scan_members(t.part, "p_size", [1, 5, 9, 14], ["p_partkey", "p_brand", "p_size"])


@query("s5_append_with_defaults", """SELECT event_type AS name, CAST(count(*) AS BIGINT) AS n, 2 AS copies, TRUE AS has_defaults
  FROM events GROUP BY 1""")
def _(t):
    rows = t.events.select("event_id", F.col("event_type").alias("name"))
    path = files.append_rows(rows, "scores")
    files.append_rows(rows, "scores", path)
    back = t.spark.read.parquet(path)
    return back.groupBy("name").agg(
        (F.count_distinct("event_id")).alias("n"),
        F.try_divide(F.count_distinct("id"), F.count_distinct("event_id")).cast("int").alias("copies"),
        F.bool_and(F.col("created_at").isNotNull()).alias("has_defaults"),
    )


@query("s6_pack_feature_rows", """SELECT c_custkey, ['c_acctbal', 'c_mktsegment']  AS columns,
  json_extract_string(to_json({'a': c_mktsegment}), '$.a') AS segment FROM customer""")
def _(t):
    packed = files.pack_features(t.customer, keys=["c_custkey"], columns=["c_acctbal", "c_mktsegment"])
    return packed.select("c_custkey", "columns", F.get_json_object("data", "$.c_mktsegment").alias("segment"))


@query("s7_unpack_feature_rows", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    columns = ["c_nationkey", "c_acctbal", "c_mktsegment"]
    packed = files.pack_features(t.customer, keys=["c_custkey"], columns=columns)
    return files.unpack_features(packed, t.customer.select(*columns).schema, keys=["c_custkey"])


# ---- projections -----------------------------------------------------------------------


@query("p1_select_cols", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    return R.select_cols(t.lineitem, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("p2_drop_cols", "SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def _(t):
    return R.drop_cols(t.lineitem, ["l_tax", "l_discount"])


@query("p3_rename_columns", "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return R.rename_columns(t.supplier, {"s_suppkey": "supplier_id", "s_name": "supplier_name", "unknown": "x"})


@query("p4_cast_types", """SELECT event_id, CAST(user_id AS VARCHAR) AS user_id,
  coalesce(CAST(CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE floor(value) END AS BIGINT) AS VARCHAR), '') AS value,
  event_type FROM events""")
def _(t):
    base = gappy_events(t).withColumn("value", F.floor("value")).drop("ts", "props")
    base = R.cast_types(R.cast_types(base, ["value"], "int"), ["value", "user_id"], "str")
    return R.cast_types(base, ["event_type"], "category")


@query("p5_drop_cols_zero_var", "SELECT event_id, value FROM events")
def _(t):
    base = t.events.select("event_id", "value", F.lit(1).alias("one"), F.lit(None).cast("string").alias("nothing"))
    return R.drop_cols_zero_var(base)


@query("p6_preview", """(SELECT o_orderkey, o_totalprice, 'head' AS part FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)
  UNION ALL (SELECT o_orderkey, o_totalprice, 'tail' AS part FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5)""")
def _(t):
    return R.preview(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 5, 5)


@query("p7_lower_names", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return R.lower_names(t.nation.toDF("N_NATIONKEY", "N_Name", "n_REGIONKEY"))


# ---- filters ---------------------------------------------------------------------------


@query("f1_filter_numeric", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def _(t):
    return R.filter_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", ">=", 45)


@query("f1_filter_not_equal_keeps_null", f"SELECT event_id, round(value, 6) AS value FROM {GAPPY} WHERE value IS DISTINCT FROM 10")
def _(t):
    return rounded(R.filter_rows(gappy_events(t).select("event_id", "value"), "value", "!=", 10))


@query("f2_filter_boolean", "SELECT event_id, TRUE AS is_click FROM events WHERE event_type = 'click'")
def _(t):
    base = t.events.select("event_id", (F.col("event_type") == "click").alias("is_click"))
    return R.filter_rows(base, "is_click", "==", "True")


@query("f3_filter_contains", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Tt]he [a-e]')")
def _(t):
    return R.filter_rows(t.documents, "text", "contains", "[Tt]he [a-e]").select("doc_id")


@query("f3_filter_not_contains", "SELECT p_partkey, p_type FROM part WHERE NOT regexp_matches(p_type, 'A.*S')")
def _(t):
    return R.filter_rows(t.part, "p_type", "not contains", "A.*S").select("p_partkey", "p_type")


@query("f4_filter_starts_ends", "SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1') OR suffix(o_orderpriority, 'LOW')")
def _(t):
    base = t.orders.select("o_orderkey", "o_orderpriority")
    return R.union_all(
        R.filter_rows(base, "o_orderpriority", "startswith", "1"), R.filter_rows(base, "o_orderpriority", "endswith", "LOW")
    )


@query("f5_out_of_bounds", f"SELECT event_id, round(value, 6) AS value FROM {GAPPY} WHERE value BETWEEN 20 AND 80")
def _(t):
    return rounded(R.drop_rows_out_of_bounds(gappy_events(t).select("event_id", "value"), "value", 20, 80))


@query("f6_drop_na", f"SELECT event_id, value FROM {GAPPY} WHERE value IS NOT NULL AND user_id IS NOT NULL")
def _(t):
    return R.drop_rows_na(gappy_events(t), ["value", "user_id"], "any").select("event_id", "value")


@query("f7_outliers_iqr", """WITH b AS (SELECT quantile_cont(l_extendedprice, .25) q1, quantile_cont(l_extendedprice, .75) q3,
    quantile_cont(l_quantity, .25) k1, quantile_cont(l_quantity, .75) k3 FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, b
  WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
    AND l_quantity BETWEEN k1 - 1.5 * (k3 - k1) AND k3 + 1.5 * (k3 - k1)""")
def _(t):
    kept = R.drop_outliers_iqr(t.lineitem, ["l_extendedprice", "l_quantity", "l_returnflag"])
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("f8_rare_labels", """WITH b AS (SELECT p_brand, count(*) n FROM part GROUP BY 1), s AS (SELECT p_size, count(*) n FROM part GROUP BY 1)
  SELECT p_partkey, p_brand, p_size FROM part
  WHERE p_brand IN (SELECT p_brand FROM b WHERE n >= 0.02 * (SELECT count(*) FROM part))
    AND p_size IN (SELECT p_size FROM s WHERE n >= 0.02 * (SELECT count(*) FROM part))""")
def _(t):
    return R.drop_rare_labels(t.part, ["p_brand", "p_size"], 0.02).select("p_partkey", "p_brand", "p_size")


@query("f11_select_dates", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def _(t):
    return R.select_dates(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1996-01-01", "1996-06-30")


@query("f12_training_cutoff", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1999-12-31'")
def _(t):
    return R.training_cutoff(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1999-12-31")


@query("f13_inference_window", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def _(t):
    return R.inference_window(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("f14_selection", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def _(t):
    kept = R.select_values(t.lineitem, {"l_returnflag": ["A", "R"], "l_linestatus": []})
    return kept.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query("f15_segment_keep_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t):
    return R.select_values(t.customer.select("c_custkey", "c_mktsegment"), {"c_mktsegment": ["BUILDING", "MACHINERY"]})


# ---- joins -----------------------------------------------------------------------------


@query("j1_merge_left", """SELECT o.*, c.* EXCLUDE (c_custkey), c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def _(t):
    return R.merge(t.orders, t.customer, ["o_custkey"], ["c_custkey"], "left")


@query("j1_merge_outer_same_key", """SELECT coalesce(o.k, l.k) AS k, o.n_orders, l.n_lines FROM
  (SELECT o_orderkey AS k, count(*)::BIGINT AS n_orders FROM orders GROUP BY 1) o
  FULL JOIN (SELECT l_orderkey + 100 AS k, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY 1) l ON o.k = l.k""")
def _(t):
    left = t.orders.groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("n_orders"))
    right = t.lineitem.groupBy((F.col("l_orderkey") + 100).alias("k")).agg(F.count("*").alias("n_lines"))
    return R.merge(left, right.withColumn("n_orders", F.lit(-1)), ["k"], how="outer")


@query("j2_concat", """WITH a AS (SELECT user_id, count(*)::BIGINT AS clicks FROM events WHERE event_type = 'click' GROUP BY 1),
  b AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, count(*)::BIGINT AS views FROM events WHERE event_type = 'view' GROUP BY 1),
  c AS (SELECT user_id * 2 AS user_id, count(*)::BIGINT AS errors FROM events WHERE event_type = 'error' GROUP BY 1),
  ab AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, clicks, views FROM a FULL JOIN b ON a.user_id IS NOT DISTINCT FROM b.user_id)
  SELECT coalesce(ab.user_id, c.user_id) AS user_id, clicks, views, errors FROM ab FULL JOIN c ON ab.user_id IS NOT DISTINCT FROM c.user_id""")
def _(t):
    def count_of(kind, key, name):
        return t.events.where(F.col("event_type") == kind).groupBy(key.alias("user_id")).agg(F.count("*").alias(name))

    user = F.col("user_id")
    return R.concat(
        count_of("click", user, "clicks"),
        count_of("view", F.when(user % 10 != 0, user), "views"),
        count_of("error", user * 2, "errors"),
    )


@query("j10_keep_and_drop_members", """SELECT c_custkey, c_name FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    pending = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    kept = R.keep_members(t.customer.select("c_custkey", "c_name"), "c_custkey", urgent)
    return R.drop_members(kept, "c_custkey", pending)


# ---- aggregation -----------------------------------------------------------------------


@query("a1_aggregate", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS mean_price,
  min(l_discount) AS min_l_discount, max(l_tax) AS max_l_tax, count(l_orderkey) AS count_l_orderkey, count(DISTINCT l_suppkey) AS nunique_l_suppkey,
  round(stddev_samp(l_extendedprice), 4) AS std_price, round(median(l_extendedprice), 4) AS median_price,
  arg_min(l_extendedprice, l_shipdate::VARCHAR || lpad(l_orderkey::VARCHAR, 12, '0') || l_linenumber) AS first_price
  FROM lineitem GROUP BY 1, 2""")
def _(t):
    out = R.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], [
        ("l_quantity", "sum"), ("l_extendedprice", "mean", "mean_price"), ("l_discount", "min"), ("l_tax", "max"),
        ("l_orderkey", "count"), ("l_suppkey", "nunique"), ("l_extendedprice", "std", "std_price"),
        ("l_extendedprice", "median", "median_price"), ("l_extendedprice", "first", "first_price"),
    ], order_by=["l_shipdate", "l_orderkey", "l_linenumber"])
    return rounded(out, 4)


@query("a2_aggregate_global", "SELECT round(sum(o_totalprice), 2) AS x, max(o_orderkey) AS y, round(median(o_totalprice), 4) AS m FROM orders")
def _(t):
    out = R.aggregate(t.orders, [], [("o_totalprice", "sum", "x"), ("o_orderkey", "max", "y"), ("o_totalprice", "median", "m")])
    return out.select(F.round("x", 2).alias("x"), "y", F.round("m", 4).alias("m"))


@query("w11_drop_duplicates_first", """SELECT * FROM lineitem QUALIFY row_number() OVER
  (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1""")
def _(t):
    return R.drop_rows_duplicates(t.lineitem, ["l_partkey", "l_returnflag"], "first", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("w11_drop_duplicates_none", "SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey, l_suppkey) = 1")
def _(t):
    return R.drop_rows_duplicates(t.lineitem, ["l_partkey", "l_suppkey"], "none")


@query("w11_remove_duplicate_rows", "SELECT DISTINCT text, lang, source, n_chars FROM documents")
def _(t):
    return R.remove_duplicate_rows(t.documents.drop("doc_id"))


@query("w12_latest_row", """SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(t):
    return R.qualify(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("w12_third_row", """SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 3""")
def _(t):
    return R.qualify(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], asc=True, target=3)


# ---- sorts, top-k, sets ----------------------------------------------------------------


@query("t1_sort", "SELECT event_id, value FROM " + GAPPY + " ORDER BY value DESC NULLS LAST, event_id DESC")
def _(t):
    return R.sort(gappy_events(t).select("event_id", "value"), ["value", "event_id"], ascending=False)


@query("t2_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 100")
def _(t):
    return R.top_k(t.customer.select("c_custkey", "c_acctbal"), ["c_custkey"], 100)


@query("t3_top_k", """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_suppkey LIMIT 10""")
def _(t):
    totals = R.aggregate(t.lineitem, ["l_suppkey"], [("l_extendedprice", "sum", "revenue")])
    return R.top_k(totals.withColumn("revenue", F.round("revenue", 2)), ["-revenue", "l_suppkey"], 10)


@query("t4_best_run", """SELECT counterparty_id, round(mae, 4) AS mae FROM (SELECT counterparty_id, avg(abs(total_amount - forecast)) AS mae
  FROM """ + FLOWS + """ GROUP BY 1) ORDER BY mae, counterparty_id LIMIT 1""")
def _(t):
    errors = flows(t).groupBy("counterparty_id").agg(F.avg(F.abs(F.col("total_amount") - F.col("forecast"))).alias("mae"))
    return rounded(R.best_by(errors, "mae", False, id_column="counterparty_id"), 4)


@query("u1_union_by_name", """SELECT o_orderkey AS id, o_totalprice AS amount, NULL::DOUBLE AS tax FROM orders
  UNION ALL SELECT l_orderkey, l_extendedprice, l_tax FROM lineitem""")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"), F.col("l_tax").alias("tax"))
    return R.union_all(a, b)


@query("u2_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return R.distinct_rows(t.lineitem, ["l_suppkey", "l_returnflag"])


@query("u3_new_categories", """SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' EXCEPT SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 08:00:00'""")
def _(t):
    return R.new_values(t.events.where("ts < timestamp_ntz'2024-01-01 08:00:00'"), t.events.where("ts >= timestamp_ntz'2024-01-16'"), "user_id")


# ---- scalar functions ------------------------------------------------------------------


@query("x1_trunc_date", """SELECT event_id, strftime(ts, '%Y-01-01') AS y, strftime(ts, '%Y-%m-01') AS m, strftime(ts, '%Y-%m-%d') AS d,
  strftime(ts, '%Y-%m-%d %H:00:00') AS h, strftime(ts, '%Y-%m-%d %H:%M:00') AS mi, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events""")
def _(t):
    out = t.events.select("event_id", "ts")
    for unit, name in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"), ("minute", "mi"), ("second", "s")):
        out = X.trunc_date(out, "ts", unit, name)
    return out.drop("ts")


@query("x2_period_start", """SELECT o_orderkey, date_trunc('day', o_orderdate) AS daily, date_trunc('week', o_orderdate) AS weekly,
  date_trunc('month', o_orderdate) AS monthly, date_trunc('quarter', o_orderdate) AS quarterly, date_trunc('year', o_orderdate) AS yearly FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", *[X.period_start(F.col("o_orderdate"), p).alias(p) for p in X.PERIOD_UNITS])


@query("x3_cyclical", """SELECT o_orderkey, round(sin(2 * pi() * week(o_orderdate) / 52), 6) + 0.0 AS o_orderdate_week_sin,
  round(cos(2 * pi() * week(o_orderdate) / 52), 6) + 0.0 AS o_orderdate_week_cos,
  round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS o_orderdate_month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS o_orderdate_month_cos,
  round(sin(2 * pi() * quarter(o_orderdate) / 4), 6) + 0.0 AS o_orderdate_quarter_sin, round(cos(2 * pi() * quarter(o_orderdate) / 4), 6) + 0.0 AS o_orderdate_quarter_cos
  FROM orders""")
def _(t):
    out = t.orders.select("o_orderkey", "o_orderdate")
    for g in X.CYCLES:
        out = X.cyclical_time(out, "o_orderdate", g)
    return rounded(out.drop("o_orderdate"))


@query("x5_maths", """SELECT event_id, round(v * v, 4) AS v_square, round(v * v * v, 3) AS v_cube, round(CASE WHEN v >= 0 THEN sqrt(v) END, 6) AS v_sqrt,
  round(CASE WHEN v > 0 THEN ln(v) END, 6) AS v_log, round(CASE WHEN v <> 0 THEN 1 / v END, 6) AS v_inverse,
  round(CASE WHEN v > 0 THEN 1 / sqrt(v) END, 6) AS v_inverse_sqrt, round(CASE WHEN v <> 0 THEN 1 / (v * v) END, 6) AS v_inverse_square
  FROM (SELECT event_id, floor(value) - 10 AS v FROM events)""")
def _(t):
    out = t.events.select("event_id", (F.floor("value") - 10).cast("double").alias("v"))
    for fn in ("square", "cube", "sqrt", "log", "inverse", "inverse_sqrt", "inverse_square"):
        out = X.maths_transform(out, ["v"], fn)
    return rounded(out.drop("v"))


@query("x6_flatten_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def _(t):
    return X.flatten_json(t.events.select("event_id", "props"), "props")


@query("x7_parse_list", """SELECT l_orderkey, list_sort(list(l_returnflag || l_linenumber)) AS items FROM lineitem GROUP BY 1""")
def _(t):
    tagged = t.lineitem.select("l_orderkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("i"))
    text = tagged.groupBy("l_orderkey").agg(F.concat_ws(", ", F.sort_array(F.collect_list("i"))).alias("text"))
    literal = F.concat(F.lit("['"), F.regexp_replace("text", ", ", "', '"), F.lit("']"))
    mixed = F.when(F.col("l_orderkey") % 2 == 0, literal).otherwise(F.col("text"))
    return text.select("l_orderkey", X.parse_list(mixed).alias("items"))


@query("x8_strings", """SELECT p_partkey, lower(p_type) AS low, split_part(p_brand, '#', 2) AS brand_no, regexp_matches(p_name, '[aeiou]{2}') AS has_pair,
  concat_ws(' - ', p_brand, p_type) AS label FROM part""")
def _(t):
    return t.part.select(
        "p_partkey", F.lower("p_type").alias("low"), F.coalesce(X.split_part(F.col("p_brand"), "#", 1), F.lit("")).alias("brand_no"),
        F.col("p_name").rlike("[aeiou]{2}").alias("has_pair"), F.concat_ws(" - ", "p_brand", "p_type").alias("label"),
    )


@query("x9_row_json", """SELECT s_suppkey, to_json({'s_suppkey': s_suppkey, 's_name': s_name})::VARCHAR AS dim_uid FROM supplier""")
def _(t):
    return t.supplier.select("s_suppkey", X.row_json(["s_suppkey", "s_name"]).alias("dim_uid"))


@query("x10_clip_zero", "SELECT c_custkey, greatest(c_acctbal, 0.0) AS balance FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.clip_zero(F.col("c_acctbal")).alias("balance"))


@query("x11_fill_zero", f"SELECT event_id, coalesce(value, 0) AS value FROM {GAPPY}")
def _(t):
    return X.fill_zero(gappy_events(t).select("event_id", "value"), ["value"])


@query("x12_label_bands", """SELECT event_id, CASE WHEN abs(v) < 0.2 THEN 'negligible' WHEN abs(v) < 0.5 THEN 'small' WHEN abs(v) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
  CASE WHEN v >= 0.9 THEN 'Excellent' WHEN v >= 0.75 THEN 'Good' WHEN v >= 0.6 THEN 'Fair' ELSE 'Poor' END AS grade,
  CASE WHEN v >= 0.9 THEN 'Excellent' WHEN v >= 0.8 THEN 'Good' WHEN v >= 0.7 THEN 'Fair' WHEN v >= 0.6 THEN 'Poor' ELSE 'Very Poor (worse than random)' END AS auc
  FROM (SELECT event_id, value / 100 AS v FROM events)""")
def _(t):
    v = F.col("value") / 100
    return t.events.select("event_id", X.cohens_d_label(v).alias("effect"), X.quality_grade(v).alias("grade"), X.auc_label(v).alias("auc"))
