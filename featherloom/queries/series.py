"""Series preparation, calendars, windows and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.functions import scalars as X
from featherloom.operators import timeseries as S
from featherloom.operators import windows as W
from featherloom.queries import query
from featherloom.queries.shared import DAILY, FLOWS, HOLIDAYS, HOLIDAYS_SQL, flows, gappy_value, rounded

DENSE = f"""(WITH d AS {DAILY}, f AS (SELECT event_type, min(date) AS lo FROM d GROUP BY 1),
  g AS (SELECT event_type, unnest(generate_series(lo, (SELECT max(date) FROM d), INTERVAL 1 DAY)) AS date FROM f)
  SELECT g.event_type, g.date, d.value FROM g LEFT JOIN d USING (event_type, date))"""

BY_USER = """(WITH d AS (SELECT date_trunc('day', ts) AS date, user_id, sum(value) AS value FROM events GROUP BY 1, 2),
  f AS (SELECT user_id, min(date) AS lo FROM d GROUP BY 1),
  g AS (SELECT user_id, unnest(generate_series(lo, (SELECT max(date) FROM d), INTERVAL 1 DAY)) AS date FROM f)
  SELECT g.user_id, g.date, coalesce(d.value, 0) AS value FROM g LEFT JOIN d USING (user_id, date))"""


def daily(t):
    return S.prepare_timeseries(t.events, "ts", ["event_type"], "value", "sum", "value", "daily").withColumnRenamed("ts", "date")


def dense(t):
    return S.add_missing_dates(daily(t), "date", ["event_type"]).drop("dim_uid")


def by_user(t):
    series = S.prepare_timeseries(t.events, "ts", ["user_id"], "value").withColumnRenamed("ts", "date").drop("dim_uid")
    return X.fill_zero(S.add_missing_dates(series, "date", ["user_id"]), ["value"])


@query("flagship_daily_features", f"""SELECT event_type, date, round(coalesce(value, 0), 4) AS value,
  round(coalesce(lag(coalesce(value, 0), 1) OVER w, 0), 4) AS value_lag_1, round(coalesce(lag(coalesce(value, 0), 7) OVER w, 0), 4) AS value_lag_7,
  round(CASE WHEN row_number() OVER w > 7 THEN avg(coalesce(value, 0)) OVER (PARTITION BY event_type ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
    ELSE 0 END, 4) AS rolling_mean_value_7_week
  FROM {DENSE} WINDOW w AS (PARTITION BY event_type ORDER BY date)""")
def _(t):
    series = X.fill_zero(dense(t), ["value"])
    bound = S.calendar_bound(t.events, "ts")
    series = W.lag(series, {"value": [1, 7]}, ["date"], ["event_type"], known_bound=bound)
    return rounded(W.rolling_features(series, "value", ["event_type"], ["date"], [7], ["mean"], "week", known_bound=bound), 4)


@query("a3_prepare_daily", """SELECT date_trunc('day', ts) AS ts, event_type, user_id, round(sum(value), 4) AS total,
  to_json({'event_type': event_type, 'user_id': user_id})::VARCHAR AS dim_uid FROM events GROUP BY ALL""")
def _(t):
    return rounded(S.prepare_timeseries(t.events, "ts", ["event_type", "user_id"], "value", "sum", "total", "daily"), 4)


@query("a3_prepare_monthly_mean", """SELECT date_trunc('month', o_orderdate) AS o_orderdate, o_orderpriority, round(avg(o_totalprice), 4) AS mean_price,
  to_json({'o_orderpriority': o_orderpriority})::VARCHAR AS dim_uid FROM orders GROUP BY ALL""")
def _(t):
    return rounded(S.prepare_timeseries(t.orders, "o_orderdate", ["o_orderpriority"], "o_totalprice", "mean", "mean_price", "monthly"), 4)


@query("a3_prepare_weekly_flows", f"""SELECT date_trunc('week', date) AS date, counterparty_id, direction, round(sum(total_amount), 2) AS total_amount,
  to_json({{'counterparty_id': counterparty_id, 'direction': direction}})::VARCHAR AS dim_uid FROM {FLOWS} GROUP BY ALL""")
def _(t):
    return rounded(S.prepare_timeseries(flows(t), "date", ["counterparty_id", "direction"], "total_amount", periodicity="weekly"), 2)


@query("j5_add_missing_dates", f"SELECT event_type, date, round(value, 4) AS value FROM {DENSE}")
def _(t):
    return rounded(dense(t), 4)


@query("j5_add_missing_months", """WITH d AS (SELECT date_trunc('month', o_orderdate) AS o_orderdate, o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  g AS (SELECT o_custkey, unnest(generate_series(min(o_orderdate), (SELECT max(o_orderdate) FROM d), INTERVAL 1 MONTH)) AS o_orderdate FROM d GROUP BY 1)
  SELECT o_custkey, o_orderdate, round(v, 2) AS v FROM g LEFT JOIN d USING (o_custkey, o_orderdate)""")
def _(t):
    series = S.prepare_timeseries(t.orders, "o_orderdate", ["o_custkey"], "o_totalprice", "sum", "v", "monthly").drop("dim_uid")
    return rounded(S.add_missing_dates(series, "o_orderdate", ["o_custkey"], "monthly"), 2)


@query("j6_add_inference_dates", f"""SELECT date, event_type, round(value, 4) AS value FROM {DAILY} UNION ALL
  SELECT unnest(generate_series((SELECT max(date_trunc('day', ts)) FROM events) + INTERVAL 1 DAY, TIMESTAMP '2024-02-10', INTERVAL 1 DAY)), event_type, 0
  FROM (SELECT DISTINCT event_type FROM events)""")
def _(t):
    return rounded(S.add_inference_dates(daily(t).drop("dim_uid"), "2024-02-10", "date", ["event_type"], "value"), 4)


# ---- calendar --------------------------------------------------------------------------

CALENDAR = f"""(WITH s AS (SELECT unnest(generate_series(date_trunc('day', min(o_orderdate)), date_trunc('day', max(o_orderdate)), INTERVAL 1 DAY)) AS date FROM orders),
  b AS (SELECT date, year(date) AS year, month(date) AS month, quarter(date) AS quarter, isodow(date) >= 6 AS is_weekend,
    strftime(date, '%Y-%m-%d') IN {HOLIDAYS_SQL} AS is_holiday FROM s),
  c AS (SELECT *, NOT is_weekend AND NOT is_holiday AS is_workday FROM b),
  n AS (SELECT *, CASE WHEN is_workday THEN count(*) FILTER (is_workday) OVER (PARTITION BY year, month ORDER BY date) END AS workday_of_month,
    CASE WHEN is_workday THEN count(*) FILTER (is_workday) OVER (PARTITION BY year, month ORDER BY date DESC) END AS workday_of_month_reverse,
    CASE WHEN is_workday THEN count(*) FILTER (is_workday) OVER (PARTITION BY year, quarter ORDER BY date) END AS workday_of_quarter,
    CASE WHEN is_workday THEN count(*) FILTER (is_workday) OVER (PARTITION BY year, quarter ORDER BY date DESC) END AS workday_of_quarter_reverse FROM c)
  SELECT *, coalesce(workday_of_month = 1, FALSE) AS is_first_workday_of_month, coalesce(workday_of_month_reverse = 1, FALSE) AS is_last_workday_of_month,
    coalesce(workday_of_quarter = 1, FALSE) AS is_first_workday_of_quarter, coalesce(workday_of_quarter_reverse = 1, FALSE) AS is_last_workday_of_quarter,
    coalesce(workday_of_month_reverse - workday_of_month IN (0, 1), FALSE) AS is_mid_month FROM n)"""

_CAL_COLUMNS = ["year", "month", "quarter", "is_weekend", "is_holiday", "is_workday", "workday_of_month", "workday_of_month_reverse",
                "workday_of_quarter", "workday_of_quarter_reverse", "is_first_workday_of_month", "is_last_workday_of_month",
                "is_first_workday_of_quarter", "is_last_workday_of_quarter", "is_mid_month"]


@query("j3_calendar_enrichment", f"""SELECT o_orderkey, {', '.join('c.' + c for c in _CAL_COLUMNS)}
  FROM orders LEFT JOIN {CALENDAR} c ON date_trunc('day', o_orderdate) = c.date""")
def _(t):
    calendar = S.build_calendar(t.orders, "o_orderdate", HOLIDAYS, distances=False)
    return S.join_calendar(t.orders.select("o_orderkey", "o_orderdate"), calendar, "o_orderdate").select("o_orderkey", *_CAL_COLUMNS)


@query("j3_calendar_waves", """SELECT o_orderkey, week(o_orderdate) AS week, isodow(o_orderdate) - 1 AS day_of_week, day(o_orderdate) AS day_of_month, dayofyear(o_orderdate) AS day_of_year,
  round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS sin_month, round(cos(2 * pi() * week(o_orderdate) / 52), 6) + 0.0 AS cos_week,
  round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS sin_day_of_week, round(cos(2 * pi() * day(o_orderdate) / 31), 6) + 0.0 AS cos_day_of_month,
  round(sin(2 * pi() * dayofyear(o_orderdate) / 365), 6) + 0.0 AS sin_day_of_year FROM orders""")
def _(t):
    calendar = S.build_calendar(t.orders, "o_orderdate", HOLIDAYS, distances=False)
    out = S.join_calendar(t.orders.select("o_orderkey", "o_orderdate"), calendar, "o_orderdate")
    return rounded(out.select("o_orderkey", "week", "day_of_week", "day_of_month", "day_of_year", "sin_month", "cos_week",
                              "sin_day_of_week", "cos_day_of_month", "sin_day_of_year"))


@query("w8_flag_distances", f"""WITH c AS {CALENDAR}, o AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS date FROM orders),
  r AS (SELECT c.date, is_holiday, is_last_workday_of_month AS eom, row_number() OVER (ORDER BY c.date) AS rn, count(*) OVER () AS n FROM c JOIN o ON c.date = o.date),
  d AS (SELECT date, rn - coalesce(max(CASE WHEN is_holiday THEN rn END) OVER (ORDER BY rn), 1) AS ph, coalesce(min(CASE WHEN is_holiday THEN rn END) OVER (ORDER BY rn DESC), n) - rn AS nh,
    rn - coalesce(max(CASE WHEN eom THEN rn END) OVER (ORDER BY rn), 1) AS pe, coalesce(min(CASE WHEN eom THEN rn END) OVER (ORDER BY rn DESC), n) - rn AS ne FROM r)
  SELECT o_orderkey, ph AS distance_since_previous_is_holiday, nh AS distance_until_next_is_holiday,
    pe AS distance_since_previous_is_last_workday_of_month, ne AS distance_until_next_is_last_workday_of_month
  FROM orders JOIN d ON date_trunc('day', o_orderdate) = d.date""")
def _(t):
    calendar = S.build_calendar(t.orders, "o_orderdate", HOLIDAYS, distances=False)
    base = t.orders.select("o_orderkey", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("date"))
    flagged = S.join_calendar(base, calendar, "date")
    out = W.flag_distances(flagged, ["is_holiday", "is_last_workday_of_month"], "date")
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("distance_")])


@query("x4_basic_calendar", f"""SELECT o_orderkey, month(d) AS month, year(d) AS year, week(d) AS week, isodow(d) - 1 AS day_of_week, day(d) AS day_of_month,
  dayofyear(d) AS day_of_year, isodow(d) < 6 AS workday_of_month, isodow(d) >= 6 AS is_weekend, strftime(d, '%Y-%m-%d') IN {HOLIDAYS_SQL} AS is_holiday,
  day(d) = 1 AS is_first_day_of_month, d::DATE = last_day(d) AS is_last_day_of_month, day(d) > 15 AS is_mid_month,
  month(d) % 3 = 1 AS is_quarter_start, month(d) % 3 = 0 AS is_quarter_end,
  round(sin(2 * pi() * month(d) / 12), 6) + 0.0 AS sin_month, round(cos(2 * pi() * month(d) / 12), 6) + 0.0 AS cos_month,
  round(sin(2 * pi() * week(d) / 52), 6) + 0.0 AS sin_week, round(cos(2 * pi() * week(d) / 52), 6) + 0.0 AS cos_week,
  round(sin(2 * pi() * (isodow(d) - 1) / 7), 6) + 0.0 AS sin_day_of_week, round(cos(2 * pi() * (isodow(d) - 1) / 7), 6) + 0.0 AS cos_day_of_week
  FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""")
def _(t):
    return rounded(X.basic_calendar(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", HOLIDAYS).drop("o_orderdate"))


@query("f9_custom_filter", f"""SELECT l_orderkey, l_linenumber, total_amount FROM {FLOWS} f JOIN {CALENDAR} c ON date_trunc('day', f.date) = c.date
  JOIN supplier ON s_suppkey = counterparty_id
  WHERE workday_of_month IN (1, 2, 3, 10) AND workday_of_month_reverse NOT IN (1) AND NOT c.is_holiday AND NOT c.is_weekend
    AND lower(s_name) NOT IN ('supplier#000000001', 'supplier#2') AND total_amount <> 0""")
def _(t):
    calendar = S.build_calendar(t.orders, "o_orderdate", HOLIDAYS, distances=False)
    named = flows(t).join(t.supplier.select(F.col("s_suppkey").alias("counterparty_id"), F.col("s_name").alias("custom_counterparty_name")), "counterparty_id")
    kept = S.custom_filter(
        S.join_calendar(named, calendar, "date"), workdays_to_include=[1, 2, 3, 10], workdays_reverse_to_exclude=[1],
        exclude_holidays=True, exclude_weekends=True, counterparties_to_remove=["Supplier#000000001", "Supplier#2"], remove_zero_amount=True,
    )
    return kept.select("l_orderkey", "l_linenumber", "total_amount")


@query("j4_segment_filter", f"""WITH s AS (SELECT DISTINCT counterparty_id, direction, date_trunc('month', date) AS m,
    CASE counterparty_id % 4 WHEN 0 THEN 'continuous_stable' WHEN 1 THEN 'rare_recent' WHEN 2 THEN 'stopped' ELSE 'other' END AS segment
    FROM {FLOWS} WHERE month(date) <= 6)
  SELECT l_orderkey, l_linenumber, s.segment FROM {FLOWS} f JOIN s ON f.counterparty_id = s.counterparty_id AND f.direction = s.direction
    AND date_trunc('month', f.date) = s.m WHERE s.segment IN ('continuous_stable', 'rare_recent')""")
def _(t):
    base = flows(t)
    label = F.element_at(F.array(*[F.lit(x) for x in ("continuous_stable", "rare_recent", "stopped", "other")]), (F.col("counterparty_id") % 4 + 1).cast("int"))
    segments = base.where(F.month("date") <= 6).select(
        F.concat_ws("::", F.col("counterparty_id").cast("string"), "direction").alias("dim_value"), "date", label.alias("segment")
    )
    return S.segment_filter(base, segments, ["continuous_stable", "rare_recent"]).select("l_orderkey", "l_linenumber", "segment")


@query("f10_remove_early_zeros", f"""WITH z AS (SELECT user_id, date, CASE WHEN value < 60 THEN 0 ELSE value END AS value FROM {BY_USER})
  SELECT user_id, date, round(value, 4) AS value FROM z WHERE date >= (SELECT min(date) FROM z y WHERE y.user_id = z.user_id AND y.value <> 0)""")
def _(t):
    series = by_user(t).withColumn("value", F.when(F.col("value") < 60, 0.0).otherwise(F.col("value")))
    return rounded(W.remove_early_zeros(series, "date", ["user_id"], "value"), 4)


# ---- windows ---------------------------------------------------------------------------

_LINES = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber"
_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]


@query("w1_lag", f"""SELECT l_orderkey, l_linenumber, coalesce(lag(l_quantity, 1) OVER w, 0) AS l_quantity_lag_1_s, coalesce(lag(l_quantity, 3) OVER w, 0) AS l_quantity_lag_3_s,
  coalesce(lag(l_partkey, 2) OVER w, 0) AS l_partkey_lag_2_s FROM lineitem WINDOW w AS ({_LINES})""")
def _(t):
    out = W.lag(t.lineitem.select("l_suppkey", *_ORDER, "l_quantity", "l_partkey"), {"l_quantity": [1, 3], "l_partkey": [2]}, _ORDER, ["l_suppkey"], suffix="s")
    return out.select("l_orderkey", "l_linenumber", "l_quantity_lag_1_s", "l_quantity_lag_3_s", "l_partkey_lag_2_s")


def _rolling_sql():
    fns = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp", "var": "var_samp", "count": "count"}
    cols = [f"round(CASE WHEN count(v) OVER r = 5 THEN {sql}(v) OVER r ELSE 0 END::DOUBLE, 6) AS rolling_{name}_v_5_x" for name, sql in fns.items()]
    return f"""SELECT event_id, {', '.join(cols)} FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
      WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


@query("w2_rolling", _rolling_sql())
def _(t):
    base = t.events.select("event_id", "user_id", "ts", gappy_value().alias("v"))
    out = W.rolling_features(base, "v", ["user_id"], ["ts", "event_id"], [5], ["mean", "sum", "min", "max", "std", "var", "count"], "x")
    return rounded(out.drop("user_id", "ts", "v"), 6)


@query("w2_rolling_first_last", """SELECT event_id, CASE WHEN count(value) OVER r = 3 THEN first_value(value) OVER r END AS rolling_first_value_3_x,
  CASE WHEN count(value) OVER r = 3 THEN last_value(value) OVER r END AS rolling_last_value_3_x
  FROM events WINDOW r AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def _(t):
    base = t.events.select("event_id", "event_type", "ts", "value")
    out = W.rolling_features(base, "value", ["event_type"], ["ts", "event_id"], [3], ["first", "last"], "x", fillna=False)
    return out.drop("event_type", "ts", "value")


@query("w3_cumulative_month", f"""SELECT l_orderkey, l_linenumber, round(coalesce(sum(l_extendedprice) OVER (PARTITION BY l_suppkey, year(l_shipdate), month(l_shipdate)
  ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS cumulative_monthly_sum_l_extendedprice FROM lineitem""")
def _(t):
    base = t.lineitem.withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})
    out = W.cumulative_monthly_sum(base, "l_extendedprice", ["l_suppkey"], _ORDER)
    return rounded(out.select("l_orderkey", "l_linenumber", "cumulative_monthly_sum_l_extendedprice"), 2)


@query("w4_previous_months", """WITH m AS (SELECT l_suppkey, year(l_shipdate) AS y, month(l_shipdate) AS mo, sum(l_quantity) AS s, avg(l_quantity) AS a FROM lineitem GROUP BY ALL),
  p AS (SELECT l_suppkey, y, mo, CASE WHEN count(*) OVER r = 2 THEN avg(s) OVER r ELSE 0 END AS ps, CASE WHEN count(*) OVER r = 2 THEN avg(a) OVER r ELSE 0 END AS pa
    FROM m WINDOW r AS (PARTITION BY l_suppkey ORDER BY y, mo ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))
  SELECT l_orderkey, l_linenumber, round(ps, 6) AS average_previous_2_sum_month_l_quantity, round(pa, 6) AS average_previous_2_mean_month_l_quantity
  FROM lineitem l JOIN p ON l.l_suppkey = p.l_suppkey AND year(l_shipdate) = y AND month(l_shipdate) = mo""")
def _(t):
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    out = W.previous_month_aggregation(base, "l_quantity", ["l_suppkey"], ["sum", "mean"], [2])
    return rounded(out.drop("l_suppkey", "l_quantity", "year", "month"))


@query("w5_series_age", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS age FROM events")
def _(t):
    from featherloom.operators.ordered import row_numbers

    return row_numbers(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], "age").select("event_id", "age")


@query("w5_daily_series_age", f"SELECT user_id, date, row_number() OVER (PARTITION BY user_id ORDER BY date) AS age FROM {BY_USER}")
def _(t):
    return W.series_age(by_user(t), "date", ["user_id"]).select("user_id", "date", "age")


@query("w6_recency", f"""WITH r AS (SELECT user_id, date, value, row_number() OVER w AS rn, max(CASE WHEN value <> 0 THEN 1 ELSE 0 END) OVER w AS z FROM {BY_USER} WINDOW w AS (PARTITION BY user_id ORDER BY date)),
  h AS (SELECT *, max(CASE WHEN value <> 0 THEN rn END) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM r)
  SELECT user_id, date, CASE WHEN rn = 1 THEN 0 ELSE rn - 1 - coalesce(hit, 1) END AS recency FROM h""")
def _(t):
    return W.recency(by_user(t), "date", ["user_id"], "value").select("user_id", "date", "recency")


@query("w7_frequency", f"""SELECT user_id, date, count(CASE WHEN value <> 0 THEN 1 END) OVER (PARTITION BY user_id ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frequency FROM {BY_USER}""")
def _(t):
    return W.frequency(by_user(t), "date", ["user_id"], "value").select("user_id", "date", "frequency")


@query("w9_fill_forward_backward", """SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)""")
def _(t):
    base = t.events.select("event_id", "user_id", "ts", gappy_value().alias("f"), gappy_value().alias("b"))
    return W.fill_along(base, {"f": "ffill", "b": "bfill"}, ["user_id"], ["ts", "event_id"]).select("event_id", "f", "b")


@query("w10_interpolate", """WITH g AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 < 2 THEN NULL ELSE value END AS v,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  s AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS p, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS pr,
    first_value(v IGNORE NULLS) OVER n AS x, first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER n AS xr FROM g
    WINDOW w AS (PARTITION BY user_id ORDER BY rn), n AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN x IS NULL THEN p ELSE p + (x - p) * (rn - pr) / (xr - pr) END, 6) AS v FROM s""")
def _(t):
    holes = F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 5 >= 2), F.col("value"))
    base = t.events.select("event_id", "user_id", "ts", holes.alias("v"))
    return rounded(W.fill_along(base, {"v": "interpolate"}, ["user_id"], ["ts", "event_id"]).select("event_id", "v"))


@query("w13_pareto", """WITH s AS (SELECT l_suppkey, round(sum(l_extendedprice)) AS flow FROM lineitem GROUP BY 1)
  SELECT l_suppkey, flow, sum(flow) OVER (ORDER BY flow DESC, l_suppkey DESC) AS cum_flow, sum(flow) OVER () AS total,
    row_number() OVER (ORDER BY flow DESC, l_suppkey DESC) AS rank, round(sum(flow) OVER (ORDER BY flow DESC, l_suppkey DESC) / sum(flow) OVER (), 6) AS cum_pct FROM s""")
def _(t):
    flow = t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice")).alias("flow"))
    return rounded(W.pareto(flow, "l_suppkey", "flow").drop("label"))


@query("w14_average_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rank FROM lineitem")
def _(t):
    return W.rank_average(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").drop("l_quantity")


@query("w15_moving_average", f"""SELECT event_type, date, round(CASE WHEN count(value) OVER m = 6 THEN avg(value) OVER m END, 4) AS smoothed FROM {DAILY}
  WINDOW m AS (PARTITION BY event_type ORDER BY date ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
def _(t):
    return rounded(W.moving_average(daily(t), ["event_type"], "date", "value", 6).select("event_type", "date", "smoothed"), 4)


@query("w15_curve_change", f"""SELECT event_type, round(arg_min(value, date), 4) AS first_value, round(arg_max(value, date), 4) AS last_value, round(min(value), 4) AS min_value,
  round(max(value), 4) AS max_value, count(*) AS steps, round(arg_max(value, date) - arg_min(value, date), 4) AS change,
  round((arg_max(value, date) - arg_min(value, date)) / abs(arg_min(value, date)) * 100, 4) AS change_pct FROM {DAILY} GROUP BY 1""")
def _(t):
    return rounded(W.curve_change(daily(t), ["event_type"], "date", "value"), 4)


@query("w16_last_fold", """SELECT l_orderkey, l_linenumber % 2 AS half, max(l_linenumber) AS fold,
  max_by(p, l_linenumber) AS prediction FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2""")
def _(t):
    lines = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("fold")).agg(F.max("l_quantity").alias("prediction"))
    return W.latest_fold(lines.withColumn("half", F.col("fold") % 2), ["l_orderkey", "half"])


@query("w17_percentile_of_value", "SELECT o_orderkey, round(cume_dist() OVER (ORDER BY o_totalprice) * 100, 6) AS percentile FROM orders")
def _(t):
    return rounded(W.percentile_of_value(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice"))


