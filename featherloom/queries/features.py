"""Fitted feature steps, chains, documents, catalogue, user-defined functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.operators import encoders as E
from featherloom.plans.chain import FeatureChain, StepGraph
from featherloom.plans.models import map_predict, model_udf
from featherloom.plans.steps import register
from featherloom.queries import query
from featherloom.queries.shared import GAPPY, gappy_events, rounded
from featherloom.session import new_path
from featherloom.sources import catalog, documents, files

_LINE = ["l_orderkey", "l_linenumber"]


def _scaled(t, method):
    base = t.lineitem.select(*_LINE, "l_quantity", "l_extendedprice")
    return rounded(E.apply_scaling(base, E.fit_scaling(base, ["l_quantity", "l_extendedprice"], method)))


def _scaled_sql(centre, scale):
    def one(c):
        return f"round(({c} - {centre.replace('$', c)}) / {scale.replace('$', c)}, 6) + 0.0 AS {c}"

    return f"SELECT l_orderkey, l_linenumber, {one('l_quantity')}, {one('l_extendedprice')} FROM lineitem"


@query("e1_scale_standard", _scaled_sql("(SELECT avg($) FROM lineitem)", "(SELECT stddev_pop($) FROM lineitem)"))
def _(t):
    return _scaled(t, "standard")


@query("e2_scale_robust", _scaled_sql("(SELECT median($) FROM lineitem)", "(SELECT quantile_cont($, .75) - quantile_cont($, .25) FROM lineitem)"))
def _(t):
    return _scaled(t, "robust")


@query("e3_scale_minmax", _scaled_sql("(SELECT min($) FROM lineitem)", "(SELECT max($) - min($) FROM lineitem)"))
def _(t):
    return _scaled(t, "minmax")


@query("e3_scale_added_columns", "SELECT c_custkey, c_acctbal, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal_scaled FROM customer")
def _(t):
    base = t.customer.select("c_custkey", "c_acctbal")
    return rounded(E.apply_scaling(base, E.fit_scaling(base, ["c_acctbal"], "minmax"), overwrite_columns=False))


@query("e4_box_cox_lambda", """WITH g AS (SELECT i / 100 AS lam FROM range(-100, 101) r(i)), s AS (SELECT count(*) AS n, sum(ln(value)) AS logs FROM events),
  f AS (SELECT lam, (lam - 1) * any_value(logs) - any_value(n) / 2 * ln(var_pop(CASE WHEN lam = 0 THEN ln(value) ELSE (pow(value, lam) - 1) / lam END)) AS fit FROM g, events, s GROUP BY 1)
  SELECT 'value' AS "column", round(arg_max(lam, fit), 2) AS lambda, (SELECT count(*) FROM events) AS n FROM f""")
def _(t):
    state = E.fit_scaling(t.events, ["value"], "box-cox")["value"]
    scaled = E.apply_scaling(t.events, {"value": state})
    return scaled.agg(F.count("value").alias("n")).select(F.lit("value").alias("column"), F.round(F.lit(float(state["lambda"])), 2).alias("lambda"), "n")


def _likelihood_sql(level: int, step: float, before: str) -> str:
    """One level of the search: 21 values of lambda around the best of the level before."""
    power = "CASE WHEN abs(lam) < 1e-12 THEN ln(value) ELSE (exp(ln(value) * lam) - 1) / lam END"
    return f"""l{level} AS (SELECT arg_max(lam, fit) AS lam FROM (SELECT lam, (lam - 1) * any_value(logs) - any_value(n) / 2 * ln(var_pop({power})) AS fit FROM (SELECT b.lam + (i - 10) * {step} AS lam FROM {before} b, range(21) r(i)), events, s GROUP BY 1))"""


# The scaled values of each event type by the lambda of largest likelihood, found in steps ten times finer each.
@query("e4_box_cox_scaled", f"""WITH s AS (SELECT count(*) AS n, sum(ln(value)) AS logs FROM events), l0 AS (SELECT 0::DOUBLE AS lam),
  {', '.join(_likelihood_sql(k, step, f'l{k - 1}') for k, step in ((1, 0.2), (2, 0.02), (3, 0.002), (4, 0.0002), (5, 0.00002)))},
  v AS (SELECT event_type, CASE WHEN abs(lam) < 1e-12 THEN ln(value) ELSE (exp(ln(value) * lam) - 1) / lam END AS x FROM events, l5), m AS (SELECT avg(x) AS a, stddev_pop(x) AS b FROM v)
  SELECT event_type, count(*) AS n, round(avg((x - a) / b), 3) AS mean, round(stddev_samp((x - a) / b), 3) AS std, round(min((x - a) / b), 2) AS lowest FROM v, m GROUP BY 1""")
def _(t):
    scaled = E.apply_scaling(t.events, E.fit_scaling(t.events, ["value"], "box-cox"))
    out = scaled.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("lowest"))
    return out.withColumns({"mean": F.round("mean", 3), "std": F.round("std", 3), "lowest": F.round("lowest", 2)})


ROLES = "(SELECT conv_id, turn, CASE WHEN turn = 3 THEN NULL ELSE role END AS role FROM conversations)"


@query("e5_one_hot", f"""SELECT conv_id, turn, role, (role IS NOT DISTINCT FROM 'assistant')::INT::DOUBLE AS role_assistant, (role IS NOT DISTINCT FROM 'user')::INT::DOUBLE AS role_user,
  (role IS NOT DISTINCT FROM 'system' OR (role IS NULL AND (SELECT count(*) FROM {ROLES} WHERE role IS NULL) < 0.1 * (SELECT count(*) FROM {ROLES})))::INT::DOUBLE AS role_infrequent_sklearn,
  FROM {ROLES}""")
def _(t):
    base = t.conversations.select("conv_id", "turn", F.when(F.col("turn") != 3, F.col("role")).alias("role"))
    out = E.apply_one_hot(base, E.fit_one_hot(base, "role", 0.1))
    return out.drop("role_None")


@query("e6_ordinal", "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS ordinal_encode__o_orderpriority FROM orders")
def _(t):
    base = t.orders.select("o_orderkey", "o_orderpriority")
    return E.apply_ordinal(base, E.fit_ordinal(base, "o_orderpriority"))


@query("e6_ordinal_unknown", """SELECT p_partkey, p_brand, CASE WHEN n > 3 THEN -1 ELSE dense_rank() OVER (PARTITION BY n > 3 ORDER BY p_brand) - 1 END AS ordinal_encode__p_brand
  FROM (SELECT p_partkey, p_brand, length(p_brand) - 6 AS n0, CASE WHEN p_brand LIKE 'Brand#_' THEN 1 ELSE 9 END AS n FROM part)""")
def _(t):
    seen = t.part.where("p_brand LIKE 'Brand#_'")
    return E.apply_ordinal(t.part.select("p_partkey", "p_brand"), E.fit_ordinal(seen, "p_brand"))


WORDS = "(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS item FROM part)"
CODES = f"(SELECT item, (row_number() OVER (ORDER BY count(*) DESC, item))::INT - 1 AS code FROM {WORDS} GROUP BY item)"


@query("e7_codes_long", f"SELECT p_partkey, code, count(*) AS value FROM {WORDS} JOIN {CODES} USING (item) GROUP BY ALL")
def _(t):
    base = t.part.select("p_partkey", F.split("p_name", " ").alias("words"))
    return E.codes_long(base, E.fit_codes(base, "words"), ["p_partkey"])


@query("e5_codes_sparse", """WITH c AS (SELECT user_id, (row_number() OVER (ORDER BY count(*) DESC, user_id::VARCHAR))::INT - 1 AS code FROM events GROUP BY 1)
  SELECT event_id, (SELECT count(*) FROM c)::INT AS size, code AS position, 1.0::DOUBLE AS value FROM events JOIN c USING (user_id)""")
def _(t):
    base = t.events.select("event_id", F.col("user_id").cast("string").alias("user"))
    found = E.codes_sparse(base, E.fit_codes(base, "user"), ["event_id"])
    return found.select("event_id", "size", F.explode(F.arrays_zip(F.col("indices").alias("position"), F.col("values").alias("value"))).alias("p")).select("event_id", "size", "p.*")


@query("e7_flatten_list", """SELECT p_partkey, list_contains(string_split(p_name, ' '), 'ring')::INT AS words_ring, list_contains(string_split(p_name, ' '), 'widget')::INT AS words_widget FROM part""")
def _(t):
    base = t.part.select("p_partkey", F.regexp_replace("p_name", " ", ", ").alias("words"))
    state = E.fit_list_vocabulary(base, "words", 0.0001)
    return E.apply_list_vocabulary(base, state, drop_raw_col=True).select("p_partkey", "words_ring", "words_widget")


@query("e8_fill_group_statistics", f"""WITH v AS (SELECT event_id, event_type, value, floor(value / 10) AS tens, (ts IS NOT NULL) AS k FROM {GAPPY}),
  m AS (SELECT event_type, avg(value) AS a, median(value) AS m, max(value) AS x FROM v GROUP BY 1), c AS (SELECT event_type, tens, count(*) AS n FROM v WHERE tens IS NOT NULL GROUP BY 1, 2),
  o AS (SELECT event_type, arg_min(tens, (-n, tens)) AS tens FROM c GROUP BY 1)
  SELECT event_id, event_type, round(coalesce(value, a), 6) AS mean, round(coalesce(value, m), 6) AS median, coalesce(value, x) AS max, coalesce(v.tens, o.tens) AS mode, coalesce(value, 0) AS zero
  FROM v JOIN m USING (event_type) JOIN o USING (event_type)""")
def _(t):
    v = F.col("value")
    base = gappy_events(t).select("event_id", "event_type", *[v.alias(c) for c in ("mean", "median", "max", "zero")], F.floor(v / 10).cast("double").alias("mode"))
    how = {c: c for c in ("mean", "median", "max", "mode", "zero")}
    return rounded(E.fill_values(base, how, ["event_type"]))


@query("e8_fill_whole_column", f"""SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {GAPPY})), 6) AS mean, round(coalesce(value, (SELECT median(value) FROM {GAPPY})), 6) AS median,
  coalesce(value, (SELECT min(value) FROM {GAPPY})) AS min FROM {GAPPY}""")
def _(t):
    v = F.col("value")
    base = gappy_events(t).select("event_id", *[v.alias(c) for c in ("mean", "median", "min")])
    how = {c: c for c in ("mean", "median", "min")}
    return rounded(E.apply_fill(base, E.fit_fill(base, how), how))


@query("e9_polynomial", """SELECT p_partkey, p_size, p_retailprice, 1.0::DOUBLE AS "1", (p_size * p_size)::DOUBLE AS "p_size^2", round(p_size * p_retailprice, 4) AS "p_size p_retailprice",
  round(p_retailprice * p_retailprice, 4) AS "p_retailprice^2" FROM part""")
def _(t):
    return rounded(E.polynomial_features(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), 4)


@query("e9_interactions", """SELECT p_partkey, p_size, p_retailprice, (p_partkey * p_size)::DOUBLE AS "p_partkey p_size", round(p_partkey * p_retailprice, 4) AS "p_partkey p_retailprice",
  round(p_size * p_retailprice, 4) AS "p_size p_retailprice", round(p_partkey * p_size * p_retailprice, 2) AS "p_partkey p_size p_retailprice" FROM part""")
def _(t):
    out = E.polynomial_features(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_partkey", "p_size", "p_retailprice"], 3, include_bias=False, interaction_only=True)
    cubic = "p_partkey p_size p_retailprice"
    return rounded(out.withColumn(cubic, F.round(F.col(f"`{cubic}`"), 2)), 4)


def _vectors(t, n):
    return t.embeddings.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)])


@query("e10_pca", """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM v),
  l AS (SELECT *, (a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 AS l1 FROM m), w AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS u, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS w FROM l),
  s AS (SELECT mx, my, u * sign(CASE WHEN abs(u) > abs(w) THEN u ELSE w END) AS u, w * sign(CASE WHEN abs(u) > abs(w) THEN u ELSE w END) AS w FROM w)
  SELECT vec_id, round((x - mx) * u + (y - my) * w, 6) + 0.0 AS pca0, round((x - mx) * -w * sign(CASE WHEN abs(w) > abs(u) THEN -w ELSE u END) + (y - my) * u * sign(CASE WHEN abs(w) > abs(u) THEN -w ELSE u END), 6) + 0.0 AS pca1 FROM v, s""")
def _(t):
    base = _vectors(t, 2)
    return rounded(E.apply_pca(base, E.fit_pca(base, ["x0", "x1"], 2)).drop("x0", "x1"))


@query("e10_pca_many_columns")
def _(t):
    base = _vectors(t, 32)
    state = E.fit_pca(base, [f"x{i}" for i in range(32)], 3)
    out = E.apply_pca(base, state)
    return out.agg(*[F.round(F.var_samp(f"pca{i}"), 6).alias(f"variance{i}") for i in range(3)], F.round(F.corr("pca0", "pca1"), 6).alias("correlation"))


@query("e11_agglomeration", """WITH v AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, l_quantity AS c FROM lineitem)
  SELECT l_orderkey, l_linenumber, round((a + b) / 2, 6) AS featureagglomeration0, c AS featureagglomeration1 FROM v
  WHERE (SELECT sum(pow(a - b, 2)) FROM v) < (SELECT least(sum(pow(a - c, 2)), sum(pow(b - c, 2))) FROM v)""")
def _(t):
    columns = ["l_discount", "l_tax", "l_quantity"]
    base = t.lineitem.select(*_LINE, *columns)
    return rounded(E.apply_agglomeration(base, E.fit_agglomeration(base, columns, 2)).drop(*columns))


# ---- chains ----------------------------------------------------------------------------

STEPS = [
    {"name": "DropRowsNA", "parameters": {"columns": ["value"], "how": "any"}},
    {"name": "FilterRows", "parameters": {"column": "value", "operator": ">", "value": 5}},
    {"name": "MathsTransform", "parameters": {"columns": ["value"], "transform": "log"}},
    {"name": "ScalingNumerical", "parameters": {"columns": ["value"], "method": "minmax", "overwrite_columns": False}},
    {"name": "SelectCols", "parameters": {"columns": ["event_id", "value_log", "value_scaled"]}},
]


@query("e12_chain_fit_replay", f"""WITH f AS (SELECT min(value) AS lo, max(value) AS hi FROM {GAPPY} WHERE ts < TIMESTAMP '2024-01-16' AND value > 5)
  SELECT event_id, round(ln(value), 6) AS value_log, round((value - lo) / (hi - lo), 6) AS value_scaled FROM {GAPPY}, f WHERE value > 5""")
def _(t):
    rows = gappy_events(t)
    chain = FeatureChain(STEPS).fit(rows.where("ts < timestamp_ntz'2024-01-16'"))
    path = new_path(t.spark, "chain")
    chain.save(t.spark, path)
    return rounded(FeatureChain.load(t.spark, path).transform(rows))


@query("e13_step_graph", """SELECT o_orderkey, o_totalprice, s AS sum_l_quantity, round(sqrt(s), 6) AS sum_l_quantity_sqrt FROM orders JOIN
  (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem WHERE l_quantity > 5 GROUP BY 1) ON o_orderkey = l_orderkey""")
def _(t):
    graph = StepGraph([
        {"name": "big", "transformation": {"name": "FilterRows", "parameters": {"column": "l_quantity", "operator": ">", "value": 5}}},
        {"name": "sums", "transformation": {"name": "Aggregation", "parameters": {"dimensions": ["l_orderkey"], "aggregations": [["l_quantity", "sum"]]}}, "inputs": {"df": "big__output"}},
        {"name": "joined", "transformation": {"name": "Merge", "parameters": {"left_on": ["o_orderkey"], "right_on": ["l_orderkey"], "how": "inner"}}, "inputs": {"left": "orders", "right": "sums__output"}},
        {"name": "root", "transformation": {"name": "MathsTransform", "parameters": {"columns": ["sum_l_quantity"], "transform": "sqrt"}}, "inputs": {"df": "joined__output"}},
        {"name": "out", "transformation": {"name": "SelectCols", "parameters": {"columns": ["o_orderkey", "o_totalprice", "sum_l_quantity", "sum_l_quantity_sqrt"]}}, "inputs": {"df": "root__output"}},
    ])
    return rounded(graph.fit_transform(big__df=t.lineitem, orders=t.orders))


@query("e13_step_graph_prefix_spilled", "SELECT l_orderkey, sum(l_quantity) AS sum_l_quantity FROM lineitem WHERE l_quantity > 5 GROUP BY 1")
def _(t):
    graph = StepGraph([
        {"name": "big", "transformation": {"name": "FilterRows", "parameters": {"column": "l_quantity", "operator": ">", "value": 5}}},
        {"name": "sums", "transformation": {"name": "Aggregation", "parameters": {"dimensions": ["l_orderkey"], "aggregations": [["l_quantity", "sum"]]}}, "inputs": {"df": "big__output"}},
        {"name": "sorted", "transformation": {"name": "Sort", "parameters": {"columns": ["l_orderkey"]}}, "inputs": {"df": "sums__output"}},
    ])
    return graph.fit_transform(first_steps=2, spill=True, big__df=t.lineitem)


# ---- documents and catalogue -----------------------------------------------------------


def _docs(t):
    fields = F.to_json(F.struct("lang", "source", F.array("lang", "source").alias("tags"), F.col("n_chars").alias("size"), F.col("text").alias("content")))
    return t.documents.select("doc_id", fields.alias("data"))


@query("f16_document_predicate", """SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') AND (regexp_matches(text, '(?i)QUE') OR source = 'src3' OR lang = 'src5')""")
def _(t):
    found = documents.find_documents(_docs(t), {"lang": {"$in": ["fr", "de"]}, "$or": [{"content": {"$regex": "QUE"}}, {"tags": "src3"}, {"tags": "src5", "lang": "src5"}]})
    return found.select("doc_id")


@query("f16_document_equality", "SELECT doc_id FROM documents WHERE source = 'src8' AND lang = 'en'")
def _(t):
    return documents.find_documents(_docs(t), {"tags": "src8", "lang": "en"}).select("doc_id")


NOTES = "(SELECT doc_id, source AS title, text AS content, [lang] AS tags, TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS updated_at FROM documents)"


def _notes(t):
    at = F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return t.documents.select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), F.array("lang").alias("tags"), at.alias("updated_at"))


@query("f17_document_search", f"""SELECT doc_id, updated_at FROM {NOTES} WHERE regexp_matches(title, '(?i)SRC3') OR regexp_matches(content, '(?i)SRC3') OR list_contains(tags, 'SRC3') ORDER BY updated_at DESC LIMIT 10""")
def _(t):
    return documents.search_documents(_notes(t), "SRC3", limit=10).select("doc_id", "updated_at")


@query("f17_documents_with_tag", f"SELECT doc_id, updated_at FROM {NOTES} WHERE list_contains(tags, 'es')")
def _(t):
    return documents.documents_with_tag(_notes(t), "es").select("doc_id", "updated_at")


CATALOGUE = """(SELECT o_orderkey AS entity_id, o_orderpriority || ' features' AS name, o_orderstatus = 'F' AS is_transformed, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS source_dataset_id,
  o_orderpriority AS pipeline_name, o_orderdate AS created_at FROM orders)"""


def _catalogue(t):
    from featherloom.operators.ordered import framed

    chained = framed(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], lambda w: {"source_dataset_id": F.lag("o_orderkey", 1).over(w)}, back=1)
    return chained.select(
        F.col("o_orderkey").alias("entity_id"), F.concat("o_orderpriority", F.lit(" features")).alias("name"), (F.col("o_orderstatus") == "F").alias("is_transformed"), "source_dataset_id",
        F.col("o_orderpriority").alias("pipeline_name"), F.col("o_orderdate").alias("created_at"),
    )


@query("s9_list_transformed", f"""SELECT entity_id, source_dataset_id, created_at FROM {CATALOGUE} WHERE is_transformed AND pipeline_name = '2-HIGH' ORDER BY created_at DESC, entity_id DESC LIMIT 50""")
def _(t):
    return catalog.list_transformed(_catalogue(t), pipeline_name="2-HIGH", limit=50).select("entity_id", "source_dataset_id", "created_at")


@query("s10_load_newest_transformed", "SELECT * FROM supplier")
def _(t):
    store = files.DatasetStore(t.spark)
    paths = {"nation": store.save(t.nation, "nation"), "supplier": store.save(t.supplier, "supplier")}
    path = F.create_map(*[x for k, v in paths.items() for x in (F.lit(k), F.lit(v))])
    rows = _catalogue(t).withColumn("path", F.when(F.col("pipeline_name") == "1-URGENT", path["supplier"]).otherwise(path["nation"]))
    return catalog.load_transformed(rows, "URGENT feat")


@query("b30_lineage", f"""WITH RECURSIVE c AS (SELECT entity_id, source_dataset_id FROM {CATALOGUE}), r AS (SELECT entity_id, entity_id AS ancestor_id, 0::BIGINT AS distance, source_dataset_id AS nxt FROM c
  UNION ALL SELECT r.entity_id, c.entity_id, r.distance + 1, c.source_dataset_id FROM r JOIN c ON r.nxt = c.entity_id) SELECT entity_id, ancestor_id, distance FROM r""")
def _(t):
    return catalog.lineage(_catalogue(t))


@query("b30_lineage_of", f"""WITH RECURSIVE c AS (SELECT * FROM {CATALOGUE}), r AS (SELECT entity_id AS ancestor_id, 0::BIGINT AS distance, name, pipeline_name, source_dataset_id AS nxt FROM c WHERE entity_id = (SELECT max(entity_id) FROM c WHERE source_dataset_id IS NOT NULL)
  UNION ALL SELECT c.entity_id, r.distance + 1, c.name, c.pipeline_name, c.source_dataset_id FROM r JOIN c ON r.nxt = c.entity_id) SELECT ancestor_id, distance, name, pipeline_name FROM r""")
def _(t):
    rows = _catalogue(t)
    return catalog.lineage_of(rows, rows.where("source_dataset_id IS NOT NULL").agg(F.max("entity_id")).first()[0])


@query("b30_children", f"SELECT entity_id FROM {CATALOGUE} WHERE source_dataset_id = (SELECT min(source_dataset_id) FROM {CATALOGUE})")
def _(t):
    rows = _catalogue(t)
    return catalog.derived_from(rows, rows.agg(F.min("source_dataset_id")).first()[0]).select("entity_id")


# ---- user-defined functions ------------------------------------------------------------


@query("d1_model_udf", "SELECT l_orderkey, l_linenumber, round(3 * l_quantity - 2 * l_tax, 6) AS score FROM lineitem")
def _(t):
    call = model_udf(lambda frame: 3 * frame.iloc[:, 0] - 2 * frame.iloc[:, 1], "double")
    return rounded(t.lineitem.select(*_LINE, call(F.col("l_quantity"), F.col("l_tax")).alias("score")))


@query("d1_map_predict", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round(l_quantity * (1 - l_discount), 6) AS prediction FROM lineitem")
def _(t):
    base = t.lineitem.select(*_LINE, "l_quantity", "l_discount")
    return rounded(map_predict(base, lambda x: x["l_quantity"] * (1 - x["l_discount"]), ["l_quantity", "l_discount"]))


@query("d5_registered_step", "SELECT c_custkey, c_acctbal, c_acctbal > 1000 AS rich FROM customer")
def _(t):
    register("FlagAbove", lambda df, column, limit, name: df.withColumn(name, F.col(column) > limit))
    chain = FeatureChain([{"name": "FlagAbove", "parameters": {"column": "c_acctbal", "limit": 1000, "name": "rich"}}])
    return chain.fit_transform(t.customer.select("c_custkey", "c_acctbal"))
