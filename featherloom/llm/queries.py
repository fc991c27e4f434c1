"""The registered queries of this subpackage and the SQL twins of those that SQL can state on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.llm import alignment, decontaminate, licenses, lm_score, merkle, mixing, packing, quality, repeats, simhash, token_counts, url_rules, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The rules (host, path, verdict) of the url query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    words, network = lm_score.train(docs)
    return lm_score.score(docs, words, network)


@query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_templates(table(spark, folder, "documents"), licenses.templates_table(spark))


@query
def op3_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op4_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op6_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


@query
def op8_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.match_rules(table(spark, folder, "pages"), spark.createDataFrame(URL_RULES, url_rules.RULES), keep=("page_id",))


@query
def op9_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_edited_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, folder, "documents"))


@query
def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op12_aligned_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_corpus(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


_ASCII_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array(" + _ASCII_LOW.format("coalesce(text, '')") + r", '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


SQL["op2_license_scan"] = f"""
WITH t AS (SELECT template_id, license, {_WORDS} AS ws FROM (VALUES {_values([(i, n, t) for i, (n, t) in enumerate(licenses.TEMPLATES)])}) v(template_id, license, text)),
ts AS (SELECT DISTINCT template_id, license, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM t)),
tn AS (SELECT *, count(*) OVER (PARTITION BY template_id) AS q FROM ts),
tu AS (SELECT *, cast(pow(2, ceil(log2(q))) AS BIGINT) AS u FROM tn),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM d)),
hit AS (SELECT doc_id, template_id, license, q, u, shingle, unnest([pos // u, pos // u - 1]) AS w FROM ds JOIN tu USING (shingle)),
win AS (SELECT doc_id, template_id, license, w, u, count(DISTINCT shingle) / q AS c FROM hit WHERE w >= 0 GROUP BY doc_id, template_id, license, w, u, q)
SELECT doc_id, template_id, license, count(*) AS n_windows, max(c) AS containment, min(w * u) AS first_word FROM win WHERE c >= 0.8 GROUP BY doc_id, template_id, license"""

SQL["op6_benchmark_leaks"] = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM b)),
bn AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS q FROM bs),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM d))
SELECT doc_id, item_id, count(*) / any_value(q) AS containment FROM ds JOIN bn USING (shingle) GROUP BY doc_id, item_id HAVING count(*) / any_value(q) >= 0.8"""

SQL["op8_url_verdicts"] = f"""
WITH p AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, {_ASCII_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES {_values(URL_RULES)}) v(r_host, r_path, r_verdict)),
u AS (SELECT DISTINCT host, path FROM h),
m AS (SELECT host, path, max(struct_pack(a := length(r_host) + length(r_path), b := length(r_host), rule := r_host || r_path, verdict := r_verdict)) AS best
  FROM u JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path)
SELECT page_id, h.host, h.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.host = m.host AND h.path = m.path"""
