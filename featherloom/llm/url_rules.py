"""URL rules by a sort-merge range join: prefixes of reversed hosts as nested intervals.

A rule ``(host, path, verdict)`` fits a url if the url's host is the rule's host or a subdomain of it
and the url's path starts with the rule's path. The longest fitting rule wins (host and path counted
together, then the longer host).

Each host suffix of a url gives one key ``reversed labels / path``. In the byte order of these keys a
rule is the interval from its own key to the last key that starts with it, and the intervals of one
host are nested or apart. One sorted sweep over starts, url keys and ends keeps the stack: the running
sum of starts minus ends is its depth, and the rule on top is the last start of that depth.

The sweep runs in groups of one host suffix and one salt. The number of salts follows the suffix's
share of all keys, so no group is larger than an even share; a suffix's rules are in each of its
groups. Only distinct (host, path) pairs are swept. Everything is a DataFrame operation.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule (unless
a rule's host is empty). Of rules with the same host and path, block wins. Null hosts, paths or
verdicts of rules: the rule is left out. Repeated urls and page ids keep their rows. An empty table
gives an empty result, no rules give the default verdict everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from featherloom.llm.tables import only, partitions

RULES = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #``; then up to ``? #``."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _key(labels: Column, path: Column) -> Column:
    """Bytes that sort like reversed host, then path; a host never holds a slash."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path).cast("binary")


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (), default: str = "allow") -> DataFrame:
    """``keep`` columns of ``urls`` with host, path, rule and verdict, one row per row of ``urls``."""
    spark = urls.sparkSession
    host, path = url_parts(F.col("_url"))
    pages = urls.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url}`").cast("string").alias("_url"))
    pages = pages.withColumns({"host": host, "path": path}).drop("_url")

    rules = (
        only(rules, "host", "path", "verdict").dropna().groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("labels", F.split("r_host", r"\.", -1))
    )
    deepest = rules.agg(F.max(F.size("labels"))).first()[0] or 0

    pairs = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    levels = pairs.withColumn("labels", labels).select(
        "host", "path", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(deepest, 1))))).alias("level"), "labels"
    )
    levels = levels.select("host", "path", F.slice("labels", F.size("labels") - F.col("level") + 1, F.col("level")).alias("labels"))
    # Suffixes for which there is no rule need no sweep.
    levels = levels.withColumn("suffix", F.array_join("labels", "."))
    suffixes = rules.select(F.col("r_host").alias("suffix")).distinct()
    levels = levels.join(suffixes, "suffix", "left_semi")

    counts = levels.groupBy("suffix").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    share = max(1, total // (2 * partitions(spark)))
    salts = counts.select("suffix", F.ceil(F.col("count") / share).cast("int").alias("salts"))

    keyed = levels.join(salts, "suffix").select(
        "suffix", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"),
        _key(F.col("labels"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "host", "path",
        *[F.lit(None).cast(t).alias(c) for c, t in (("r_host", "string"), ("r_path", "string"), ("r_verdict", "string"))],
    )
    spread = rules.join(salts, F.col("r_host") == F.col("suffix")).select(
        "suffix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), _key(F.col("labels"), F.col("r_path")).alias("key"), "r_host", "r_path", "r_verdict",
    )
    ends = F.array(F.struct(F.col("key").alias("at"), F.lit(0).alias("kind")), F.struct(F.concat("key", F.lit(b"\xff")).alias("at"), F.lit(2).alias("kind")))
    edges = spread.withColumn("edge", F.explode(ends)).select(
        "suffix", "salt", F.col("edge.at").alias("key"), F.col("edge.kind").alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        "r_host", "r_path", "r_verdict",
    )
    events = keyed.unionByName(edges)

    order = [F.col("key"), F.col("kind")]
    so_far = Window.partitionBy("suffix", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    swept = events.withColumn("depth", F.sum(step).over(so_far))
    same_depth = Window.partitionBy("suffix", "salt", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pushed = F.when(F.col("kind") == 0, F.struct("r_host", "r_path", "r_verdict"))
    top = F.when(F.col("depth") > 0, F.last(pushed, ignorenulls=True).over(same_depth))
    found = swept.withColumn("top", top).filter("kind = 1 AND top IS NOT NULL")
    length = F.length("top.r_host") + F.length("top.r_path")
    best = found.groupBy("host", "path").agg(F.max(F.struct(length.alias("a"), F.length("top.r_host").alias("b"), F.col("top"))).alias("best"))
    best = best.select("host", "path", F.concat("best.top.r_host", "best.top.r_path").alias("rule"), F.col("best.top.r_verdict").alias("verdict"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
