"""The dataset catalogue: listing, loading the newest match, lineage.

Catalogue columns: entity_id, name, is_transformed, source_dataset_id, pipeline_name, created_at, path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.operators.ordered import lookup_join
from featherloom.params import ParameterError
from featherloom.session import materialise


def list_transformed(catalogue: DataFrame, source_dataset_id=None, pipeline_name: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest transformed datasets first; a limit applies after the sort."""
    df = catalogue.where("is_transformed")
    if source_dataset_id is not None:
        df = df.where(F.col("source_dataset_id") == F.lit(source_dataset_id))
    if pipeline_name is not None:
        df = df.where(F.col("pipeline_name") == pipeline_name)
    found = df.orderBy(F.desc("created_at"), F.desc("entity_id"))
    return found if limit is None else found.limit(limit)


def load_transformed(catalogue: DataFrame, name: str, pipeline_name: str | None = None, source_dataset_id=None) -> DataFrame:
    """Read the newest transformed dataset whose name contains the text (any case)."""
    matches = list_transformed(catalogue.where(F.contains(F.lower("name"), F.lit(name.lower()))), source_dataset_id, pipeline_name, 1).collect()
    if not matches:
        raise ParameterError(f"no transformed dataset matches {name!r}")
    return catalogue.sparkSession.read.parquet(matches[0]["path"])


def derived_from(catalogue: DataFrame, dataset_id) -> DataFrame:
    """Direct children."""
    return catalogue.where(F.col("source_dataset_id") == F.lit(dataset_id))


def lineage(catalogue: DataFrame) -> DataFrame:
    """(entity_id, ancestor_id, distance) for every dataset, itself at distance 0; cycles are harmless.

    Distances double each round, so a chain of n datasets takes about log2(n) joins. Where each dataset has one source and there
    is no cycle, every pair is made exactly once and nothing is compared with the pairs of earlier rounds.
    """
    links = materialise(catalogue.select("entity_id", "source_dataset_id"), "lineage-links")
    known = links.select("entity_id").distinct()
    jump = links.where("source_dataset_id IS NOT NULL").select("entity_id", F.col("source_dataset_id").alias("ancestor_id")).distinct()
    jump = materialise(lookup_join(jump, known.select(F.col("entity_id").alias("ancestor_id")), ["ancestor_id"], "inner"), "lineage-jumps")
    known = materialise(known, "lineage-known")
    if jump.groupBy("entity_id").count().where("count > 1").isEmpty():
        found = _lineage_of_chains(known, jump)
        if found is not None:
            return found
    return _lineage_of_graph(known, jump)


def _lineage_of_chains(known: DataFrame, jump: DataFrame) -> DataFrame | None:
    """The pairs where a dataset has at most one source; None as soon as one turns out to be its own ancestor.

    The ancestors at distances from ``step`` to 2 * ``step`` - 1 are those nearer than ``step`` of the ancestor at
    ``step``. A cycle of length n shows in the round of distance n, so no dataset gets more than twice its distinct pairs.
    """
    rounds = [known.select("entity_id", F.col("entity_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("distance"))]
    step = 1
    while not jump.isEmpty():
        ahead = jump.withColumnRenamed("ancestor_id", "a")
        nearer = reduce(DataFrame.unionByName, rounds).select(F.col("entity_id").alias("a"), "ancestor_id", "distance")
        further = lookup_join(ahead, nearer, ["a"], "inner").select("entity_id", "ancestor_id", (F.col("distance") + step).alias("distance"))
        further = materialise(further, "lineage")
        if not further.where("entity_id = ancestor_id").isEmpty():
            return None
        rounds.append(further)
        jump = lookup_join(ahead, jump.select(F.col("entity_id").alias("a"), "ancestor_id"), ["a"], "inner").select("entity_id", "ancestor_id")
        jump = materialise(jump, "lineage-jumps")
        step *= 2
    return reduce(DataFrame.unionByName, rounds)


def _lineage_of_graph(known: DataFrame, jump: DataFrame) -> DataFrame:
    """The pairs of any links: those of a round are merged with all earlier ones, the least distance stays."""
    pairs = known.select("entity_id", F.col("entity_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("distance"))
    step, before = 1, pairs.count()
    while True:
        # id -> a (step away), then a's ancestors
        reach = pairs.select(F.col("entity_id").alias("a"), F.col("ancestor_id").alias("anc"), "distance")
        further = lookup_join(jump.withColumnRenamed("ancestor_id", "a"), reach, ["a"], "inner")
        further = further.select("entity_id", F.col("anc").alias("ancestor_id"), (F.col("distance") + step).alias("distance"))
        merged = pairs.unionByName(further).groupBy("entity_id", "ancestor_id").agg(F.min("distance").alias("distance"))
        pairs = materialise(merged, "lineage")
        after = pairs.count()
        if after == before:
            return pairs
        ahead = jump.select(F.col("entity_id").alias("a"), F.col("ancestor_id").alias("anc"))
        jump = lookup_join(jump.withColumnRenamed("ancestor_id", "a"), ahead, ["a"], "inner").select("entity_id", F.col("anc").alias("ancestor_id"))
        jump = materialise(jump, "lineage-jumps")
        before, step = after, step * 2


def lineage_of(catalogue: DataFrame, dataset_id) -> DataFrame:
    """The chain of one dataset, source first: (ancestor_id, distance, name, pipeline_name).

    Links are doubled each round and only the datasets already on the chain follow them, so a chain of n
    datasets takes about log2(n) rounds, each linear in the catalogue. Cycles end the search. An unknown id has no rows.
    """
    links = catalogue.groupBy("entity_id").agg(F.min("source_dataset_id").alias("ancestor_id"))
    known = links.select(F.col("entity_id").alias("ancestor_id"))
    jump = materialise(lookup_join(links.where("ancestor_id IS NOT NULL"), known, ["ancestor_id"], "inner"), "lineage-jumps")
    chain = materialise(known.where(F.col("ancestor_id") == F.lit(dataset_id)).withColumn("distance", F.lit(0).cast("bigint")), "lineage")
    step, before = 1, chain.count()
    while before:
        further = lookup_join(jump, chain.withColumnRenamed("ancestor_id", "entity_id"), ["entity_id"], "inner").select("ancestor_id", (F.col("distance") + step).alias("distance"))
        chain = materialise(chain.unionByName(further).groupBy("ancestor_id").agg(F.min("distance").alias("distance")), "lineage")
        after = chain.count()
        if after == before:
            break
        ahead = jump.select(F.col("entity_id").alias("a"), F.col("ancestor_id").alias("anc"))
        jump = materialise(lookup_join(jump.withColumnRenamed("ancestor_id", "a"), ahead, ["a"], "inner").select("entity_id", F.col("anc").alias("ancestor_id")), "lineage-jumps")
        before, step = after, step * 2
    about = catalogue.groupBy(F.col("entity_id").alias("ancestor_id")).agg(F.min("name").alias("name"), F.min("pipeline_name").alias("pipeline_name"))
    return lookup_join(chain, about, ["ancestor_id"]).orderBy(F.desc("distance"))
