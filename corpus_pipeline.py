"""A corpus pipeline of five stages, each an operator of ``featherloom.llm`` on what the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a table. Its result is
written as Parquet in the shared folder and read again as the next one's ``docs``. All stages but the last return the columns of ``documents``.

1. quality: documents that the classifier rejects (score below 0.7) go.
2. near_duplicates: of each component of near copies the document with the smallest id stays (of repeated rows one). Linked are
   fingerprints at two bits or fewer, and texts whose shingles of five words have a similarity of 0.8 or more.
3. repeats: strings of 200 bytes that occur elsewhere are removed from the texts; characters cut by that go as
   well; ``n_chars`` is counted anew where a text changed. A text that was a repeat as a whole stays as an empty text.
4. decontaminated: documents that contain a benchmark item go.
5. packed: the rest as sequences of at most 1024 tokens, one row per piece.

An empty table passes through as an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.llm import decontaminate, packing, quality, repeats, simhash
from featherloom.llm.queries import table, vocabulary
from featherloom.llm.tables import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL states neither the fitted classifier nor the tokens.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    return simhash.first_of_each(docs, threshold=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(_documents(docs), with_text=True, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(_documents(docs), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(docs), vocabulary("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_copies),
    ("repeats", without_repeats),
    ("decontaminated", without_benchmark),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
