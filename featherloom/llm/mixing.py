"""Sources mixed to target weights: Sainte-Laguë quotas of equal-token blocks, then a seeded choice of blocks.

Tokens are words (runs of anything but ASCII white space). Every source gets a target: its weight's share of
all words, at most ``repeat`` times its own size, the excess shared again by weight until none is above.

A source's documents, in a seeded order, are one stream per shard; a stream is cut into blocks of ``block``
words, so a block may begin and end inside a document. The blocks of the whole mix are dealt to the sources by the highest
quotients target / (2 k - 1), the k-th block of a source, and a source's quota to its shards by their words in the
same way, so every shard has a whole number. A shard with a quota of q and n blocks takes every block q div n
times and q mod n of them once more: every (n / (q mod n))-th one of the seeded order, from a seeded start. No
block, hence no word, is taken more than ``repeat`` times.

Shards hold a bounded number of words and rows whatever the source, so a hot source is many tasks. Equal rows
are counted first and dealt in bundles of bounded size. Quotas, shards and order depend on the rows and the seed
alone: neither partitions nor reruns change them.

Null texts count as empty, size 0, nothing taken. A null source is a source, the last one. Repeated rows and shared or null
ids are rows of their own. All sizes 0: all targets 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featherloom.llm.tables import only, stored
from featherloom.llm.words import blocks, tidied, word_spans
from featherloom.operators.ordered import lookup_join, row_numbers, running

BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
SHARD_ROWS = 1 << 17
BUNDLE = 4096  # equal rows dealt together
SEED = 11

UNIT = ("doc_id", "source", "digest")


def _sized(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, source, digest, size), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(word_spans(b.data, b.offsets)[2]) for b in blocks(batch)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in UNIT], pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())], [*UNIT, "size"])

    rows = only(docs, "doc_id", "source", text).select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(f"`{text}`").alias("digest"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, source string, digest long, size long")


def source_targets(sizes: DataFrame, weights: Sequence[int], repeat: int) -> DataFrame:
    """``sizes``: (source, source_size, ...) -> the same with ``target``.

    Sources are filled in order of ``repeat * size / weight``: those below the level at which the rest
    could share what is left stop at their cap. Sums are of whole numbers, so the result does not depend on their order.
    """
    ranked = stored(row_numbers(sizes, [], ["source"], "rank"), "sources").withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    all_size, all_weight = whole["size"] or 0, whole["weight"] or 0
    ratio = (F.col("source_size") / F.col("weight")).alias("ratio")
    filled = running(ranked.select("*", ratio), [], ["ratio", "rank"], {"size_before": ("sum", F.col("source_size")), "weight_before": ("sum", F.col("weight"))}, include_current=False)

    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    left_size = F.lit(all_size) - repeat * F.coalesce("size_before", F.lit(0))
    left_weight = (F.lit(all_weight) - F.coalesce("weight_before", F.lit(0))).cast("decimal(18,0)")
    filled = stored(filled.withColumn("capped", wide(repeat * F.col("source_size")) * left_weight <= wide(left_size) * F.col("weight").cast("decimal(18,0)")), "sources")
    cap = filled.filter("capped").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest, over = all_size - repeat * (cap["size"] or 0), all_weight - (cap["weight"] or 0)
    target = F.when(F.col("capped"), (repeat * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(float(rest)) / F.lit(float(max(over, 1))))
    return filled.withColumn("target", target).drop("rank", "ratio", "weight", "size_before", "weight_before", "capped")


def apportion(parts: DataFrame, group: Sequence[str], part: str) -> DataFrame:
    """Sainte-Laguë seats: ``parts`` has (*group, part, votes, cap, wanted), ``wanted`` the seats of the group.

    Seats go to the highest quotients votes / (2 k - 1) of parts below their cap; equal quotients to the smaller part.
    All parts move by the same relative step between any two divisors, so only the few seats around a part's
    proportional share are ranked. Whether that range was wide enough is checked, and it is widened until it was.
    """
    sums = parts.groupBy(*group).agg(F.sum("votes").alias("all_votes"), F.count("*").alias("n_parts"))
    known = stored(lookup_join(parts, sums, list(group)), "parts")
    slack = 2.0
    while True:
        share = F.coalesce(F.col("votes") * F.col("wanted") / F.col("all_votes"), F.lit(0.0))
        reach = F.lit(slack) * F.col("n_parts") / F.greatest("wanted", F.lit(1))
        low = F.least(F.col("cap"), F.greatest(F.lit(0), F.floor(share * (1 - reach) - 1))).cast("long")
        high = F.least(F.col("cap"), F.ceil(share * (1 + reach) + 1)).cast("long")
        around = known.withColumns({"low": F.when(F.col("votes") > 0, low).otherwise(0), "high": F.when((F.col("votes") > 0) & (F.col("wanted") > 0), high).otherwise(0)})
        fixed = around.groupBy(*group).agg(F.sum("low").alias("all_low"))
        open_seats = around.filter("high > low").select(*group, F.col(part), "low", "votes", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("k"))
        open_seats = open_seats.withColumn("quotient", F.col("votes") / (2 * F.col("k") - 1))
        ranked = row_numbers(open_seats, list(group), ["-quotient", part], "rank")
        ranked = lookup_join(ranked, fixed, list(group)).select(*group, F.col(part), "rank", "all_low")
        given = lookup_join(around, ranked.groupBy(*group, part).agg(F.collect_list("rank").alias("ranks"), F.max("all_low").alias("all_low")), [*group, part])
        extra = F.size(F.filter(F.coalesce("ranks", F.array().cast("array<long>")), lambda r: r <= F.col("wanted") - F.col("all_low"))).cast("long")
        given = stored(given.withColumn("extra", extra).withColumn("seats", F.col("low") + F.col("extra")), "seats")
        # Wide enough: nobody used the whole range without being at the cap, nobody was left with its lowest seat.
        narrow = (F.col("seats") == F.col("high")) & (F.col("high") < F.col("cap")) & (F.col("votes") > 0) & (F.col("wanted") > 0) | (F.col("extra") == 0) & (F.col("low") > 0) & (F.col("low") < F.col("cap"))
        if not given.filter(narrow).limit(1).count():
            return given.select(*group, part, "seats")
        slack *= 4


def mix_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeat: int = 3, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, digest, size, source_size, target, start, quota, n_blocks, first_block).

    ``start`` is the document's place in the stream of its shard; ``first_block`` the seeded start of the choice.
    """
    units = stored(_sized(docs, text).groupBy(*UNIT, "size").count().withColumnRenamed("count", "rows"), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("source_rows"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / SHARD_ROWS)).cast("int")
    targets = stored(source_targets(sizes, weights, repeat).withColumn("shards", shards), "targets")

    bundles = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {BUNDLE}")))
    dealt = lookup_join(units.select("*", bundles.alias("bundle")), targets.drop("source_rows"), ["source"])
    dealt = dealt.withColumn("rows", F.least(F.lit(BUNDLE), F.col("rows") - F.col("bundle") * BUNDLE))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "digest", "bundle"), F.col("shards")).cast("int"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "digest", "bundle"), "doc_id", "digest", "size", "bundle")
    words = F.col("size") * F.col("rows")
    placed = stored(dealt.filter("size > 0").withColumn("start", F.sum(words).over(order) - words), "placed")

    streams = placed.groupBy("source", "shard").agg(F.sum(words).alias("votes"))
    streams = stored(streams.withColumn("n_blocks", F.ceil(F.col("votes") / block).cast("long")).withColumn("cap", repeat * F.col("n_blocks")), "streams")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    caps = streams.groupBy("source").agg(F.sum("cap").alias("cap"))
    by_source = lookup_join(targets.filter("source_size > 0").select("source", F.col("target").alias("votes")), caps, ["source"]).withColumn("wanted", F.lit((2 * total + block) // (2 * block)))
    quotas = apportion(by_source.withColumn("mix", F.lit(0)), ["mix"], "source").select("source", F.col("seats").alias("wanted"))
    by_shard = apportion(lookup_join(streams, quotas, ["source"]), ["source"], "shard")
    streams = lookup_join(by_shard.withColumnRenamed("seats", "quota"), streams.select("source", "shard", "n_blocks"), ["source", "shard"])
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("n_blocks"))
    taken = lookup_join(placed, streams.withColumn("first_block", first), ["source", "shard"])

    columns = ["doc_id", "source", "digest", "size", "source_size", "target"]
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("nth")
    sized = taken.select(*columns, "start", "quota", "n_blocks", "first_block", nth).withColumn("start", F.col("start") + F.col("nth") * F.col("size")).drop("nth")
    none = [F.lit(0).cast("long").alias(c) for c in ("start", "quota")] + [F.lit(1).cast("long").alias("n_blocks"), F.lit(0).cast("long").alias("first_block")]
    empty = dealt.filter("size = 0").select(*columns, *none, nth).drop("nth")
    return sized.unionByName(empty)


def _passed(place: Column, block: int) -> Column:
    """Words taken from the stream of a shard before ``place``."""
    b, n = F.floor(place / block).cast("long"), F.col("n_blocks")
    whole, rest = F.expr("quota div n_blocks"), F.expr("quota % n_blocks")
    before = F.floor((b * rest + F.col("first_block")) / n).cast("long")
    here = F.floor(((b + 1) * rest + F.col("first_block")) / n).cast("long") - before
    return whole * place + before * block + here * (place - b * block)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeat: int = 3, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per row of ``docs``."""
    plan = mix_plan(docs, weights, repeat, block, shard_words, seed, text)
    taken = _passed(F.col("start") + F.col("size"), block) - _passed(F.col("start"), block)
    return plan.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeat: int = 3, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, text: str = "text") -> DataFrame:
    """The mix itself: (doc_id, source, first_word, n_words, copies, text), one row per part of a document that is
    taken ``copies`` times; its words are joined by single spaces. Neighbouring blocks that are taken equally often are one part."""
    plan = mix_plan(docs, weights, repeat, block, shard_words, seed, text).filter("size > 0 and quota > 0")
    number = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    each = plan.withColumn("uid", F.monotonically_increasing_id()).select("*", number.alias("b"))
    rest = F.expr("quota % n_blocks")
    copies = F.expr("quota div n_blocks") + F.floor(((F.col("b") + 1) * rest + F.col("first_block")) / F.col("n_blocks")) - F.floor((F.col("b") * rest + F.col("first_block")) / F.col("n_blocks"))
    first = F.greatest(F.col("b") * block - F.col("start"), F.lit(0))
    last = F.least((F.col("b") + 1) * block - F.col("start"), F.col("size"))
    parts = stored(each.select(*UNIT, "uid", "b", copies.cast("long").alias("copies"), first.cast("long").alias("first"), last.cast("long").alias("last")), "mix-parts")
    of = Window.partitionBy("uid").orderBy("b")
    run = F.sum(F.coalesce((F.col("copies") != F.lag("copies").over(of)).cast("int"), F.lit(0))).over(of)
    parts = parts.withColumn("run", run).groupBy(*UNIT, "uid", "run", "copies").agg(F.min("first").alias("first_word"), (F.max("last") - F.min("first")).alias("n_words")).filter("copies > 0")
    texts = only(docs, "doc_id", "source", text).select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(f"`{text}`").alias("digest"), F.col(f"`{text}`").alias("text"))
    texts = texts.groupBy(*UNIT).agg(F.first("text").alias("text"))  # rows of one digest have one text
    parts, texts = parts.alias("p"), texts.alias("t")
    joined = parts.join(texts, F.expr(" and ".join(f"p.{c} <=> t.{c}" for c in UNIT)))
    words = F.filter(F.split("t.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    return joined.select("p.doc_id", "p.source", "first_word", "n_words", "copies", cut.alias("text"))
