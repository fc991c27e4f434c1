"""Fingerprints of documents as Merkle trees over pieces, paragraphs and sections.

A paragraph is a line. Its leaves are pieces of up to eight words (32 characters of a longer word count
as one), so a long line has branches as well. A section ends after a paragraph whose digest is divisible
by ``section``: borders follow the content, so an insertion changes only the section it is in.

Leaves are XXH64 digests, inner digests hash the digests below them and the root is a SHA-256 over the
section digests. A printed tree is ``root;section:leaf.leaf,leaf|section:...`` with ``.`` between leaves,
``,`` between paragraphs and ``|`` between sections. Equal texts have equal trees.

Comparing two trees starts at the roots. If they differ, ``first_change`` goes down the first differing
section to its first differing paragraph, and ``likeness`` is 2 * common leaves / leaves of both, each
counted once; it is 1 for equal roots.

Everything is a DataFrame expression. Null texts count as empty; the empty text has one empty paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featherloom.llm.tables import only, partitions

PIECE_WORDS = 8
SECTION_EVERY = 4
#: Text that a task of ``with_next`` is meant to get, groups of a task, the least and the most text of a group (a window holds a whole one), and what a row counts beside its text.
TASK_BYTES = 32 << 20
GROUPS = 16
LEAST_BYTES = 64 << 10
MOST_BYTES = 8 << 20
ROW_BYTES = 100


def _hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def with_tree(df: DataFrame, text: str, name: str, section: int = SECTION_EVERY) -> DataFrame:
    """Adds ``<name>_tree`` (printed), ``<name>_root``, ``<name>_sections``, ``<name>_paragraphs`` and ``<name>_leaves``."""
    piece = rf"\S{{1,32}}+(?:\s*+\S{{1,32}}+){{0,{PIECE_WORDS - 1}}}+\s*+|\s++"
    nested, paragraphs, cuts, sections = f"{name}_nested", f"{name}_paragraphs", f"{name}_cuts", f"{name}_sections"

    def start(k: Column) -> Column:
        return F.when(k == 0, 0).otherwise(F.element_at(cuts, k))

    def digests(k: Column) -> Column:
        return F.slice(paragraphs, start(k) + 1, F.element_at(cuts, k + 1) - start(k))

    def printed(k: Column) -> Column:
        below = F.slice(nested, start(k) + 1, F.element_at(cuts, k + 1) - start(k))
        lines = F.transform(below, lambda leaves: F.array_join(F.transform(leaves, _hex), "."))
        return F.concat(_hex(F.element_at(sections, k + 1)), F.lit(":"), F.array_join(lines, ","))

    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    df = df.withColumn(nested, F.transform(lines, lambda line: F.transform(F.regexp_extract_all(line, F.lit(piece), F.lit(0)), lambda p: F.xxhash64(p))))
    df = df.withColumn(paragraphs, F.transform(nested, lambda leaves: F.xxhash64(leaves)))
    n = F.size(paragraphs)
    df = df.withColumn(cuts, F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(F.element_at(paragraphs, i), F.lit(section)) == 0)))
    each = F.sequence(F.lit(0), F.size(cuts) - 1)
    df = df.withColumn(sections, F.transform(each, lambda k: F.xxhash64(digests(k))))
    df = df.withColumn(f"{name}_root", F.sha2(F.array_join(F.transform(sections, _hex), ""), 256))
    tree = F.concat(F.col(f"{name}_root"), F.lit(";"), F.array_join(F.transform(each, printed), "|"))
    df = df.withColumns({f"{name}_tree": tree, f"{name}_leaves": F.array_distinct(F.flatten(nested))})
    return df.drop(nested, cuts)


def likeness(root: Column, leaves: Column, other_root: Column, other_leaves: Column) -> Column:
    """0 to 1; the leaves are read only where the roots differ."""
    both = F.size(leaves) + F.size(other_leaves)
    common = F.size(F.array_intersect(leaves, other_leaves))
    return F.when(root == other_root, 1.0).when(both == 0, 0.0).otherwise(2.0 * common / both)


def first_change(name: str, other: str) -> Column:
    """Number (from 0) of the first differing paragraph; null for equal trees."""
    a, b = F.col(f"{name}_paragraphs"), F.col(f"{other}_paragraphs")
    same = F.least(F.size(a), F.size(b))
    differing = F.filter(F.sequence(F.lit(1), same), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.when(F.col(f"{name}_root") != F.col(f"{other}_root"), F.coalesce(F.try_element_at(differing, F.lit(1)) - 1, same))


def _place() -> Column:
    """Where a row stands in the order of ``with_next``, as a text that sorts the same way."""
    def ordered(c: Column) -> Column:
        return _hex(c.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))

    number = F.col("doc_id").cast("long")
    return F.concat(F.when(number.isNull(), "1").otherwise(F.concat(F.lit("0"), ordered(F.bitwise_not(number)))), ordered(F.xxhash64("text")))


def _sizes(n: int, rows: int, size: int) -> tuple[int, int]:
    """Tasks, n or more, and bytes of a group for so many rows and bytes: several groups a task, several rows a group."""
    tasks = max(n, -(-size // TASK_BYTES))
    return tasks, min(max(size // (GROUPS * tasks), GROUPS * size // max(rows, 1), LEAST_BYTES), MOST_BYTES)


def _group_starts(docs: DataFrame, most: int) -> tuple[list[str], bool]:
    """The first place of each group, and whether rows of one place overfill a group.

    A group has ``most`` bytes at most beside its first place; rows of one place stay together.
    """
    n = partitions(docs.sparkSession)
    places = docs.select(_place().alias("place"), _bytes().alias("size")).repartitionByRange(n, "place").withColumn("part", F.spark_partition_id())
    # Rows of one place are in one part, and their sum counts all of them.
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("place"))
    groups = places.withColumn("group", F.floor((upto - 1) / most)).groupBy("part", "group")
    found = groups.agg(F.min("place").alias("start"), (F.sum("size") - F.max("size") > most).alias("crowded")).select("start", "crowded").collect()
    return sorted(r["start"] for r in found), any(r["crowded"] for r in found)


def _bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES


def with_next(docs: DataFrame, carry: list[str] | None = None, prepare=None) -> DataFrame:
    """Each row of (doc_id, text) with ``next_<column>`` of the document next in descending doc_id; after the last comes the first.

    The order is doc_id, then a hash of the text; null ids come last. The order is cut into groups of a window,
    by bytes and not by ids, so that many rows without an id or with one id are cut as well; the first document
    of a group is copied into the one before, so other texts move once. ``prepare`` adds columns after the move,
    ``carry`` names those wanted.
    """
    docs = only(docs, "doc_id", "text")
    total = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(_bytes()).alias("size")).first()
    tasks, most = _sizes(partitions(docs.sparkSession), total["rows"], total["size"] or 0)
    starts, crowded = _group_starts(docs, most)
    # One literal and a binary search: neither the depth of the plan nor a row's steps grow with the groups.
    known, last = F.split(F.lit(",".join(starts)), ","), F.lit(len(starts))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(len(starts), 1).bit_length()))])

    def moves(group: Column) -> Column:
        above = F.when(F.get(known, group - 1) == F.col("place"), F.when(group == 1, last).otherwise(group - 1))
        both = F.array(F.struct(group.alias("group"), F.lit(False).alias("copy")), F.struct(above.alias("group"), F.lit(True).alias("copy")))
        return F.filter(both, lambda m: m["group"].isNotNull())

    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= F.col("place"), at + step).otherwise(at), moves)
    moved = docs.withColumn("place", _place()).withColumn("move", F.explode(found)).select("doc_id", "text", F.col("move.group").alias("group"), F.col("move.copy").alias("copy"))
    moved = moved.repartition(tasks, "group")
    if crowded:
        # Rows alike are one row up to the end of the window, and follow each other.
        moved = moved.groupBy("group", "copy", "doc_id", "text").agg(F.count(F.lit(1)).cast("int").alias("alike"))
    if prepare:
        moved = prepare(moved)
    order = Window.partitionBy("group").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    carry = carry or ["text"]
    after = moved.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry}).filter(~F.col("copy")).drop("copy", "group")
    if crowded:
        each = F.explode(F.concat(F.array_repeat(F.lit(True), F.col("alike") - 1), F.array(F.lit(False))))
        after = after.withColumn("alike", each).withColumns({f"next_{c}": F.when(F.col("alike"), F.col(c)).otherwise(F.col(f"next_{c}")) for c in carry}).drop("alike")
    return after


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Trees of every document and of its edited text, with likeness to that and to the next document.

    The edited text: the last half (rounded down, in code points) is replaced by as many first code points
    of the next document, or all it has. One row per row of ``docs``; repeated ids keep their rows.
    """
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    pairs = with_next(docs, ["text", "own_root", "own_leaves"], lambda df: with_tree(df, "text", "own"))
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    pairs = with_tree(pairs.withColumn("edited", edited), "edited", "edited")
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own_tree").alias("fingerprint"), F.col("edited_tree").alias("edited_fingerprint"),
        likeness(F.col("own_root"), F.col("own_leaves"), F.col("edited_root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("own_root"), F.col("own_leaves"), F.col("next_own_root"), F.col("next_own_leaves")).alias("near_next"),
        first_change("own", "edited").cast("long").alias("first_changed_paragraph"),
    )
