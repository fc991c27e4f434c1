"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, components.

Fingerprints: A-Z in lower case, words are runs of bytes other than white space (0x20, 0x09-0x0D), a
shingle is ``words`` words in a row joined by one space (fewer words: all of them), repeats counted.
A bit is 1 if it is set in over half of the shingles' XXH64 (UTF-8, seed 42). No words: fingerprint 0.

Close pairs: the 64 bits are cut into four blocks. Two fingerprints with at most two
different bits agree in two blocks at least, so each distinct fingerprint is filed under every pair of
blocks, and fingerprints of one file are joined and verified by their Hamming distance. A file of more
than ``crowd`` fingerprints is not joined with itself: its fingerprints go under all their
neighbours at one bit or none, and those that meet under one neighbour are linked to the
smallest of them. Two at distance 2 always meet at a neighbour at distance 1 from both, and whatever
meets there is at most 2 apart, so this is exact, and no file emits more than a fixed number of rows
per fingerprint.

Links are between distinct fingerprints; documents are attached at the end, so copies are never paired.

Similar texts (``similar_links``, used by ``first_of_each`` with a threshold) are found from their distinct five-word shingles alone, for
every distinct text and at any number of bits apart. Shingles are ordered, rare ones first; two texts with a similarity of t share one of
their first n - ceil(t * n) + 1 at least, whatever the order, so each text is filed under these. How common a shingle is comes from ``SLOTS`` counters that
all texts add to (``_commonness``): a fixed size for any corpus, and a shingle that shares its counter with another is only put later. Thus a footer of
many texts is nobody's file unless it is most of the text. Texts of one file are compared by size, by the parities of their
shingles in 512 classes and then by the shingles; the first two refuse no similar pair. Wanted are the components, not all pairs: where a file has more than ``crowd``
texts, each text is first compared with its best centre, then with a centre by chance in each of its files, and what that connects
needs no further look. After at most ``TURNS`` such turns all pairs of a file that are not connected yet are compared, so the result is exact.
A file of m texts that stay apart costs m * m / 2 comparisons of sizes and parities within one join; that takes m texts whose shingles are nearly all common.

Null or empty texts have fingerprint 0 and are linked like any other. Null ids take part and get
their component's smallest id (null if it has none). Repeated rows are kept by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featherloom.llm.components import components
from featherloom.llm.tables import fresh, only, stored
from featherloom.llm.words import LOWER, SPACE, Block, blocks, prefix_hashes, run_hashes, run_starts, span_hashes, tidied, word_spans

SEED = 42
MAX_BITS = 2
CROWD = 32
SIMILAR_CROWD = 16
PARITY = 512
WIDE, LONG = 4096, 700
TURNS, FEW = 4, 0.01
SLOTS = 1 << 18
_VOTES = 1 << 16


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _fingerprints(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    low = LOWER[data]
    gap = SPACE[data]
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i in range(len(out)):
        row, space = low[offsets[i]: offsets[i + 1]], gap[offsets[i]: offsets[i + 1]]
        if not len(row) or space.all():
            continue
        # One space between words, none around them.
        keep = ~space
        first_gap = np.zeros(len(row), bool)
        first_gap[1:] = space[1:] & ~space[:-1]
        row = np.where(space, np.uint8(32), row)[keep | first_gap]
        if row[-1] == 32:
            row = row[:-1]
        text = row.tobytes()
        cuts = np.flatnonzero(row == 32)
        count = len(cuts) + 1
        if count <= words:
            out[i] = xxh64_intdigest(text, SEED)
            continue
        starts = [0, *(cuts + 1)[: count - words].tolist()]
        ends = [*cuts[words - 1:].tolist(), len(text)]
        votes = np.zeros(64, np.int64)
        for k in range(0, len(starts), _VOTES):  # bounded memory for very long texts
            h = np.array([xxh64_intdigest(text[s:e], SEED) for s, e in zip(starts[k: k + _VOTES], ends[k: k + _VOTES])], np.uint64)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * votes > len(starts), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, text):
                prints = _fingerprints(b.data, b.offsets, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.first, b.rows), pa.array(prints)], ["doc_id", "fingerprint"])

    return only(docs, "doc_id", text).mapInArrow(tidied(run), "doc_id long, fingerprint long")


def close_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose graph has the components of all pairs at two or fewer different bits."""
    cuts = [64 * i // (MAX_BITS + 2) for i in range(MAX_BITS + 3)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    pairs = [x | y for x, y in combinations(masks, 2)]
    fp = F.col("fingerprint")
    filed = prints.select(
        "fingerprint", F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(pairs)])).alias("file")
    ).select("fingerprint", "file.pair", "file.bits")
    filed = stored(filed, "files")
    sizes = filed.groupBy("pair", "bits").count().filter("count > 1")
    filed = filed.join(sizes, ["pair", "bits"])

    few = filed.filter(F.col("count") <= crowd)
    left = few.select("pair", "bits", F.col("fingerprint").alias("a"))
    right = few.select(F.col("pair").alias("p"), F.col("bits").alias("q"), F.col("fingerprint").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    links = left.join(right, (F.col("pair") == F.col("p")) & (F.col("bits") == F.col("q")) & (F.col("a") < F.col("b")) & close).select("a", "b")
    flips = [0, *(_signed(1 << i) for i in range(64))]
    met = filed.filter(F.col("count") > crowd).select("pair", "bits", "fingerprint", F.explode(F.filter(
        F.array(*[F.lit(f) for f in flips]), lambda x: x.bitwiseAND(F.element_at(F.array(*[F.lit(_signed(m)) for m in pairs]), F.col("pair") + 1)) == 0)).alias("flip"))
    met = met.select(fp.bitwiseXOR(F.col("flip")).alias("at"), "fingerprint").distinct()
    least = met.groupBy("at").agg(F.min("fingerprint").alias("least"), F.count("*").alias("n")).filter("n > 1")
    stars = met.join(least, "at").filter("fingerprint <> least").select(F.col("least").alias("a"), F.col("fingerprint").alias("b"))
    return links.unionByName(stars)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> 32) & (SLOTS - 1)


def _commonness(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """A class from 0 (at most as common as half of all) to 255 for each of the ``SLOTS`` counters of distinct shingles per text.

    Counters grow in eighths of powers of two over their median, so what many texts share stands out however large the corpus is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for b in blocks(batch):
                total += np.bincount(_slots(np.concatenate(_shingle_sets(b, width))), minlength=SLOTS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 14):
            some = at[k: k + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])

    counts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidied(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS, np.int64)
    total[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    over = np.maximum(total - int(np.median(total)), 0)
    return np.minimum(8 * np.log2(1 + over), 255).astype(np.uint8)


def _texts(docs: DataFrame, text: str, words: int, threshold: float | None, width: int) -> DataFrame:
    """(doc_id, key, fingerprint, size, prefix, bits) of every row: ``key`` stands for the text, ``size`` is its number of distinct shingles,
    ``prefix`` the first of them, rare ones first, one of which any similar text has among its own first, and bit i of ``bits`` the parity of those that fall on i.
    ``wide`` is the same for long texts in more classes. Without a threshold the last four are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                if threshold is None:
                    prints = pa.array(_fingerprints(b.data, b.offsets, words).view(np.int64))
                    none = [pa.nulls(b.rows, t) for t in (pa.int64(), *[pa.list_(pa.int64())] * 3)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(b.first, b.rows) for c in ("doc_id", "key")), prints, *none], names)
                    continue
                sets = _shingle_sets(b, width)
                heads = [h[np.argsort(common[_slots(h)], kind="stable")[: len(h) - math.ceil(threshold * len(h) - 1e-9) + 1]] for h in sets]
                wide = pa.array([_parity(h, WIDE) if len(h) > LONG else None for h in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(b.first, b.rows) for c in ("doc_id", "key")), pa.array(_fingerprints(b.data, b.offsets, words).view(np.int64)),
                     pa.array([len(h) for h in sets], pa.int64()), _lists(heads), _lists([_parity(h, PARITY) for h in sets]), wide], names)

    common = None if threshold is None else _commonness(docs, text, width)
    names = ["doc_id", "key", "fingerprint", "size", "prefix", "bits", "wide"]
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"), _key(text).alias("key"))
    return rows.mapInArrow(tidied(run), "doc_id long, key long, fingerprint long, size long, prefix array<long>, bits array<long>, wide array<long>")


def _parity(h: np.ndarray, classes: int) -> np.ndarray:
    return np.packbits(np.bincount(h & (classes - 1), minlength=classes) & 1, bitorder="little").view(np.int64)


def _key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _shingle_sets(b: Block, width: int) -> list[np.ndarray]:
    low = LOWER[b.data]
    starts, ends, first = word_spans(low, b.offsets)
    runs = run_starts(len(starts), first, width)
    h = run_hashes(span_hashes(prefix_hashes(low), starts, ends), runs, width).view(np.int64)
    at = np.searchsorted(runs, first)
    return [np.unique(h[at[k]: at[k + 1]]) for k in range(b.rows)]


def _shingled(texts: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of texts of (key, text); shingles are distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(b.first, b.rows), _lists(_shingle_sets(b, width))], ["key", "shingles"])

    return texts.mapInArrow(tidied(run), "key long, shingles array<long>").groupBy("key").agg(F.min("shingles").alias("shingles"))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts have a Jaccard similarity of ``threshold`` or more; ``docs``: (key, text)."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = stored(_shingled(docs.join(wanted, "key", "left_semi"), width), "shingles")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("right")), "b")
    common = F.size(F.array_intersect("left", "right"))
    return both.filter((common > 0) & (common >= threshold * (F.size("left") + F.size("right") - common))).select("a", "b")


def similar_links(docs: DataFrame, classes: DataFrame | None, words: int, threshold: float, width: int = 5, crowd: int = SIMILAR_CROWD) -> DataFrame:
    """Links (a, b) between the fingerprints of similar texts, with the components of all similar pairs; ``docs``: (doc_id, text). ``classes`` is not read."""
    return _similar_links(docs, stored(_texts(docs, "text", words, threshold, width), "texts"), threshold, width, crowd)


def _similar_links(docs: DataFrame, texts: DataFrame, threshold: float, width: int = 5, crowd: int = SIMILAR_CROWD) -> DataFrame:
    docs = docs.select(_key("text").alias("key"), "text")
    texts = stored(texts.filter("size > 0").drop("doc_id").dropDuplicates(["key"]), "distinct-texts")
    keys = texts.select("key", "fingerprint")
    filed = texts.select("key", F.explode("prefix").alias("file"))
    sizes = filed.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1")
    filed = stored(filed.join(sizes, "file"), "shared-shingles")
    # A text with many shingles that many others have is a good centre: the original of its variants.
    scores = filed.groupBy("key").agg(F.sum("n").alias("score"))
    scores = texts.select("key", F.size("prefix").alias("length")).join(scores, "key").select("key", (F.col("score") / F.col("length")).alias("score"))
    filed = filed.select("file", "key").join(scores, "key").withColumn("root", F.col("key"))

    # The parities differ in no more bits than the sets in shingles, so this refuses no similar pair.
    apart = sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("other")["bits"][i])) for i in range(PARITY // 64))
    sizes, parts = F.col("size") + F.col("other")["size"], (1 - threshold) / (1 + threshold)
    may = (F.least("size", F.col("other")["size"]) >= threshold * F.greatest("size", F.col("other")["size"]) - 1e-6) & (apart <= parts * sizes + 1e-6)
    wide = F.aggregate(F.zip_with("wide", F.col("other")["wide"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    both = may & F.coalesce(wide <= parts * sizes + 1e-6, F.lit(True))
    about = texts.select("key", "size", "bits", "wide")
    other = about.select(F.col("key").alias("b"), F.struct("size", "bits", "wide").alias("other"))
    found, turn = None, 0
    while True:
        if turn:
            files = filed.groupBy("file").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
            filed = filed.join(files, "file", "left_semi")
        filed = stored(filed, "files")
        most = filed.groupBy("file").count().agg(F.max("count")).first()[0]
        if most is None:
            break
        last = turn == TURNS or most <= crowd
        if last:
            # All pairs that are not yet connected.
            whole = filed.join(texts.select("key", "size", "bits"), "key")
            others = whole.select(F.col("file").alias("same"), F.struct("key", "size", "bits", "root").alias("other"))
            pairs = whole.join(others, (F.col("file") == F.col("same")) & (F.col("key") < F.col("other")["key"]) & (F.col("root") != F.col("other")["root"]) & may)
            pairs = pairs.select("key", F.col("other.key").alias("b")).distinct()
        else:
            # First every text with its best centre, then with a centre of each file by chance.
            by = [F.col("score"), F.col("key")] if turn == 0 else [F.xxhash64("key", "file", F.lit(turn)), F.col("score"), F.col("key")]
            centres = filed.groupBy(F.col("file").alias("same")).agg(F.max(F.struct(*(c.alias(f"c{i}") for i, c in enumerate([*by, F.col("root")])))).alias("c"))
            centres = centres.select("same", F.col(f"c.c{len(by) - 1}").alias("centre"), F.col(f"c.c{len(by) - 2}").alias("centre_score"), F.col(f"c.c{len(by)}").alias("centre_root"))
            pairs = filed.join(centres, (F.col("file") == F.col("same")) & (F.col("root") != F.col("centre_root")))
            if turn == 0:
                pairs = pairs.groupBy("key").agg(F.max(F.struct("centre_score", "centre")).alias("c")).select("key", "c.centre")
            pairs = pairs.select(F.least("key", "centre").alias("key"), F.greatest("key", "centre").alias("b")).distinct()
        pairs = stored(pairs.join(about, "key").join(other, "b").filter(both).select(F.col("key").alias("a"), "b"), "candidates")
        links = stored(_verified(pairs, docs, width, threshold), "similar")
        found = links if found is None else found.unionByName(links)
        if last:
            break
        roots = components(found).select(F.col("node").alias("key"), F.col("root").alias("now"))
        filed = filed.join(roots, "key", "left").select("file", "key", "score", F.coalesce("now", "key").alias("root"))
        # A turn that connects next to nothing is the last of its kind.
        turn = turn + 1 if turn == 0 or links.count() > FEW * most else TURNS
    prints = keys.select(F.col("key"), "fingerprint")
    if found is None:
        return prints.limit(0).select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"))
    for side in ("a", "b"):
        found = found.join(prints.select(F.col("key").alias(side), F.col("fingerprint").alias(f"print_{side}")), side)
    return found.filter("print_a <> print_b").select(F.least("print_a", "print_b").alias("a"), F.greatest("print_a", "print_b").alias("b")).distinct()


def _classes(docs: DataFrame, text: str, words: int, threshold: float | None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, fingerprint) and fingerprints (fingerprint, root, first): ``first`` is the first of a fingerprint's rows by id (null last) and text."""
    prints = stored(_texts(docs, text, words, threshold, 5), "texts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = stored(prints.groupBy("fingerprint").agg(first), "classes")
    links = close_links(classes.select("fingerprint"))
    if threshold is not None:
        links = links.unionByName(_similar_links(docs.select(F.col(f"`{text}`").alias("text")), prints, threshold))
    roots = components(links)
    return prints, classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 3, threshold: float | None = None) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), one row per row of ``docs``. With a ``threshold``, texts whose five-word shingles are that similar are linked as well."""
    prints, classes = _classes(docs, text, words, threshold)
    names = classes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = classes.join(names, "root").select(F.col("fingerprint").alias("print"), "component_id")
    out = prints.join(named, F.col("fingerprint") == F.col("print"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, text: str = "text", words: int = 3, threshold: float | None = None) -> DataFrame:
    """Of each component one row, all columns: the one with the smallest id (null last), of several the one whose text hashes lowest. Other rows with its id stay or go by their own component."""
    _, classes = _classes(docs, text, words, threshold)
    first = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
    # Rows equal in id and text are of one component; one of them stays.
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["first_id"]) & (_key(text) == first["first_key"]), "left_semi")
    plain = [f"`{f.name}`" for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rank = F.row_number().over(Window.partitionBy("doc_id", _key(text)).orderBy(F.xxhash64(*plain)))
    number = fresh(docs, "rank")
    return kept.withColumn(number, rank).filter(F.col(number) == 1).drop(number)
