"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted, deleted or replaced code point changes the counts of a word's letters by at most two in sum: a replacement adds
one letter and takes one away, an insertion adds one. Words of each length are the points of a k-d tree; a word searches the tree of
its own length with one letter up and one down, and the tree of the next length with one letter up. A search enters a box only if what
separates it from the box is within that budget. A replacement is searched from one of its two words only,
the one whose new letter is the greater. Candidates are verified by the order of their letters.

The upper levels of the trees are tables: a box with more than ``box`` words is split by the letter and count that halve it
best, until no box is larger or a box's words have all the same letters (such words are never one edit
apart). Searches go down the same tables level by level. Words and searches then meet by box, and a task
builds the lower levels of one box at a time in numpy, streaming its searches. The tables of a level are broadcast only
after a size check; no box is collected on the driver.

Words are the runs of the contract after its planted deletions. A null id is written as an empty text there.
Null and empty texts have no words; repeated rows count again. A table without words gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherloom.llm.tables import only, partitions, stored
from featherloom.llm.words import LOWER, blocks, tidied
from featherloom.operators.ordered import lookup_join

BOX = 50_000  # words of a box that a task searches
LEAF = 128  # words of a leaf inside a task
SEARCHES = 8192  # searches a task handles together
LEVEL = 4  # counts above are alike in the filter before verification
PAIRS = 1 << 21  # comparisons held at a time

RUNS = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, at_least: int = 3, length: int = 5, every: int = 97, text: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``length`` code points with at least ``at_least`` occurrences in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for b in blocks(batch, text):
                data = LOWER[b.data].tobytes()
                for k in range(b.rows):
                    found = Counter(RUNS.findall(data[b.offsets[k]: b.offsets[k + 1]].decode("utf-8", "replace")))
                    doc = "" if ids[b.first + k] is None else ids[b.first + k]
                    start = zlib.crc32(f"{doc}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % every:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= length:
                            held[word] += n
                if len(held) > 200_000:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return only(docs, "doc_id", text).mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


def _count(letter: Column) -> Column:
    """How often a word that a search stands for holds ``letter``."""
    own = F.length("word") - F.length(F.replace(F.col("word"), letter, F.lit("")))
    return own + F.coalesce((F.col("up") == letter).cast("int"), F.lit(0)) - F.coalesce((F.col("down") == letter).cast("int"), F.lit(0))


def _splits(points: DataFrame, box: int) -> DataFrame:
    """(length, cell, letter, cut) for every cell of more than ``box`` words that letters can tell apart: words with at
    most ``cut`` of the letter go left. Chosen is the most even split; equal ones by letter and cut."""
    sizes = points.groupBy("length", "cell").agg(F.count("*").alias("all")).filter(F.col("all") > box)
    letters = F.explode(F.array_distinct(F.split("word", ""))).alias("letter")
    large = lookup_join(points, sizes, ["length", "cell"], "inner").select("length", "cell", "all", "word", letters).filter("letter <> ''")
    own = (F.length("word") - F.length(F.replace("word", "letter", F.lit("")))).alias("count")
    held = large.select("length", "cell", "all", "letter", own).groupBy("length", "cell", "all", "letter", "count").agg(F.count("*").alias("rows"))
    above = Window.partitionBy("length", "cell", "letter").orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0)
    cuts = held.withColumn("right", F.sum("rows").over(above)).filter("right < all")  # words with fewer, none included, go left
    uneven = F.abs(2 * F.col("right") - F.col("all"))
    best = cuts.groupBy("length", "cell").agg(F.min(F.struct(uneven.alias("uneven"), F.col("letter").alias("letter"), (F.col("count") - 1).alias("cut"))).alias("best"))
    return best.select("length", "cell", "best.letter", "best.cut")


def boxes(words: DataFrame, box: int = BOX) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, length, cell) and the splits of each level; the cells of a level are told apart by the path to them."""
    points = stored(words.select("word", "n", F.length("word").alias("length"), F.lit("").alias("cell")), "points")
    levels: list[DataFrame] = []
    while True:
        splits = stored(_splits(points, box), "splits")
        if not splits.limit(1).count():
            return points, levels
        levels.append(splits)
        moved = lookup_join(points.withColumns({"up": F.lit(None).cast("string"), "down": F.lit(None).cast("string")}), splits, ["length", "cell"])
        side = F.when(F.col("letter").isNull(), F.lit("")).when(_count(F.col("letter")) > F.col("cut"), F.lit("1")).otherwise(F.lit("0"))
        points = stored(moved.select("word", "n", "length", F.concat("cell", side).alias("cell")), "points")


def searches(words: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(word, n, longer, length, cell): every box that a word one edit from ``word`` and not shorter can lie in.

    ``up`` and ``down`` are letters a search has already spent to enter a box, null while unspent; an insertion has nothing to take away.
    """
    out = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")).withColumn("length", F.length("word") + F.col("longer").cast("int"))
    out = out.withColumns({"cell": F.lit(""), "up": F.lit(None).cast("string"), "down": F.lit(None).cast("string")})
    for splits in levels:
        out = lookup_join(out, splits, ["length", "cell"])
        count, letter = _count(F.col("letter")), F.col("letter")

        def step(side: str, up: Column, down: Column) -> Column:
            return F.struct(F.lit(side).alias("side"), up.alias("up"), down.alias("down"))

        here = step(F.when(F.col("letter").isNull(), F.lit("")).when(count > F.col("cut"), F.lit("1")).otherwise(F.lit("0")), F.col("up"), F.col("down"))
        may_rise = F.col("up").isNull() & (count == F.col("cut")) & (F.col("down").isNull() | (letter > F.col("down")))
        may_fall = ~F.col("longer") & F.col("down").isNull() & (count == F.col("cut") + 1) & (F.col("up").isNull() | (letter < F.col("up")))
        other = F.when(may_rise, step(F.lit("1"), letter, F.col("down"))).when(may_fall, step(F.lit("0"), F.col("up"), letter))
        out = out.withColumn("to", F.explode(F.array_compact(F.array(here, other))))
        out = out.select("word", "n", "longer", "length", F.concat("cell", "to.side").alias("cell"), F.col("to.up").alias("up"), F.col("to.down").alias("down"))
    return out.select("word", "n", "longer", "length", "cell")


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


class Tree:
    """The lower levels of one box: leaves of a few words, their letter counts and the box around each.

    Counts are those of up to ``LEVEL`` occurrences of each letter that occurs in the box; what lies outside can only make words
    seem nearer, and candidates are verified in full.
    """

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n, self.codes = words, n, _codes(words)
        self.letters = np.unique(self.codes)
        self.counts = self._counted(self.codes)
        self.steps = [(j, v) for j in range(len(self.letters)) for v in range(1, LEVEL + 1) if (self.counts[:, j] >= v).any()]
        self.unary = self._unary(self.counts)

    def _counted(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(self.letters)), np.int16)
        where = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        known = self.letters[where] == codes
        row = np.broadcast_to(np.arange(len(codes))[:, None], codes.shape)
        np.add.at(out, (row[known], where[known]), 1)
        return np.minimum(out, LEVEL)

    def _unary(self, counts: np.ndarray) -> np.ndarray:
        """Counts as ones in a row per word: products of two rows are the letters they share."""
        return np.stack([(counts[:, j] >= v) for j, v in self.steps], axis=1).astype(np.float32) if self.steps else np.zeros((len(counts), 1), np.float32)

    def near(self, words: list[str], longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers (search, point) of words one edit apart; ``longer``: the points are one code point longer."""
        codes = _codes(words)
        counts, rises, falls = self._counted(codes), 1, 0 if longer else 1
        unary = self._unary(counts)
        zero = np.zeros(len(words), np.int16)
        todo = [(np.arange(len(self.words)), np.arange(len(words)), zero, zero, np.zeros(len(self.letters), np.int16), np.full(len(self.letters), LEVEL, np.int16))]
        while todo:
            points, wanted, up, down, low, high = todo.pop()
            split = self._split(points) if len(points) > LEAF else None
            if split is None:
                yield from self._compared(points, wanted, codes, unary, longer)
                continue
            j, cut = split
            right = self.counts[points, j] > cut
            c = counts[wanted, j]
            for side, new_low, new_high in ((~right, low[j], cut), (right, cut + 1, high[j])):
                # What the word lacks of, or has over, this box's counts of letter j, in place of that of the box before.
                u = up + np.maximum(new_low - c, 0) - np.maximum(low[j] - c, 0)
                d = down + np.maximum(c - new_high, 0) - np.maximum(c - high[j], 0)
                enter = (u <= rises) & (d <= falls)
                if enter.any():
                    lows, highs = low.copy(), high.copy()
                    lows[j], highs[j] = new_low, new_high
                    todo.append((points[side], wanted[enter], u[enter], d[enter], lows, highs))

    def _split(self, points: np.ndarray) -> tuple[int, int] | None:
        share = self.unary[points].sum(axis=0)
        even = np.where((share > 0) & (share < len(points)), np.abs(2 * share - len(points)), np.inf)
        best = int(np.argmin(even))
        return None if not np.isfinite(even[best]) else (self.steps[best][0], self.steps[best][1] - 1)

    def _compared(self, points: np.ndarray, wanted: np.ndarray, codes: np.ndarray, unary: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in range(0, len(points), PAIRS // 64):
            own = points[p: p + PAIRS // 64]
            for s in range(0, len(wanted), max(1, PAIRS // len(own))):
                some = wanted[s: s + max(1, PAIRS // len(own))]
                x, y = unary[some], self.unary[own]
                # A search may take one letter away (none if the points are longer): it shares the rest of its letters.
                i, k = np.nonzero(x @ y.T >= (x.sum(axis=1) - (0 if longer else 1))[:, None])
                i, k = some[i], own[k]
                for at in range(0, len(i), step := max(1, PAIRS // codes.shape[1])):
                    a, b = codes[i[at: at + step]], self.codes[k[at: at + step]]
                    if longer:
                        head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
                        tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                        right = head + tail >= a.shape[1]
                    else:
                        other = a != b
                        first = other.argmax(axis=1)[:, None]
                        right = (other.sum(axis=1) == 1) & (np.take_along_axis(a, first, 1) < np.take_along_axis(b, first, 1))[:, 0]
                    if right.any():
                        yield i[at: at + step][right], k[at: at + step][right]


_BOTH = "word string, near string, near_n long"


def _in_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole boxes, a box's points before its searches."""
    box, tree = None, None
    points: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    longer = False

    def found() -> Iterator[pa.RecordBatch]:
        nonlocal tree
        if held and points:
            tree = tree or Tree([w for w, _ in points], np.array([n for _, n in points], np.int64))
            words, counts = [w for w, _ in held], np.array([n for _, n in held], np.int64)
            for i, k in tree.near(words, longer):
                left, right = pa.array([words[x] for x in i], pa.string()), pa.array([tree.words[x] for x in k], pa.string())
                yield pa.RecordBatch.from_arrays([left, right, pa.array(tree.n[k])], ["word", "near", "near_n"])
                yield pa.RecordBatch.from_arrays([right, left, pa.array(counts[i])], ["word", "near", "near_n"])
        held.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("length", "cell", "kind", "word", "n")]
        for length, cell, kind, word, n in zip(*columns):
            if (length, cell) != box:
                yield from found()
                box, tree = (length, cell), None
                points.clear()
            if kind == 0:
                points.append((word, n))
                continue
            if held and ((kind == 2) != longer or len(held) >= SEARCHES):
                yield from found()
            longer = kind == 2
            held.append((word, n))
    yield from found()


def near_words(words: DataFrame, box: int = BOX) -> DataFrame:
    """(word, near, near_n) for every two words of ``words`` (word, n) one edit apart, in both directions; (word, n) are distinct."""
    points, levels = boxes(words, box)
    looking = searches(points.select("word", "n"), levels).withColumn("kind", F.when(F.col("longer"), 2).otherwise(1))
    rows = points.select("length", "cell", F.lit(0).alias("kind"), "word", "n").unionByName(looking.select("length", "cell", "kind", "word", "n"))
    placed = rows.repartition(4 * partitions(words.sparkSession), "length", "cell").sortWithinPartitions("length", "cell", "kind")
    return placed.mapInArrow(_in_boxes, _BOTH)


def forms(words: DataFrame, box: int = BOX, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) of ``words`` (word, n)."""
    near = near_words(words, box)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= times * F.col("n")
    joined = words.join(found, "word", "left")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
    )


def with_roots(found: DataFrame) -> DataFrame:
    """Add ``root``. A form is held ``times`` as often as its word, so chains are short; each round doubles the steps taken."""
    found = stored(found, "forms")
    steps = stored(found.select("word", F.col("form").alias("root")).filter("root is not null"), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.filter("moved").limit(1).count():
            return found.join(moved.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        steps = moved.select("word", "root")


def spelling_variants(docs: DataFrame, box: int = BOX, text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word."""
    words = stored(word_counts(docs, text=text), "words")
    return with_roots(forms(words, box)).select("word", "form", "root", "n", "n_near", "form_n")
