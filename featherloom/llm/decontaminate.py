"""Benchmark items inside documents: size-partitioned MinHash containment search, exact verification.

Words are runs of bytes other than white space, A-Z in lower case; a shingle is five words in a row.
An item is contained in a document if at least ``threshold`` of its distinct shingles are in it.
Items of fewer than five words have no shingle and are contained in nothing.

Items are partitioned by their number of shingles q into classes of doubling size. For a class up to u,
documents are seen as overlapping windows of 2u shingles that start every u shingles, so a passage of up to u
shingles is whole in some window and its similarity to the item is bounded below however long the document is.
Each of ``bands`` hash functions gives one band, the smallest hash of an item or window. An item wholly in a window of its class
has a similarity of 1/4 at least and shares a band with it with probability above 1 - 1e-15 (128 bands); at containment 0.8 the
bound is 1/6 and the probability 1 - 1e-10.

Windows are sketched where it can matter only: a band of a window equals an item's band just when the
item's smallest shingle lies in the window and nothing in the window hashes lower. So shingles of the text are looked up
among the items' smallest shingles, and only around those hits minima are taken. That gives the same pairs as sketching every window.

Every candidate pair is verified on the shingles themselves, over the whole document.

Items are handled in blocks of bounded size, one pass over the documents each; a block goes to the
tasks with the function. No shuffle; a document's result does not depend on any other. Null texts count as empty; items
with null text contain nothing; repeated items and documents keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.tables import only
from featherloom.llm.words import LOWER, blocks, mixed, prefix_hashes, run_hashes, run_starts, span_hashes, tidied, word_spans

WIDTH = 5
BANDS = 128
BLOCK_BYTES = 8 << 20


def _shingles(text: str) -> set[bytes]:
    words = text.encode().translate(bytes(LOWER)).split()
    return {b" ".join(words[i: i + WIDTH]) for i in range(len(words) - WIDTH + 1)}


class Items:
    """A block of items: their shingles and, for each class and band, the smallest shingle."""

    def __init__(self, items: list[tuple[int, str]], bands: int):
        self.ids = [i for i, _ in items]
        self.shingles = [_shingles(t or "") for _, t in items]
        self.salts = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        marks: dict[tuple[int, int], list[int]] = {}
        found: list[tuple[int, int, int, int]] = []  # shingle hash, class, band, item
        for n, shingles in enumerate(self.shingles):
            if not shingles:
                continue
            size = 1 << (len(shingles) - 1).bit_length()
            h = _hash_strings(sorted(shingles))
            least = h[np.argmin(mixed(h[:, None] ^ self.salts[None, :]), axis=0)]
            found += [(int(x), size, band, n) for band, x in enumerate(least)]
        self.entries: dict[int, list[tuple[int, int, int]]] = {}
        for x, size, band, n in found:
            self.entries.setdefault(x, []).append((size, band, n))
        self.known = np.array(sorted(self.entries), np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray) -> set[int]:
        """Numbers of the items that share a band with a window of a document with these shingle hashes."""
        out: set[int] = set()
        if not len(self.known):
            return out
        hits = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        for at in hits.tolist():
            for size, band, n in self.entries.get(int(h[at]), ()):
                if n in out:
                    continue
                own = mixed(h[at: at + 1] ^ self.salts[band])[0]
                for w in {at // size, max(at // size - 1, 0)}:
                    window = h[w * size: w * size + 2 * size]
                    if mixed(window ^ self.salts[band]).min() == own:
                        out.add(n)
                        break
        return out


def _hash_strings(strings: list[bytes]) -> np.ndarray:
    """Hashes of shingles, equal to those of the same words in a text."""
    out = np.zeros(len(strings), np.uint64)
    for i, s in enumerate(strings):
        data = np.frombuffer(s, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        out[i] = run_hashes(span_hashes(prefix_hashes(data), starts, ends), np.zeros(1, np.int64), WIDTH)[0]
    return out


def _search(items: Items, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(row, item number, containment) within a block of texts."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    if not len(starts):
        return []
    runs = run_starts(len(starts), first, WIDTH)
    h = run_hashes(span_hashes(prefix_hashes(low), starts, ends), runs, WIDTH)
    row_of = np.searchsorted(runs, first)
    touched = np.unique(np.searchsorted(row_of, np.flatnonzero(items.filter[(h >> np.uint64(44)).astype(np.int64)]), "right") - 1)
    out = []
    for r in touched.tolist():
        found = items.candidates(h[row_of[r]: row_of[r + 1]])
        if not found:
            continue
        words = low[offsets[r]: offsets[r + 1]].tobytes().split()
        wanted = set().union(*(items.shingles[n] for n in found))
        present = wanted.intersection(b" ".join(words[i: i + WIDTH]) for i in range(len(words) - WIDTH + 1))
        for n in sorted(found):
            share = len(items.shingles[n] & present) / len(items.shingles[n])
            if share >= threshold:
                out.append((r, n, share))
    return out


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in id order, in lists of at most ``limit`` bytes of text (a longer item alone)."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in only(items, "item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row["text"]) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, bands: int = BANDS, text: str = "text") -> DataFrame:
    """(doc_id, item_id, containment) for every document and item it contains."""
    docs = only(docs, "doc_id", text)
    out = None
    for block in item_blocks(items):
        found = _pass(docs, Items(block, bands), threshold, text, whole_rows=False)
        out = found if out is None else out.unionByName(found)
    return docs.select("doc_id").limit(0).withColumns({"item_id": F.lit(0).cast("long"), "containment": F.lit(0.0)}) if out is None else out


def _pass(docs: DataFrame, items: Items, threshold: float, text: str, whole_rows: bool) -> DataFrame:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, text):
                found = _search(items, b.data, b.offsets, threshold)
                rows = pa.array([b.first + r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), pa.array([items.ids[n] for _, n, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.float64())],
                    ["doc_id", "item_id", "containment"],
                )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for b in blocks(batch, text):
                keep[[b.first + r for r, _, _ in _search(items, b.data, b.offsets, threshold)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema) if whole_rows else docs.mapInArrow(pairs, "doc_id long, item_id long, containment double")


def without_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, bands: int = BANDS, text: str = "text") -> DataFrame:
    """The documents that contain no item, all columns."""
    for block in item_blocks(items):
        docs = _pass(docs, Items(block, bands), threshold, text, whole_rows=True)
    return docs
