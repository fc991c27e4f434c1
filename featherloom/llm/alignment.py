"""Tokens of two public vocabularies aligned over the bytes of a text.

A is a byte-level vocabulary read by ``tokenizers``, B a piece vocabulary with byte fallback read by ``sentencepiece``.
Both give spans: A character offsets, B the spans of its proto (``SentencePieceText``; the immutable proto of
earlier releases no longer exists). A span that ends on a character of its own is a cut as it stands. Tokens
that share a character (parts of a multibyte character, byte-fallback pieces) have no span of their own; their
ends are counted from the last such cut with the decoded bytes of the tokens. Byte offsets where tokens of
both end cut the text into groups; tokens whose byte ranges overlap are linked.

Texts are handled in units: a text is cut before a single space between two characters that are not white
space. Neither vocabulary joins anything over such a place (A's pattern starts a pre-token there; no piece
of B holds a space after another character, which is checked when the model is loaded), so both have a cut
there and units are independent. Units seen before are remembered in bounded memory; new ones of
many texts are tokenised together. A long text is read in stretches, so a worker holds one stretch and the distinct links of one text.

How many documents hold a pair is counted over all documents. The pairs held most often, at most
``FREQUENT`` of them, are broadcast; links of all others are joined by pair. Nothing is left out.

Null and empty texts, and texts whose joined bytes differ from space + text under either vocabulary (such as those
that hold U+2581), have no tokens: zeros and an empty string. Repeated rows count as documents of their own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.bpe import _byte_letters
from featherloom.llm.tables import only, stored
from featherloom.llm.words import blocks, tidied

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

FREQUENT = 1 << 18  # pairs broadcast, 17 bytes each
MEMORY = 96 << 20  # bytes of units remembered by a Python worker; those seen least are forgotten first
UNIT_LENGTH = 64  # characters of the longest unit that is kept when memory is made free
STRETCH = 1 << 20  # characters of a text handled at a time
SPLIT = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Tokens:
    """Ids and byte ends of one text's tokens under one vocabulary."""

    ids: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([np.zeros(min(1, len(self.ends)), np.int64), self.ends[:-1]])


@dataclass
class Alignment:
    """Groups by the last token of each side (exclusive), links by the numbers of their tokens."""

    a: Tokens
    b: Tokens
    cuts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def pairs(self) -> np.ndarray:
        return (self.a.ids[self.link_a] << 32) | self.b.ids[self.link_b]


def _refined(coarse: np.ndarray, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends: the coarse ones where a token's span is its ``own``, between them counted on with the decoded lengths."""
    run = np.cumsum(lengths)
    at = np.where(own, np.arange(len(own)), -1)
    last = np.maximum.accumulate(at) if len(at) else at
    base = np.where(last >= 0, coarse[last] - run[last], 0) if len(at) else run
    return np.where(own, coarse, base + run)


class Aligner:
    """Both vocabularies; ``align`` gives None for a text whose bytes either of them does not keep."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.is_byte = np.array([self.b.is_byte(i) for i in range(size_b)])
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: An id as it stands inside and at the end of its side of a group.
        self.inside_a, self.last_a = (np.array([f"{i}{x}" for i in range(size_a)], object) for x in ",|")
        self.inside_b, self.last_b = (np.array([f"{i}{x}" for i in range(size_b)], object) for x in ",;")
        self.independent = not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.is_byte[i])

    def units(self, text: str) -> list[str]:
        return SPLIT.split(text) if self.independent else [text]

    def _tokens_a(self, text: str, data: bytes) -> Tokens | None:
        found = self.a.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        if b"".join([self.bytes_a[i] for i in found.ids]) != data:
            return None
        begin, end = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2).T
        own = np.append(begin[1:] >= end[:-1], True)[: len(ids)]  # the next token starts after this one's last character
        if len(text) == len(data):
            coarse = end
        else:
            at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
            coarse = at[end]
        return Tokens(ids, _refined(coarse, own, self.length_a[ids]))

    def _tokens_b(self, text: str, data: bytes) -> Tokens | None:
        """Spans of B are in bytes of ``text``, which lacks the leading space."""
        pieces = self.b.encode(text, return_type="proto").pieces
        ids, begin, end = np.array([x for p in pieces for x in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3).T
        if b"".join([self.bytes_b[i] for i in ids.tolist()]) != data:
            return None
        return Tokens(ids, _refined(end + 1, (end > begin) & ~self.is_byte[ids], self.length_b[ids]))

    def align(self, text: str) -> Alignment | None:
        """The alignment of space + ``text``."""
        data = (" " + text).encode()
        b = self._tokens_b(text, data)
        a = self._tokens_a(" " + text, data) if b else None
        if a is None or b is None:
            return None
        cuts = np.intersect1d(a.ends, b.ends, assume_unique=True)
        first = np.searchsorted(b.ends, a.starts, "right")
        n = np.searchsorted(b.starts, a.ends, "left") - first
        link_a = np.repeat(np.arange(len(n)), n)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return Alignment(a, b, cuts, link_a, link_b)


    def written(self, found: Alignment) -> list[str]:
        """The tokens of all groups in order, each with what follows it: ``1,`` ``2|`` ``3;``."""
        ga, gb = np.searchsorted(found.cuts, found.a.ends, "left"), np.searchsorted(found.cuts, found.b.ends, "left")
        end_a, end_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        a = np.where(end_a, self.last_a[found.a.ids], self.inside_a[found.a.ids])
        b = np.where(end_b, self.last_b[found.b.ids], self.inside_b[found.b.ids])
        return np.concatenate([a, b])[np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")].tolist()

    def groups(self, found: Alignment) -> str:
        return "".join(self.written(found))[:-1]


class Units:
    """What documents need of units already seen, as columns: counts, groups as text, linked pairs end to end.

    A unit that cannot be aligned has counts of -1.
    """

    def __init__(self, aligner: Aligner, memory: int = MEMORY):
        self.aligner, self.memory = aligner, memory
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((3, 0), np.int64)
        self.at = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)
        self.size = 0

    def learn(self, texts: list[list[str]]) -> None:
        """Tokenise the units of ``texts`` that are new, all together where they start and end with a character that is not white space."""
        if self.size > self.memory:
            self._forget()
        known = self.number
        new = list({u for units in texts for u in units if u not in known})
        plain = [u for u in new if u and not u[0].isspace() and not u[-1].isspace()]
        together = self.aligner.align(" ".join(plain)) if plain and self.aligner.independent else None
        if together is None:
            plain = []
        else:
            ends = np.cumsum([len(u.encode()) + 1 for u in plain])
            to_a, to_b, to_g = (np.searchsorted(x, ends, "right") for x in (together.a.ends, together.b.ends, together.cuts))
            to_l = np.searchsorted(together.link_a, to_a, "left")
            text, to_t = self.aligner.written(together), (to_a + to_b).tolist()
            self._add(plain, np.diff([to_a, to_b, to_g], axis=1, prepend=0), ["".join(text[i:j])[:-1] for i, j in zip([0, *to_t], to_t)], together.pairs(), np.diff(to_l, prepend=0))
        for u in set(new).difference(plain):
            found = self.aligner.align(u)
            if found is None:
                self._add([u], np.full((3, 1), -1), [""], np.zeros(0, np.int64), np.zeros(1, np.int64))
            else:
                pairs = found.pairs()
                self._add([u], np.array([[len(found.a.ids)], [len(found.b.ids)], [len(found.cuts)]]), [self.aligner.groups(found)], pairs, np.array([len(pairs)]))

    def _add(self, units: list[str], counts: np.ndarray, groups: list[str], pairs: np.ndarray, lengths: np.ndarray) -> None:
        self.number.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        self.groups += groups
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.hits = np.concatenate([self.hits, np.zeros(len(units), np.int64)])
        self.size += 250 * len(units) + 8 * len(pairs) + sum(map(len, groups)) + sum(map(len, units))

    def _forget(self) -> None:
        """Keep units seen again, the most frequent first, in a third of the memory."""
        units = list(self.number)
        each = np.array([250 + len(u) + len(g) for u, g in zip(units, self.groups)]) + 8 * np.diff(self.at)
        order = np.argsort(-self.hits, kind="stable")
        stay = order[(np.cumsum(each[order]) <= self.memory // 3) & (self.hits[order] > 1)].tolist()
        stay = [i for i in stay if len(units[i]) <= UNIT_LENGTH]
        kept, lengths = (self.counts[:, stay], [self.groups[i] for i in stay], self._links(np.array(stay, np.int64))), np.diff(self.at)[stay]
        hits = self.hits[stay] // 2
        self.__init__(self.aligner, self.memory)
        self._add([units[i] for i in stay], *kept, lengths)
        self.hits = hits

    def _links(self, numbers: np.ndarray) -> np.ndarray:
        n = self.at[numbers + 1] - self.at[numbers]
        return self.pairs[np.repeat(self.at[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def of(self, units: list[str]) -> tuple[np.ndarray, str, np.ndarray] | None:
        """(n_a, n_b, n_groups), groups and linked pairs of known units, in their order."""
        numbers = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        np.add.at(self.hits, numbers, 1)
        counts = self.counts[:, numbers]
        if (counts < 0).any():
            return None
        return counts.sum(axis=1), ";".join(map(self.groups.__getitem__, numbers.tolist())), self._links(numbers)


@lru_cache(maxsize=1)
def _units(path_a: str, path_b: str) -> Units:
    return Units(Aligner(path_a, path_b))


def _stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cut at unit borders, each border's space left out."""
    at = 0
    while len(text) - at > size:
        cut = SPLIT.search(text, at + size)
        if cut is None:
            break
        yield text[at: cut.start()]
        at = cut.end()
    yield text[at:]


def _aligned(texts: list[str], units: Units) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, a, b, times) of each text."""
    whole = units.aligner.independent
    short = [None if not t or "▁" in t or len(t) > STRETCH else units.aligner.units(t) for t in texts]
    units.learn([parts for parts in short if parts])
    out = []
    for text, parts in zip(texts, short):
        good, counts, n_links, digest = bool(text) and "▁" not in text, np.zeros(3, np.int64), 0, hashlib.sha256()
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, stretch in enumerate([text] if parts or not good or not whole else _stretches(text)):
            if not good:
                break
            if parts is None:
                units.learn([own := units.aligner.units(stretch)])
            found = units.of(own if parts is None else parts)
            if found is None:
                good = False
                break
            counts += found[0]
            digest.update((";" * bool(i) + found[1]).encode())
            n_links += len(found[2])
            new, n = np.unique(found[2], return_counts=True)
            if i:
                new, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                n = np.bincount(back, np.concatenate([times, n])).astype(np.int64)
            keys, times = new, n
        if good:
            out.append((*counts.tolist(), n_links, digest.hexdigest(), (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)))
        else:
            none = np.zeros(0, np.int32)
            out.append((0, 0, 0, 0, "", none, none, none))
    return out


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def document_links(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Per row counts, the digest of its groups and its distinct linked pairs (a, b) with their number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(path_a, path_b)
        for batch in batches:
            for b in blocks(batch, text):
                data = b.data.tobytes()
                texts = [data[s:e].decode("utf-8", "replace") for s, e in zip(b.offsets.tolist(), b.offsets[1:].tolist())]
                columns = list(zip(*_aligned(texts, units)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.first, b.rows), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), *[_list_array(list(c)) for c in columns[5:]]],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
                )

    return only(docs, "doc_id", text).mapInArrow(tidied(run), _ROW)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all rows of a batch as one number each, and where each row's start."""
    a, b = batch.column("a"), batch.column("b")
    sizes = np.asarray(pa.compute.list_value_length(a)).astype(np.int64)
    return (np.asarray(a.flatten()).astype(np.int64) << 32) | np.asarray(b.flatten()).astype(np.int64), np.cumsum(np.append(0, sizes))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold a pair, and whether no pair of the same A id is held by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        for batch in batches:
            held.append(_keys(batch)[0])
            size += len(held[-1])
            if size > 1 << 21:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = stored(links.select("a", "b").mapInArrow(tidied(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("id")).agg(F.max("n").alias("most"))
    return stored(counts.join(most, F.shiftright("pair", 32) == F.col("id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _frequent(pairs: DataFrame, limit: int) -> tuple[int, pa.Table]:
    """A count from which on at most ``limit`` pairs stand, and these pairs: a threshold from a histogram of counts, no sort."""
    steps = {r["step"]: r["pairs"] for r in pairs.groupBy(F.floor(8 * F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("pairs")).collect()}  # at most 8 * 63 rows
    total, least = 0, None
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > limit:
            break
        least = step
    top = pairs.filter(F.floor(8 * F.log2("n")) >= (1 << 30 if least is None else least)).toArrow()
    return least, top


def align_corpus(docs: DataFrame, path_a: str, path_b: str, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``."""
    links = stored(document_links(docs, path_a, path_b, text).withColumn("uid", F.monotonically_increasing_id()), "links")
    pairs = pair_counts(links)
    least, top = _frequent(pairs, frequent)
    order = np.argsort(top["pair"].to_numpy())
    known, counts, best = top["pair"].to_numpy()[order], top["n"].to_numpy()[order], top["best"].to_numpy()[order].astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((known, counts, best))  # at most ``frequent`` pairs
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def sums(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for batch in batches:
            keys, at = _keys(batch)
            times = np.asarray(batch.column("times").flatten()).astype(np.int64)
            place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
            if rest:
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))[~hit]
                yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(row)), pa.array(keys[~hit]), pa.array(times[~hit])], ["uid", "pair", "times"])
                continue
            each = np.zeros((2, len(keys) + 1), np.int64)
            if len(known):
                np.cumsum(np.where(hit, times * best[place], 0), out=each[0, 1:])
                np.cumsum(np.where(hit, times * counts[place], 0), out=each[1, 1:])
            found = [pa.array(e[at[1:]] - e[at[:-1]]) for e in each]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), *[batch.column(c) for c in plain], *found], ["uid", *plain, "n_best", "count_sum"])

    schema = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    whole = links.select("uid", *plain, "a", "b", "times").mapInArrow(lambda batches: sums(batches, False), schema)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rare = pairs.filter(F.floor(8 * F.log2("n")) < (1 << 30 if least is None else least))
    if not rare.limit(1).count():
        return whole.select(*columns)
    other = links.select("uid", "a", "b", "times").mapInArrow(lambda batches: sums(batches, True), "uid long, pair long, times long")
    other = other.join(rare, "pair").groupBy("uid").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    joined = whole.join(other, "uid", "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*columns)
