"""Repeated substrings of a whole corpus: anchored contexts, ordered column by column.

A byte is removed if it lies in a string of ``length`` bytes that starts anywhere else as well, in the same
or another document. All strings are judged on the input. Results are exact up to 64-bit hashes taken in pairs.

Which strings can be equal. Every window of ``length`` bytes has an anchor: of its 48-byte grams the one with
the smallest hash, the leftmost of equals. That choice reads the window only, so equal windows have equal
grams at equal distance. Windows in a row with one anchor form a context: the bytes they cover, aligned at the
anchor. Contexts are counted per gram (one small row each, no text moves). A gram seen once holds nothing repeated; a gram
whose contexts are all equal and which was seen twice is repeated as a whole. Only for the remaining grams
one copy of each distinct context is cut out of its document. Periodic stretches give one context and the length of the stretch.

Column-wise construction. The contexts of a partition are a collection of short documents of at most
352 bytes, aligned at their anchors. As in the insertion of one symbol per document and round into a
collection's Burrows-Wheeler transform, columns are taken from the last to the first: each round reads
one column from a sequential temporary file, takes the symbols in the current suffix order (that
round's column of the transform), sorts them stably, which gives the order of the suffixes one symbol longer,
and updates the common prefixes of neighbours by range minima. A window is repeated if it shares
``length`` symbols with a neighbour. Suffixes of different columns need no common order here, since equal
windows stand in equal columns: that makes the rounds independent of the length of documents, where inserting one symbol per whole
document would need as many rounds over the whole corpus as the longest document has bytes.

A gram with more than ``crowd`` distinct contexts is not put into one task: its windows are counted by
digest instead, spread over all tasks.

A row is known by its id and a 64-bit hash of its text, one without an id by two such hashes.
Rows with equal id and text count as repeats of each other. Null texts are empty; null ids are allowed.
Texts shorter than ``length`` have no string to judge. Partial characters at the edge of a removed
span are left out of the text that is kept.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.tables import only, partitions, stored
from featherloom.llm.words import blocks, mixed, prefix_hashes, span_hashes, tidied

LENGTH = 200
GRAM = 48
CROWD = 4096
NO_ID = "no id"  # makes the second hash of a text without an id another one
_TEXT = 1 << 18  # bytes of text handled at a time; the numbers about them take some hundred times as much
_LOW = np.uint64((1 << 31) - 1)
_FAR = np.iinfo(np.int64).max


def _contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """One entry per context (equal ones in a row once): row, key, digest, first window, distance to the anchor, windows, reach and number."""
    width = length - GRAM + 1
    valid = np.zeros(len(data) + 1, np.int8)
    rows = np.flatnonzero(np.diff(offsets) >= length)
    if not len(rows):
        return None
    np.add.at(valid, offsets[rows], 1)
    np.add.at(valid, offsets[rows + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]))
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = span_hashes(prefix, at, at + GRAM)
    # Smallest of ``width`` neighbours by running minima from both ends of blocks of that size.
    value = np.full(-(-len(gram) // width) * width + width, np.uint64(0xFFFFFFFFFFFFFFFF))
    value[: len(gram)] = (gram & ~_LOW) | at.astype(np.uint64)
    table = value.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[starts], ahead[starts + width - 1]) & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    cut = np.flatnonzero(new)
    first, p = starts[cut], anchor[cut]
    windows = np.diff(np.append(cut, len(starts)))
    key = gram[p]
    back = p - first
    digest = mixed(span_hashes(prefix, first, first + windows - 1 + length) + (back * 1024 + windows).astype(np.uint64))
    row = np.searchsorted(offsets, first, "right") - 1
    same = np.zeros(len(cut), bool)
    same[1:] = (row[1:] == row[:-1]) & (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
    head = np.flatnonzero(~same)
    tail = np.append(head[1:], len(cut)) - 1
    return {
        "row": row[head], "key": key[head].view(np.int64), "digest": digest[head].view(np.int64), "first": first[head] - offsets[row[head]],
        "back": back[head], "windows": windows[head], "reach": first[tail] - first[head], "copies": tail - head + 1,
    }


_CONTEXT = "id long, part long, key long, digest long, first int, back int, windows int, reach int, copies int"


def _find_contexts(texts: DataFrame, length: int) -> DataFrame:
    names = ("key", "digest", "first", "back", "windows", "reach", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, limit=_TEXT):
                found = _contexts(b.data, b.offsets, length)
                if found is None:
                    continue
                rows = pa.array(found["row"] + b.first)
                columns = [batch.column("id").take(rows), batch.column("part").take(rows)]
                columns += [pa.array(found[n].astype(np.int64 if n in ("key", "digest") else np.int32)) for n in names]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", *names])

    return texts.mapInArrow(tidied(run), _CONTEXT)


def _cut_out(wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of contexts; ``wanted``: text and a list of structs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            per_row = np.diff(np.asarray(lists.offsets))
            items = lists.flatten()
            names = ("key", "digest", "back", "windows", "total", "crowd")
            first, n = (np.asarray(items.field(c)) for c in ("first", "windows"))
            where = np.cumsum(np.append(0, per_row))
            for b in blocks(batch, limit=_TEXT):
                own = slice(where[b.first], where[b.last])
                if own.start == own.stop:
                    continue
                begin = first[own] + np.repeat(b.offsets[:-1], per_row[b.first: b.last])
                whole = b.data.tobytes()
                pieces = [whole[s: s + k] for s, k in zip(begin.tolist(), (n[own] + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays([*[items.field(c).slice(own.start, len(pieces)) for c in names], pa.array(pieces, pa.binary())], [*names, "bytes"])

    return wanted.mapInArrow(tidied(run), "key long, digest long, back int, windows int, total long, crowd long, bytes binary")


def repeated_windows(pieces: list[bytes], back: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For contexts aligned at their anchors: (context, first, last) of runs of windows that stand in another context too."""
    m = len(pieces)
    left = length - GRAM  # columns before the anchor
    columns = left + length
    begin = left - back
    sizes = np.array([len(p) for p in pieces])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    with tempfile.TemporaryFile() as file:
        # Column after column, the last first, in slices that bound the memory.
        step = max(1, (2 << 20) // max(m, 1))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        base = np.cumsum(np.append(0, sizes))[:-1] - begin
        for high in range(columns, 0, -step):
            cols = np.arange(high - 1, max(high - step, 0) - 1, -1)[:, None]
            inside = (cols >= begin) & (cols < begin + sizes)
            symbols = np.where(inside, flat[np.clip(base + cols, 0, len(flat) - 1)].astype(np.uint16) + 1, np.uint16(0))
            file.write(symbols.tobytes())
        file.seek(0)
        order = np.arange(m)
        apart = np.full(m, columns, np.int16)  # column in which a suffix first differs from the one before it
        levels = max(1, (m - 1).bit_length())
        for c in range(columns - 1, -1, -1):
            symbol = np.frombuffer(file.read(2 * m), np.uint16)[order]
            moved = np.argsort(symbol, kind="stable")
            low = [apart]
            for k in range(levels):
                prior, reach = low[-1], 1 << k
                low.append(np.minimum(prior[:-reach], prior[reach:]) if len(prior) > reach else prior[:0])
            ordered = symbol[moved]
            fresh = np.full(m, c, np.int16)
            pair = np.flatnonzero((ordered[1:] == ordered[:-1]) & (ordered[1:] > 0)) + 1
            a, z = moved[pair - 1] + 1, moved[pair]
            level = np.frexp((z - a + 1).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                now = level == k
                fresh[pair[now]] = np.minimum(low[k][a[now]], low[k][z[now] - (1 << k) + 1])
            order, apart = order[moved], fresh
            if c <= left:
                near = apart >= c + length
                near[:-1] |= apart[1:] >= c + length
                hit = order[near]
                hit = hit[(c >= begin[hit]) & (c < begin[hit] + windows[hit])]
                found.append((hit, c - begin[hit]))
    if not found:
        return np.zeros((0, 3), np.int64)
    who, window = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((window, who))
    who, window = who[by], window[by]
    if not len(who):
        return np.zeros((0, 3), np.int64)
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    return np.stack([who[head], window[head], window[np.append(head[1:], len(who)) - 1]], axis=1)


_TASK_BYTES = 24 << 20


def _ordered_columns(contexts: DataFrame, length: int) -> DataFrame:
    """(key, digest, lo, hi): runs of windows found in another context, keys never parted."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        runs = repeated_windows(t.column("bytes").to_pylist(), t.column("back").to_numpy().astype(np.int64), t.column("windows").to_numpy().astype(np.int64), length)
        rows = pa.array(runs[:, 0])
        key, digest = (t.column(c).combine_chunks().take(rows) for c in ("key", "digest"))
        return pa.RecordBatch.from_arrays([key, digest, pa.array(runs[:, 1].astype(np.int32)), pa.array(runs[:, 2].astype(np.int32))], ["key", "digest", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(b.nbytes for b in held) > _TASK_BYTES:
                # The last key may go on in this batch.
                last = held[-1].column("key")[-1].as_py()
                keys = batch.column("key").to_numpy()
                more = int((keys == last).argmin()) if not (keys == last).all() else len(keys)
                held.append(batch.slice(0, more))
                batch = batch.slice(more)
                if not batch.num_rows:
                    continue
                yield flush(held)
                held = []
            held.append(batch)
        if held:
            yield flush(held)

    n = 2 * partitions(contexts.sparkSession)
    return contexts.select("key", "digest", "back", "windows", "bytes").repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidied(run), "key long, digest long, lo int, hi int")


def _counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many contexts: every window by its digest."""
    each = contexts.select("key", "digest", F.posexplode(F.expr(f"transform(sequence(1, windows), i -> md5(substring(bytes, i, {length})))")).alias("lo", "window"))
    twice = each.groupBy("key", "window").count().filter("count > 1").select(F.col("key").alias("k"), F.col("window").alias("w"))
    return each.join(twice, (F.col("key") == F.col("k")) & (F.col("window") == F.col("w"))).select("key", "digest", F.col("lo").cast("int").alias("lo"), F.col("lo").cast("int").alias("hi"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(id, part, begin, finish) byte spans to remove, not merged, for texts of (id, part, text)."""
    found = stored(_find_contexts(texts, length), "contexts")
    grams = found.groupBy("key").agg(F.sum("copies").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b")).filter("n > 1")
    found = stored(found.join(grams.select("key", (F.col("a") != F.col("b")).alias("several")), "key"), "repeated-contexts")

    several = found.filter("several").groupBy("key", "digest").agg(
        F.sum("copies").alias("total"), F.min(F.struct("id", "part", "first", "back", "windows")).alias("one")
    )
    several = stored(several, "distinct-contexts")
    crowds = several.groupBy("key").agg(F.count("*").alias("crowd"))
    wanted = several.join(crowds, "key").groupBy(F.col("one.id").alias("w_id"), F.col("one.part").alias("w_part")).agg(
        F.collect_list(F.struct("key", "digest", "one.first", "one.back", "one.windows", "total", "crowd")).alias("wanted")
    )
    contexts = _cut_out(texts.join(wanted, (F.col("id") == F.col("w_id")) & (F.col("part") == F.col("w_part"))).select("text", "wanted"), length)
    contexts = stored(contexts, "context-bytes")
    runs = _ordered_columns(contexts.filter(F.col("crowd") <= crowd), length)
    if contexts.filter(F.col("crowd") > crowd).limit(1).count():
        runs = runs.unionByName(_counted_windows(contexts.filter(F.col("crowd") > crowd), length))
    # A context seen twice is repeated as a whole.
    runs = runs.unionByName(several.filter("total > 1").select("key", "digest", F.lit(0).alias("lo"), (F.col("one.windows") - 1).alias("hi")))
    # Joined run by run, a hot context's rows can be split; only a few runs belong to a context.
    partly = found.filter("several").join(runs, ["key", "digest"]).select(
        "id", "part", (F.col("first") + F.col("lo")).alias("begin"), (F.col("first") + F.col("reach") + F.col("hi") + length).alias("finish")
    )
    wholly = found.filter("not several").select("id", "part", F.col("first").alias("begin"), (F.col("first") + F.col("reach") + F.col("windows") - 1 + length).alias("finish"))
    return wholly.unionByName(partly)


def _merged(begin: np.ndarray, finish: np.ndarray) -> list[tuple[int, int]]:
    by = np.argsort(begin, kind="stable")
    begin, finish = begin[by], np.maximum.accumulate(finish[by])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > finish[:-1]
    head = np.flatnonzero(new)
    return list(zip(begin[head].tolist(), finish[np.append(head[1:], len(begin)) - 1].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", crowd: int = CROWD, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, *keep), one row per row of ``docs``; ``kept`` is null unless asked for."""
    texts = only(docs.withColumn("text", F.col(f"`{text}`")), "doc_id", "text", *keep)
    texts = texts.withColumns({"id": F.coalesce("doc_id", F.xxhash64(F.lit(NO_ID), "text")), "part": F.xxhash64("text"), "text": F.coalesce("text", F.lit(""))})
    spans = repeated_spans(texts.select("id", "part", "text"), length, crowd)
    spans = spans.groupBy(F.col("id").alias("s_id"), F.col("part").alias("s_part")).agg(F.collect_set(F.struct("begin", "finish")).alias("spans"))
    joined = texts.join(spans, (F.col("id") == F.col("s_id")) & (F.col("part") == F.col("s_part")), "left").select("doc_id", "text", "spans", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans").fill_null([]) if batch.column("spans").null_count == batch.num_rows else batch.column("spans")
            n = [0 if v is None else v for v in pa.compute.list_value_length(lists).to_pylist()]
            where = np.cumsum([0, *n])
            flat = lists.flatten()
            begin, finish = (np.asarray(flat.field(c)).astype(np.int64) for c in ("begin", "finish")) if len(flat) else (np.zeros(0, np.int64),) * 2
            for b in blocks(batch, limit=_TEXT):
                data = b.data.tobytes()
                out = []
                for k in range(b.rows):
                    whole = data[b.offsets[k]: b.offsets[k + 1]]
                    own = slice(where[b.first + k], where[b.first + k + 1])
                    removed = _merged(begin[own], finish[own]) if own.start < own.stop else []
                    if removed:
                        edges = [0, *(x for span in removed for x in span), len(whole)]
                        parts = [whole[s:e] for s, e in zip(edges[::2], edges[1::2])]
                        rest = b"".join(parts)
                    else:
                        parts, rest = [whole], whole
                    kept = "".join(p.decode("utf-8", "ignore") for p in parts) if with_text else None
                    out.append((len(whole), len(whole) - len(rest), len(removed), hashlib.sha256(rest).hexdigest(), kept))
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.first, b.rows), *[pa.array(c, t) for c, t in zip(columns, kinds)], *[batch.column(c).slice(b.first, b.rows) for c in keep]],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *keep],
                )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(tidied(run), schema)
