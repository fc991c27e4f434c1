"""Documents packed into sequences of fixed length: large items matched in pairs, small ones best-fit.

A document is its token ids and one end id. Only a document longer than ``capacity`` is cut: into
full pieces, with the shorter rest as its first piece.

The plan needs no more than the number of pieces of each length, at most ``capacity`` numbers. On that
histogram, pieces over a third of the capacity, at most two of which share a sequence, are matched
greedily: the longest with the longest that still fits beside it. Smaller pieces follow in descending length, each into
the fullest sequence with room (best fit); what finds none opens new sequences. Equal decisions are taken for
whole runs of sequences at once, so the plan is a list of runs whose size depends on the capacity only.

Pieces of one length are interchangeable. They are numbered without a global sort: a count for each
length and bucket, its running sum over the buckets, and a row number within a bucket. The number tells the run, hence sequence and offset.
A frequent length is spread over all buckets.

Null texts count as empty: one piece that holds the end id. Repeated rows are pieces of their own. An
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featherloom.llm.bpe import byte_level
from featherloom.llm.tables import only, partitions, stored
from featherloom.llm.words import blocks, tidied

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, text: str = "text") -> DataFrame:
    """One row per piece, not yet placed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(vocabulary)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for b in blocks(batch, text):
                data = b.data.tobytes()
                out: list[tuple] = []
                for k in range(b.rows):
                    tokens = np.append(encoder.ids(data[b.offsets[k]: b.offsets[k + 1]].decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                    cut = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
                    out += [(ids[b.first + k], n, s, e - s, zlib.crc32(tokens[s:e].tobytes())) for n, (s, e) in enumerate(zip(cut, cut[1:]))]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return only(docs, "doc_id", text).mapInArrow(tidied(run), PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, pieces, sequence, offset, each): pieces ``first`` onwards of a length go ``each`` at a time
    into the sequences from ``sequence`` on, side by side from ``offset``."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
    fresh = 0

    def put(length: int, pieces: int, sequence: int, offset: int, each: int = 1) -> None:
        runs.append((length, used[length], pieces, sequence, offset, each))
        used[length] += pieces
        left[length] -= pieces

    def leave(room: int, sequence: int, n: int) -> None:
        if room and n:
            gaps.setdefault(room, []).append((sequence, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if n <= min(a, capacity - a) and (left[n] > 1 if n == a else left[n])), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, fresh, 0)
            if b is not None:
                put(b, n, fresh, a)
            leave(capacity - a - (b or 0), fresh, n)
            fresh += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            room = min((r for r in gaps if r >= a), default=None)
            if room is None:
                each = capacity // a
                n = -(-left[a] // each)
                leave(capacity, fresh, n)
                fresh += n
                continue
            sequence, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            # Best fit keeps filling a sequence as long as it stays the fullest with room.
            each = min(room // a, left[a])
            n_full = min(n, left[a] // each)
            put(a, n_full * each, sequence, capacity - room, each)
            leave(room - each * a, sequence, n_full)
            leave(room, sequence + n_full, n - n_full)
    return runs


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, vocabulary, end_id, capacity, text), "pieces")
    buckets = 4 * partitions(spark)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cells = pieces.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "bucket", "base")

    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity)
    table = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 0, 1)], "run_length long, first long, pieces long, sequence long, from_offset long, each long"
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("row", F.row_number().over(within) - 1).join(cells, ["length", "bucket"]).withColumn("number", F.col("base") + F.col("row"))
    # The plan is broadcast: its size is bounded by the capacity, not by the data.
    here = (F.col("length") == F.col("run_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("pieces"))
    placed = ranked.join(F.broadcast(table), here)
    nth = F.col("number") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("from_offset") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )
