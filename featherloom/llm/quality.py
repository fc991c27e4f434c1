"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a score: words (A-Z in lower case, hashed into ``BUCKETS``, square root of their share), structure statistics
of the text (sizes, shares of character kinds, repetition of words and lines) and the declared number of characters, these cut into
ranges of fixed borders. Labels, language, source and id are no inputs.

Model: logit = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pair sum is taken as
half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor, linear in the number of inputs.

It is fitted on at most ``sample`` labelled rows (a documented bound, default 10,000): the allowed rows with
the smallest hash of their id. Only their inputs come to the driver, where numpy fits them with AdaGrad.
The model has a fixed size and goes to the tasks with the scoring function; scoring has no shuffle.

Null or empty texts are scored on their statistics. Null ids are not held out. A document with several
labels counts as good if one of them is. Without any labelled row the score is 1: nothing is known against a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.llm.tables import fresh, only
from featherloom.llm.words import LOWER, SPACE, Block, blocks, prefix_hashes, release, span_hashes, tidied, word_spans

BUCKETS = 1 << 12
FACTORS = 8
BORDERS = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.14, 0.18, 0.23, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.88, 0.94, 0.98, 0.999])
RANGES = 32
STATISTICS = 15
_WEIGHT = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(id as text) leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _kinds(*chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for s in chars for c in s]] = True
    return table


_UPPER = _kinds("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _kinds("0123456789")
_STOP = _kinds(".,;:!?'\"-()")
_SIGN = _kinds("#$%&*+/<=>@[\\]^_`{|}~")
_WIDE = np.arange(256) >= 128


def _share(mask: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.cumsum(np.append(0, mask))
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(of, 1)


def inputs(b: Block, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, input numbers and values of a block of texts; ``n_chars`` is -1 where it is not given."""
    data, at, rows = b.data, b.offsets, b.rows
    sizes = np.diff(at)
    low = LOWER[data]
    starts, ends, first = word_spans(low, at)
    n_words = np.diff(first)
    h = span_hashes(prefix_hashes(low), starts, ends)
    row = np.repeat(np.arange(rows), n_words)

    # Distinct words of a row and how often they stand there.
    by = np.lexsort((h, row))
    hs, rs = h[by], row[by]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(hs)))
    distinct = np.bincount(rs[head], minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, rs[head], times)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    capital = _UPPER[data[starts]] if len(starts) else np.zeros(0, bool)
    line = data == 10
    cuts = np.flatnonzero(line)
    l_start = np.sort(np.concatenate([at[:-1][sizes > 0], cuts + 1]))
    l_end = np.append(l_start[1:], len(data))
    l_row = np.searchsorted(at, l_start, "right") - 1
    ok = (l_start < l_end) & (l_row < rows)
    l_start, l_end, l_row = l_start[ok], l_end[ok], l_row[ok]
    lh = span_hashes(prefix_hashes(data), l_start, np.minimum(l_end, at[l_row + 1]))
    lines = np.bincount(l_row, minlength=rows)
    lo = np.lexsort((lh, l_row))
    l_new = np.ones(len(lo), bool)
    l_new[1:] = (lh[lo][1:] != lh[lo][:-1]) | (l_row[lo][1:] != l_row[lo][:-1])
    l_distinct = np.bincount(l_row[lo][l_new], minlength=rows)

    def logs(x):
        return np.clip(np.floor(2 * np.log2(x + 1)).astype(int), 0, RANGES - 1)

    def cut(x):
        return np.searchsorted(BORDERS, x)

    words = np.maximum(n_words, 1)
    statistics = [
        logs(sizes), logs(n_words), logs(lines), np.clip((2 * np.bincount(row, ends - starts, rows) / words).astype(int), 0, RANGES - 1),
        cut(_share(_UPPER[data], at, sizes)), cut(_share(_DIGIT[data], at, sizes)), cut(_share(_STOP[data], at, sizes)), cut(_share(_SIGN[data], at, sizes)), cut(_share(_WIDE[data], at, sizes)),
        cut(_share(SPACE[data], at, sizes)), cut(distinct / words), cut(most / words), cut(_share(same, first, n_words)), cut(_share(capital, first, n_words)), cut(l_distinct / np.maximum(lines, 1)),
    ]
    metadata = np.where(n_chars < 0, RANGES - 1, np.minimum(logs(np.maximum(n_chars, 0)), RANGES - 2))
    dense = np.stack([BUCKETS + RANGES * i + s for i, s in enumerate([*statistics, metadata])], axis=1)

    bucket = (hs[head] >> np.uint64(20)).astype(np.int64) % BUCKETS
    value = np.sqrt(times / words[rs[head]])
    per_row = distinct + dense.shape[1]
    bounds = np.cumsum(np.append(0, per_row))
    number, x = np.zeros(bounds[-1], np.int32), np.zeros(bounds[-1], np.float32)
    place = bounds[rs[head]] + np.arange(len(head)) - np.cumsum(np.append(0, distinct))[rs[head]]
    number[place], x[place] = bucket, value
    tail = (bounds[1:, None] - dense.shape[1] + np.arange(dense.shape[1])[None, :]).ravel()
    number[tail], x[tail] = dense.ravel(), _WEIGHT
    return bounds, number, x


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, bounds: np.ndarray, number: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Every row has at least its statistics, so no segment is empty."""
        vx = self.v[number] * x[:, None]
        total = np.add.reduceat(vx, bounds[:-1])
        square = np.add.reduceat(vx * vx, bounds[:-1])
        return self.w0 + np.add.reduceat(self.w[number] * x, bounds[:-1]) + 0.5 * (total * total - square).sum(axis=1)


def fit(bounds: np.ndarray, number: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    rng = np.random.default_rng(7)
    size = BUCKETS + RANGES * (STATISTICS + 1)
    share = min(max(y.mean(), 0.01), 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    seen_w, seen_v, seen_0 = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            rows = order[k: k + batch]
            n = bounds[rows + 1] - bounds[rows]
            at = np.repeat(bounds[rows] - np.cumsum(np.append(0, n))[:-1], n) + np.arange(n.sum())
            i, xi, own = number[at], x[at], np.cumsum(np.append(0, n))
            vx = m.v[i] * xi[:, None]
            total = np.add.reduceat(vx, own[:-1])
            z = m.w0 + np.add.reduceat(m.w[i] * xi, own[:-1]) + 0.5 * (total * total - np.add.reduceat(vx * vx, own[:-1])).sum(axis=1)
            g = ((1 / (1 + np.exp(-z)) - y[rows]) / len(rows)).astype(np.float32)
            gx = np.repeat(g, n) * xi
            dw = np.bincount(i, gx, size).astype(np.float32) + decay * m.w
            dv = np.zeros_like(m.v)
            np.add.at(dv, i, gx[:, None] * (np.repeat(total, n, axis=0) - vx))
            dv += decay * m.v
            seen_w += dw * dw
            seen_v += dv * dv
            seen_0 += float(g.sum()) ** 2
            m.w -= rate * dw / np.sqrt(seen_w)
            m.v -= 0.3 * rate * dv / np.sqrt(seen_v)
            m.w0 -= rate * float(g.sum()) / seen_0**0.5
    return m


def _given(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("n_chars").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, text: str = "text") -> Machine | None:
    """Fits on labelled documents that are not held out; None if there is none."""
    good = only(labels, "doc_id", "quality").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_chars = _given(batch)
            for b in blocks(batch, text):
                bounds, number, x = inputs(b, n_chars[b.first: b.last])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.first, b.rows), batch.column("quality").slice(b.first, b.rows).cast(pa.int32()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(number)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x))],
                    ["doc_id", "quality", "number", "x"],
                )

    docs = _columns(docs, text)
    # The sample's ids are at most ``sample`` rows, so they are broadcast.
    found = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", text, "n_chars")
    table = found.mapInArrow(tidied(run), "doc_id long, quality int, number array<int>, x array<float>").orderBy("doc_id", F.xxhash64("number")).limit(sample).toArrow()
    if not table.num_rows:
        return None
    number = table.column("number").combine_chunks()
    bounds = np.cumsum(np.append(0, pa.compute.list_value_length(number).to_numpy()))
    y = (table.column("quality").to_numpy() > 0).astype(np.float64)
    machine = fit(bounds, number.flatten().to_numpy(), table.column("x").combine_chunks().flatten().to_numpy(), y)
    del table, number, bounds, y
    release()
    return machine


def _columns(docs: DataFrame, text: str) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id"), F.col(f"`{text}`"), n_chars.alias("n_chars"))


def _scores(machine: Machine | None, batch: pa.RecordBatch, text: str) -> np.ndarray:
    out, n_chars = [np.zeros(0)], _given(batch)
    for b in blocks(batch, text):
        out.append(np.ones(b.rows) if machine is None else 1 / (1 + np.exp(-np.clip(machine.logits(*inputs(b, n_chars[b.first: b.last])), -50, 50))))
    return np.concatenate(out)


def score(docs: DataFrame, machine: Machine | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(machine, batch, text), pa.float64())], ["doc_id", "score"])

    scored = _columns(docs, text).mapInArrow(tidied(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The documents with a score of at least ``threshold``, all columns."""
    names, extra = docs.columns, fresh(docs, "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _scores(machine, batch.select([*names, extra]).rename_columns([*("_" * 9 + n if n == "n_chars" else n for n in names), "n_chars"]), text) >= threshold
            yield batch.select(names).filter(pa.array(good))

    given = F.col("n_chars").cast("long") if "n_chars" in names else F.lit(None).cast("long")
    return docs.withColumn(extra, given).mapInArrow(tidied(run), docs.schema)
