"""Text columns of Arrow batches as numpy arrays: bounded blocks of rows, words and rolling hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20  # bytes of text handled at a time; a longer text is a block of its own

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(int(_random.integers(1 << 40, 1 << 62)) * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_MORE = 1 << 16  # they grow by


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch: their bytes, end to end, and where each row starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[Block]:
    """A null text counts as empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Block(first, last, data[at[first]: at[last]], at[first: last + 1] - at[first])
        first = last


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with what it leaves in a Python worker given back when its partition ends: Spark uses
    workers again, and what each of a long job's stages left would add up."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def release() -> None:
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of GNU systems
    if trim is not None:
        trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(name: str, factor: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        size = 64 - (64 - n) // _MORE * _MORE if n > 1 << 14 else 1 << 14  # as long as texts need, so little on the driver
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if size > 4 * BLOCK:  # a rare long text does not stay in memory
            return table
        _powers[name] = table
    return _powers[name]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _grown("up", _BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per span of bytes; equal bytes give equal hashes wherever they stand."""
    return mixed((prefix[end] - prefix[start]) * _grown("down", _INVERSE, len(prefix))[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each row the number of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_starts(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the words at which a run of ``width`` words of one row starts."""
    inside = np.ones(words, bool)
    for k in range(1, width):
        stop = first[1:] - k
        inside[stop[(stop >= first[:-1]) & (stop >= 0)]] = False
    return np.flatnonzero(inside)


def run_hashes(word_hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(len(starts), np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + word_hashes[starts + k]
    return mixed(total)
