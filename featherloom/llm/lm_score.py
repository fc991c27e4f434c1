"""Documents scored by a masked pseudo-likelihood: every word predicted from the words on both sides.

Words (A-Z in lower case) are counted over the whole corpus. The most frequent ones have a token each, the rest share
``RARE`` hashed tokens. The network reads ``SIDE`` tokens to the left and to the right of a gap: a table per
position is looked up and summed, passed through tanh, and predicts the token in two steps, its group of 64 and its
place within the group, so a probability costs 128 outputs and not 4,096.

Training uses the window of every position of the corpus, each once. Stretches of tokens are dealt to rounds and evenly to shards, every shard
of a round trains a copy of the network in numpy, the copies are averaged place by place in a table, and the next round
starts from the average. The model's size is fixed; only the model comes to the driver.

A document's score is the sum of the conditional log-probabilities of all its words; ``mean_logprob`` is that per word.
Null and empty texts have no words: sum 0, mean null. Repeated rows and null ids are kept. An empty
corpus gives an untrained network and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.tables import only, stored
from featherloom.llm.words import LOWER, Block, blocks, prefix_hashes, span_hashes, tidied, word_spans

TOKENS, GROUP, RARE = 4096, 64, 1024
GROUPS = TOKENS // GROUP
SIDE, HIDDEN = 3, 24
EDGE = TOKENS  # stands for what is outside of the text
SHARD = 1 << 21  # windows of a shard
PACK = 4096  # positions dealt together
CHUNK = 8192  # places of the network averaged together
ROUNDS, RATE, BATCH = 3, 0.15, 2048
_TEXT, _HELD = 1 << 18, 1 << 22  # bytes of text hashed at a time, words counted at a time
RUN = 64  # positions in a row that a batch takes together
LARGE = 80.0  # of outputs: exp of 64 such numbers together is far below the largest 32-bit float
_STEP, _FEW, _LEAD = 1 << 11, 16, np.uint64(64 - 18)
_SHIFTS = np.delete(np.arange(2 * SIDE + 1), SIDE)  # of the tokens around a window's middle from its start
_SLOTS = 2 * SIDE - _SHIFTS
_HALVES = np.repeat(np.eye(2, dtype=np.float32), [GROUPS, GROUP], axis=0)  # sums groups and places


@dataclass
class Network:
    tables: np.ndarray  # position, token, hidden
    bias: np.ndarray
    out: np.ndarray  # hidden, group outputs then place outputs
    group_bias: np.ndarray
    place_bias: np.ndarray  # group, place

    @classmethod
    def new(cls) -> Network:
        rng = np.random.default_rng(11)
        return cls(
            rng.normal(0, 0.1, (2 * SIDE, TOKENS + 1, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
            rng.normal(0, 0.1, (HIDDEN, GROUPS + GROUP)).astype(np.float32), np.zeros(GROUPS, np.float32), np.zeros((GROUPS, GROUP), np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.out, self.group_bias, self.place_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for p in cls.new().parts():
            parts.append(flat[at: at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return cls(*parts)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.bias + self.tables[0][context[:, 0]]
        for k in range(1, 2 * SIDE):
            z += self.tables[k][context[:, k]]
        return np.tanh(z)

    def wide(self) -> np.ndarray:
        """What a token adds to each of the positions around it, side by side, the rightmost first; its own position, which it adds nothing to, has a place too."""
        out = np.zeros((TOKENS + 1, 2 * SIDE + 1, HIDDEN), np.float32)
        out[:, _SLOTS] = self.tables.transpose(1, 0, 2)
        return out

    def _hidden(self, wide: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of windows of ``tokens`` that start ``at``."""
        rows, first = wide.reshape(-1, HIDDEN), tokens.astype(np.int64) * (2 * SIDE + 1)
        z = rows.take(first[at + _SHIFTS[0]] + _SLOTS[0], axis=0)
        for shift, slot in zip(_SHIFTS[1:], _SLOTS[1:]):
            z += rows.take(first[at + shift] + slot, axis=0)
        z += self.bias
        return np.tanh(z, out=z)

    @staticmethod
    def _with_one(h: np.ndarray) -> np.ndarray:
        """What the bias of the groups is multiplied by stands in a last column."""
        return np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)

    def _outputs(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of groups, then of places within the group, small enough for ``exp``."""
        y = self._with_one(h) @ np.concatenate([self.out, np.append(self.group_bias, np.zeros(GROUP, np.float32))[None]])
        y[:, GROUPS:] += self.place_bias[group]
        # No hidden value is above 1, so no output is above its weights together.
        if np.abs(self.out).sum(axis=0).max() + max(np.abs(self.group_bias).max(), np.abs(self.place_bias).max()) > LARGE:
            y[:, :GROUPS] -= y[:, :GROUPS].max(axis=1, keepdims=True)
            y[:, GROUPS:] -= y[:, GROUPS:].max(axis=1, keepdims=True)
        return y

    def _of_hidden(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        group, place, each = token // GROUP, token % GROUP, np.arange(len(token))
        y = self._outputs(h, group)
        total = y[each, group].astype(np.float64) + y[each, GROUPS + place]
        return total - np.log(np.exp(y, out=y) @ _HALVES).sum(axis=1)

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        return self._of_hidden(self.hidden(context), token)

    def stream_log_probabilities(self, wide: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """Of every token of a stream that starts and ends with ``SIDE`` times EDGE; ``wide`` is that of the network."""
        places, found = np.flatnonzero(stream != EDGE), []
        for k in range(0, len(places), _STEP):
            at = places[k: k + _STEP]
            begin = at[0] - SIDE
            found.append(self._of_hidden(self._hidden(wide, stream[begin: at[-1] + SIDE + 1], at - at[0]), stream[at].astype(np.int64)))
        return np.concatenate(found) if found else np.zeros(0)

    def learn(self, stream: np.ndarray, places: np.ndarray, rate: float) -> None:
        """One pass of AdaGrad over the windows around ``places`` of a stream of tokens.

        A batch is made of stretches of ``RUN`` positions from all over the stream: a token is looked up, and its gradients are
        summed, for all positions around it at once.
        """
        n = -(-len(stream) // RUN)
        padded = np.full(n * RUN + 2 * SIDE, EDGE, np.uint16)
        padded[SIDE: SIDE + len(stream)] = stream
        wanted = np.zeros(n * RUN, bool)
        wanted[places] = True
        wanted = wanted.reshape(n, RUN)
        runs = np.lib.stride_tricks.sliding_window_view(padded, RUN + 2 * SIDE)[::RUN]
        order = np.random.default_rng(5).permutation(np.flatnonzero(wanted.any(axis=1)))
        upto = np.cumsum(wanted[order].sum(axis=1))
        wide, seen = self.wide(), [np.full(p.shape, 1e-2, np.float32) for p in self.parts()]
        seen[0] = np.full((TOKENS + 1, wide[0].size), 1e-2, np.float32)
        for some in np.split(order, np.unique(np.searchsorted(upto, np.arange(BATCH, len(places), BATCH)) + 1)):
            if len(some):
                self._batch(runs[some], wanted[some], wide, seen, rate)
        self.tables[:] = wide[:, _SLOTS].transpose(1, 0, 2)

    def _batch(self, tokens: np.ndarray, wanted: np.ndarray, wide: np.ndarray, seen: list[np.ndarray], rate: float) -> None:
        run, place = np.nonzero(wanted)
        token = tokens[run, place + SIDE]
        by = np.argsort(token, kind="stable")
        token, run, place = token[by].astype(np.int64), run[by], place[by]
        group, inside, each = token // GROUP, token % GROUP, np.arange(len(token))
        h = self._hidden(wide, tokens.ravel(), run * tokens.shape[1] + place)
        z = self._outputs(h, group)
        np.exp(z, out=z)
        halves = z.reshape(len(token), 2, -1)
        halves *= (1 / ((z @ _HALVES) * np.float32(len(token))))[:, :, None]
        z[each, group] -= np.float32(1 / len(token))
        z[each, GROUPS + inside] -= np.float32(1 / len(token))
        dh = z @ self.out.T
        dh *= 1 - h * h
        # The gradients that a token gets from the positions around it stand side by side.
        around = np.zeros((len(tokens), tokens.shape[1] + 2 * SIDE, HIDDEN), np.float32)
        around[run, place + 2 * SIDE] = dh
        own, starts = _heads(group)
        of_places = np.zeros((GROUPS, GROUP), np.float32)
        one = np.ones(len(token), np.float32)
        for g, start, end in zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(token)]):
            of_places[g] = one[start:end] @ z[start:end, GROUPS:]
        of_outputs = (z.T @ self._with_one(h)).T
        self._step(2, of_outputs[:-1], seen, rate)
        self._step(3, of_outputs[-1, :GROUPS], seen, rate)
        self._step(4, of_places, seen, rate)
        self._step(1, dh.sum(axis=0), seen, rate)
        windows = np.lib.stride_tricks.as_strided(around, (*tokens.shape, wide[0].size), around.strides, writeable=False)
        self._rows(wide.reshape(TOKENS + 1, -1), seen[0], tokens, windows, rate)

    def _step(self, part: int, gradient: np.ndarray, seen: list[np.ndarray], rate: float) -> None:
        seen[part] += gradient * gradient
        value = self.parts()[part]
        value -= rate * gradient / np.sqrt(seen[part])

    @staticmethod
    def _rows(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        order = np.argsort(rows.ravel(), kind="stable")
        own, starts = _heads(rows.ravel()[order])
        counts = np.diff(np.append(starts, len(order)))
        most = np.argsort(-counts, kind="stable")
        own, total = own[most], _sums(gradient, np.divmod(order, rows.shape[1]), starts[most], counts[most])
        now = total * total
        now += seen.take(own, axis=0)
        seen[own] = now
        total *= rate
        total /= np.sqrt(now, out=now)
        table[own] = np.subtract(table.take(own, axis=0), total, out=total)


def _heads(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ordered array and where each begins."""
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], starts


def _sums(rows: np.ndarray, at: tuple[np.ndarray, np.ndarray], starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of the rows ``at`` ``counts`` successive places each, largest counts first: the first of all, the second of all, and so on; many at once."""

    def taken(places) -> np.ndarray:
        return rows[at[0][places], at[1][places]]

    total = taken(starts)
    more = np.searchsorted(-counts, -np.arange(_FEW + 1)).tolist()  # how many have above k rows
    for k in range(1, _FEW):
        if more[k]:
            total[: more[k]] += taken(starts[: more[k]] + k)
    for k in range(more[_FEW]):
        total[k] += taken(slice(starts[k] + _FEW, starts[k] + counts[k])).sum(axis=0)
    return total


def _word_hashes(b: Block) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[b.data]
    starts, ends, first = word_spans(low, b.offsets)
    return span_hashes(prefix_hashes(low), starts, ends), first


def vocabulary(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Hashes of the most frequent words of the whole corpus, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b in blocks(batch, text, _TEXT):
                held.append(_word_hashes(b)[0])
                size += len(held[-1])
                if size > _HELD:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    counts = only(docs, text).mapInArrow(tidied(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(TOKENS - RARE).toArrow()
    return top.column("word").to_numpy().view(np.uint64)


class Tokens:
    """Token of a word hash."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words)
        self.words = words[self.order]
        # The first word at or after each value of the leading bits; it is the only candidate but where two words share them.
        lead = self.words >> _LEAD
        self.first = np.searchsorted(lead, np.arange(1 << (64 - int(_LEAD)), dtype=np.uint64)).astype(np.uint16)
        self.shared = lead[1:][lead[1:] == lead[:-1]]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        rare = (TOKENS - RARE + (h >> np.uint64(11)) % np.uint64(RARE)).astype(np.int64)
        if not len(self.words):
            return rare
        lead = h >> _LEAD
        at = np.minimum(self.first[lead.astype(np.int64)], len(self.words) - 1)
        if len(self.shared):
            some = np.flatnonzero(np.isin(lead, self.shared))
            at[some] = np.minimum(np.searchsorted(self.words, h[some]), len(self.words) - 1)
        return np.where(self.words[at] == h, self.order[at], rare)


def _stream(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All texts in a row, ``SIDE`` times EDGE before, between and after them."""
    out = np.full(len(tokens) + SIDE * len(first), EDGE, "<u2")
    out[np.arange(len(tokens)) + SIDE * np.repeat(np.arange(1, len(first)), np.diff(first))] = tokens
    return out


def training_packs(docs: DataFrame, words: np.ndarray, text: str = "text") -> DataFrame:
    """(turn, tokens, n): every position of every text in stretches of ``PACK``, with the tokens around them, as unsigned 16-bit numbers, and the round each is dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, done = Tokens(words), 0
        for batch in batches:
            packs = []
            for b in blocks(batch, text, _TEXT):
                h, first = _word_hashes(b)
                if len(h):
                    stream = _stream(token(h), first)
                    packs += [stream[k: k + PACK + 2 * SIDE] for k in range(0, len(stream) - 2 * SIDE, PACK)]
            if packs:
                texts = [p.tobytes() for p in packs]
                turns = [crc32(t, done + k) % ROUNDS for k, t in enumerate(texts)]
                done += len(packs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(turns, pa.int32()), pa.array(texts, pa.binary()), pa.array([int((p[SIDE: -SIDE] != EDGE).sum()) for p in packs], pa.int64())], ["turn", "tokens", "n"])

    return only(docs, text).mapInArrow(tidied(run), "turn int, tokens binary, n long")


def _places(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packs in a row and the places of the positions they were made for."""
    stream = np.frombuffer(b"".join(packs), "<u2")
    wanted = stream != EDGE
    ends = np.cumsum([len(p) // 2 for p in packs])
    for k in range(SIDE):
        wanted[ends - 1 - k] = False
        wanted[np.append(0, ends[:-1]) + k] = False
    return stream, np.flatnonzero(wanted)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of every stretch of the network over the shards that moved it; at most the network is held."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for at, change in zip(batch.column("at").to_pylist(), batch.column("change").to_pylist()):
            change = np.frombuffer(change, np.float32)
            total = sums.setdefault(at, [np.zeros(len(change)), np.zeros(len(change), np.int64)])
            total[0] += change
            total[1] += change != 0  # places that no window of a shard touched stay with the average of the others
    for at, (total, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(total / np.maximum(n, 1)).tobytes()], pa.binary())], ["at", "change"])


def train(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, Network]:
    spark = docs.sparkSession
    words = vocabulary(docs, text)
    packs = stored(training_packs(docs, words, text), "packs")
    totals = {r["turn"]: r["n"] for r in packs.groupBy("turn").agg(F.sum("n").alias("n")).collect()}  # a row a round
    network = Network.new()
    size = network.flat().size
    for turn in sorted(totals):
        dealt = packs.where(F.col("turn") == turn).select("tokens").repartition(-(-totals[turn] // SHARD) or 1)
        start = spark.sparkContext.broadcast(network.flat())  # the model's size is fixed

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=RATE / (turn + 1)) -> Iterator[pa.RecordBatch]:
            own = sorted(x for batch in batches for x in batch.column("tokens").to_pylist())
            if not own:
                return
            stream, places = _places(own)
            network = Network.of(start.value)
            network.learn(stream, places, rate)
            change = network.flat() - start.value
            for k in range(0, len(change), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([change[k: k + CHUNK].tobytes()], pa.binary())], ["at", "change"])

        changes = dealt.mapInArrow(tidied(run), "at int, change binary").repartition("at").mapInArrow(tidied(_averaged), "at int, change binary")
        flat = network.flat().astype(np.float64)
        for at, change in zip(*changes.toArrow().to_pydict().values()):
            flat[at: at + CHUNK] += np.frombuffer(change)
        network = Network.of(flat[:size])
        start.unpersist()
    return words, network


def score(docs: DataFrame, words: np.ndarray, network: Network, text: str = "text") -> DataFrame:
    """(doc_id, n_words, sum_logprob, mean_logprob), one row per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast((words, network.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = model.value
        token, network = Tokens(words), Network.of(flat)
        wide = network.wide()
        for batch in batches:
            for b in blocks(batch, text, _TEXT):
                h, first = _word_hashes(b)
                total = np.append(0, np.cumsum(network.stream_log_probabilities(wide, _stream(token(h), first))))
                sums, n = total[first[1:]] - total[first[:-1]], np.diff(first)
                means = pa.array(sums / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.first, b.rows), pa.array(n), pa.array(sums), means], ["doc_id", "n_words", "sum_logprob", "mean_logprob"])

    return only(docs, "doc_id", text).mapInArrow(tidied(run), "doc_id long, n_words long, sum_logprob double, mean_logprob double")
