"""Token counts of whole texts, with a shortcut for words that are one token.

Which vocabulary strings are one token when they stand alone is proven once from the merge table. Words
made of such pre-tokens are counted by a look-up, all others are merged by the library. Words already
seen are remembered in a dictionary of bounded size, so memory does not grow with the input.
There is no shuffle and no state between texts.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from featherloom.llm.bpe import whole_tokens
from featherloom.llm.tables import only
from featherloom.llm.words import blocks, tidied


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is the file's path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = whole_tokens(vocabulary)
        for batch in batches:
            for b in blocks(batch, text):
                data = b.data.tobytes()
                at = b.offsets.tolist()
                tokens = [counter.count(data[s:e]) for s, e in zip(at, at[1:])]
                sizes = [e - s for s, e in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.first, b.rows), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return only(docs, "doc_id", text).mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
