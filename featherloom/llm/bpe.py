"""Public byte-pair vocabularies per word, with bounded memory of words already seen.

The files are parameters; their ids and counts are those of the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMORY = 400_000  # words remembered by a Python worker; the rest is computed again


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


class Remembered(dict):
    """Values by word; ``compute`` gives those of new words. Emptied when full."""

    def __init__(self, compute, limit: int = MEMORY):
        super().__init__()
        self.compute = compute
        self.limit = limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.compute(word)
        return value


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins byte-level vocabularies use for bytes: fixed by that format."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Ids of whole texts under a byte-level vocabulary with spaces kept.

    The merges run by rank, which is the order of the merges in the file. A text in which no two white
    space characters meet is cut by a pattern without look-ahead: there the look-ahead changes nothing.
    Texts that hold a special string go through the library.
    """

    #: The format's pattern, and the same without the look-ahead.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    SIMPLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""

    def __init__(self, path: str):
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.path = path  # the library's own tokenizer is loaded when a text first needs it
        self.special = tuple(t["content"] for t in whole.get("added_tokens", []))
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids):
            raise ValueError("this vocabulary's ids do not follow its merges")
        self.full, self.simple = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for name, pattern in (("full", self.PATTERN), ("simple", self.SIMPLE))
        )
        self.meeting = re.compile(r"\s\s").search

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            found = tokenizer(self.path).encode(text, add_special_tokens=False).ids
        else:
            found = (self.full if self.meeting(text) else self.simple).encode_ordinary(text)
        return np.array(found, "<u4")


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


class WholeTokens:
    """Token counts under a lower-case vocabulary that drops white space and marks word ends.

    Words between ASCII white space are independent of each other: no pre-token holds white space and
    the pattern looks at nothing outside a pre-token. A word's pre-tokens that are proven to be one token
    count one each; the others are merged by the library.
    """

    #: Fixed value: the format's pattern, of ASCII words only.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"

    def __init__(self, path: str):
        import re

        self.library = tokenizer(path)
        self.special = special_strings(path)
        self.whole = proven_whole(path)
        self.find = re.compile(self.PATTERN).findall
        self.parts = Remembered(self._merged)
        self.words = Remembered(self._word)

    def _merged(self, part: str) -> int:
        return len(self.library.encode(part, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if not text.isascii() or "\x1c" <= max("\0", *(c for c in text if c < " "), "\0") <= "\x1f":
            return self._merged(text)
        total = 0
        for part in self.find(text.lower()):
            total += 1 if part in self.whole else self.parts[part]
        return total

    def count(self, text: bytes) -> int:
        if any(s.encode() in text for s in self.special):
            return len(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        words = self.words
        return sum([words[w] for w in text.split()])


@lru_cache(maxsize=2)
def proven_whole(path: str) -> frozenset[str]:
    """ASCII vocabulary strings that, standing alone as a pre-token, are exactly one token.

    Proof by the merge table alone: a string is whole if applying its merges in rank order ends in one
    symbol that is in the vocabulary. Strings that the pattern would split are left out.
    """
    import re

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {m: i for i, m in enumerate(merges)}
    split = re.compile(WholeTokens.PATTERN).findall
    whole = set()
    for piece in model["vocab"]:
        word = piece[: len(piece) - len(end)] if end else piece
        if not word or not piece.endswith(end) or not word.isascii() or not word.isprintable() or split(word) != [word]:
            continue
        symbols = [*word[:-1], word[-1] + end]
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: rank.get(p, len(rank)))
            if best not in rank:
                break
            joined, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    joined.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    joined.append(symbols[i])
                    i += 1
            symbols = joined
        if symbols == [piece]:
            whole.add(word)
    return frozenset(whole)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> WholeTokens:
    return WholeTokens(path)
