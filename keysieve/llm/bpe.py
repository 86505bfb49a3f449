"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

Every prefix of a byte string has exactly one token that ends its encoding.
The tables here store that last token per prefix: the encoding of a prefix
plus a token is an encoding again if the last two tokens may stand beside each
other, which a walk over their merge trees decides. Appending bytes therefore
never changes what is stored, and an edit only changes tokens near it.

Defined cases
-------------
* A null or empty text has no tokens and decodes to no bytes.
* Other columns pass through, null or not; a column with the name of the output
  is replaced. Repeated rows are encoded one by one.
* Texts are encoded whole, whatever their length: the work is linear in it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES = 600_000


class Vocabulary:
    """Tokens by rank, how each was merged, and which may stand beside each other."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.reachable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            merged = self.merge(token, rank) if len(token) > 1 else [rank]
            if len(merged) <= 2:
                self.parts[rank] = tuple(merged) if len(merged) == 2 else None
                self.reachable[token] = rank
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.reachable.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._beside: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))})

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals, with ranks under ``below`` only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            pairs = [(self.ranks.get(parts[i] + parts[i + 1]), i) for i in range(len(parts) - 1)]
            rank, i = min(((r, i) for r, i in pairs if r is not None and (below is None or r < below)), default=(None, 0))
            if rank is None:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two again."""
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) >= CACHE_ENTRIES:
                self._beside.clear()
            known = self._beside[left, right] = self._walk(left, right)
        return known

    def _walk(self, left: int, right: int) -> bool:
        # Undo merges from the latest to the earliest. While both facing tokens
        # exist, a token across the seam with an earlier rank than the next
        # undone merge would have been made first.
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        before = None
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and (before is None or across < before):
                return False
            a, b = parts[left], parts[right]
            if a is None and b is None:
                return True
            # Of equal ranks the leftmost is merged first, so the right one is undone first.
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one match of the splitting pattern."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else Prefixes(self, piece).encoding()


class Prefixes:
    """The last token of every prefix of a byte string that grows or changes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, data: bytes, last: list[int], stop=None) -> None:
        """Work out last tokens from ``len(last)`` to the end of ``data``, or until ``stop(last)``."""
        beside = self.vocabulary.beside
        text, done = data.decode("latin-1"), len(last)
        # Tokens met by the automaton, by the place where they end; only one of those at a place is valid.
        for end, (size, token) in self.vocabulary.automaton.iter(text, max(0, done - self.vocabulary.longest)):
            if end == done and (size > end or beside(last[end - size], token)):
                last.append(token)
                done += 1
                if stop is not None and stop(last):
                    return
        if done < len(data):
            raise ValueError(f"no token ends the prefix of {done + 1} bytes; the vocabulary lacks single bytes")

    def append(self, more: bytes) -> None:
        """Exact: what is stored for the old prefixes stays."""
        self.data += more
        self._extend(self.data, self.last)

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Put ``by`` in place of ``data[start:end]``; returns how many prefixes had to be worked out.

        Past the edit, as many equal last tokens in a row as the longest token
        has bytes mean that all later ones are equal as well.
        """
        data, last, old = self.data[:start] + by + self.data[end:], self.last[:start], self.last
        shift, edited, equal = len(by) - (end - start), start + len(by), 0

        def settled(last: list[int]) -> bool:
            nonlocal equal
            equal = equal + 1 if len(last) > edited and last[-1] == old[len(last) - 1 - shift] else 0
            return equal >= self.vocabulary.longest

        self._extend(data, last, settled)
        done = len(last) - start
        self.data, self.last = data, last + old[len(last) - shift :] if len(last) < len(data) else last
        return done

    def encoding(self) -> list[int]:
        ids, end = [], len(self.data)
        while end:
            ids.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[ids[-1]])
        return ids[::-1]


class Encoder(dict):
    """Encoded pieces by their text; a bounded memory of what one worker has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        super().__init__()
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[piece] = np.array(self.vocabulary.encode(piece.encode()), dtype="<u4").tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(2)
def loaded(path: str) -> Vocabulary:
    return Vocabulary.load(path)


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(loaded(path), pattern)


def _with_column(batch: pa.RecordBatch, name: str, values: Iterable[bytes]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.record_batch([batch.column(n) for n in names] + [pa.array(values, pa.binary())], names=[*names, name])


def _schema(df: DataFrame, name: str) -> str:
    kept = df.drop(name)
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{name}` binary"])


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: the tokens of each whole text as little-endian unsigned 32-bit integers.

    ``vocabulary``: path of a rank file that every machine can open. ``pattern``
    splits the text; each match is encoded by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(vocabulary, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield _with_column(part, ids, [encode_text(t.as_py() or "") for t in part.column(text)])

    return docs.mapInArrow(run, _schema(docs, ids))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = loaded(vocabulary).tokens.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield _with_column(part, data, [b"".join(map(get, np.frombuffer(i.as_py() or b"", "<u4").tolist())) for i in part.column(ids)])

    return encoded.mapInArrow(run, _schema(encoded, data))


def n_tokens(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")
