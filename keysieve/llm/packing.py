"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces are
range-sorted by falling length, so that each has a rank. Lengths and gaps are
integers up to the capacity; both sides are therefore runs of equal values.
One round per distinct length, longest first, sweeps the gaps for the smallest
that fits (its successor) and lets whole runs of gaps take whole runs of
pieces; the k-th piece of a run goes to the k-th gap, which resolves all
conflicts by rank. Gaps are updated and the next length follows. The rounds
see runs only: at most ``capacity`` lengths, and about as many runs of gaps,
however many documents there are. Each piece then finds its place from its
rank, in parallel.

A run of sequences loses at least half its gap whenever it takes pieces, so a
round's sweeps come to at most ``log2(capacity)`` per run over the whole plan.

Defined cases
-------------
* A null or empty text has the closing token alone.
* Other columns, null or not, play no part; only the id passes through, which
  may be null or repeated: each row is a document of its own.
* Ties in length are ranked by id and piece; equal rows in any order.
* An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import settled

CAPACITY = 4096
CLOSING_ID = 1
#: Words that a worker remembers; more save time, fewer memory.
CACHE_ENTRIES = 1_500_000
BATCH = 500
#: A sign that is a token of its own between spaces.
DIVIDER = "\x01"

#: str.split() also splits at these, which are no white space to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[" + "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Token ids of white-space separated words, remembered up to a bound.

    Right for tokenizers that never look across white space, as those do that
    drop it before the merges. A word of Latin letters is one piece, and full
    stops and commas after it are another. Other new words go to the tokenizer
    many at a time, divided by a sign whose token is known.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        self.entries = entries
        # Tasks are the unit of parallel work here.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A piece of Latin letters is merged in lower case, its bytes spelled as signs.
        self.merge = self.tokenizer.model.tokenize
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.signs = {b: b if b in signs else 256 + n for n, b in enumerate(sorted(range(256), key=lambda b: b in signs))}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        (self.divider,) = self._ids(DIVIDER)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _divided(self, words: list[str], learnt: dict[str, bytes]) -> None:
        for start in range(0, len(words), 500):
            part = words[start : start + 500]
            joined = f" {DIVIDER} ".join(part)
            if joined.count(DIVIDER) >= len(part):
                learnt.update((w, pack_ids(self._ids(w))) for w in part)
                continue
            ids = np.array(self._ids(joined), dtype="<u4")
            ends = np.flatnonzero(ids == self.divider)
            data, at = ids.tobytes(), 0
            for word, end in zip(part, [*(4 * ends).tolist(), len(data)], strict=True):
                learnt[word] = data[at:end]
                at = end + 4

    def _learnt(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words not known yet."""
        learnt: dict[str, bytes] = {}
        pieces, merge, signs, rest = self.pieces, self.merge, self.signs, []
        for word in words:
            core = word.rstrip(".,")
            if not core.isalpha() or not (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                rest.append(word)
                continue
            piece = core.lower()
            ids = pieces.get(piece)
            if ids is None:
                merged = merge(piece if piece.isascii() else piece.encode().decode("latin-1").translate(signs))
                ids = pieces[piece] = pack_ids([t.id for t in merged])
            if len(core) < len(word):
                tail = word[len(core) :]
                if tail not in pieces:
                    pieces[tail] = pack_ids(self._ids(tail))
                ids += pieces[tail]
            learnt[word] = ids
        self._divided(rest, learnt)
        return learnt

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.split() if not _SEPARATORS.search(t) else [w for w in _WHITE.split(t) if w] for t in texts]
        get = self.known.get
        found = [list(map(get, words)) for words in split]
        lacking = [n for n, ids in enumerate(found) if None in ids]
        if lacking:
            learnt = self._learnt({w for n in lacking for w, ids in zip(split[n], found[n], strict=True) if ids is None})
            for n in lacking:
                found[n] = [learnt[w] if ids is None else ids for w, ids in zip(split[n], found[n], strict=True)]
            # The bound holds between batches: a batch has all of its own words, however many.
            if len(self.known) + len(learnt) > self.entries:
                self.known.clear()
                self.pieces.clear()
            if len(learnt) <= self.entries:
                self.known.update(learnt)
        return [b"".join(ids) for ids in found]


@lru_cache(2)
def encoder(path: str, entries: int) -> WordEncoder:
    return WordEncoder(path, entries)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text", with_ids: bool = True,
           entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece: id, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    kind = docs.schema[id_column].dataType.simpleString()
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
    names = [id_column, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, entries)
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                encoded = encode([t.as_py() or "" for t in part.column(1)])
                rows: list[tuple] = []
                for n, data in enumerate(encoded):
                    data += closing
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        ids = data[at : at + 4 * capacity]
                        rows.append((n, k, at // 4, len(ids) // 4, zlib.crc32(ids), ids))
                n, k, at, size, crc, ids = zip(*rows, strict=True)
                arrays = [part.column(0).take(pa.array(n, pa.int64())), pa.array(k, pa.int32()), pa.array(at, pa.int64()),
                          pa.array(size, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(ids, pa.binary())] * with_ids
                yield pa.record_batch(arrays, names=names)

    schema = f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(id_column, text).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit moves for ``histogram`` (pieces by length), longest first.

    Rows: rank of the first piece, pieces per sequence, first sequence, offset
    there, length. A row holds for the ranks up to the next row's first.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    moves: list[tuple[int, int, int, int, int]] = []
    rank = sequences = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        freed: list[tuple[int, int, int]] = []

        def fill(gap: int, first: int, count: int) -> int:
            """Let a run of sequences take pieces; returns how many sequences of it took any."""
            nonlocal left, rank
            each = gap // length
            full, rest = min(count, left // each), 0
            if full:
                moves.append((rank, each, first, capacity - gap, length))
                freed.append((gap - each * length, first, full))
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                rest = left
                moves.append((rank, rest, first + full, capacity - gap, length))
                freed.append((gap - rest * length, first + full, 1))
                rank, left = rank + rest, 0
            return full + bool(rest)

        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                count = -(-left // (capacity // length))
                fill(capacity, sequences, count)
                sequences += count
                break
            gap = order[at]
            first, count = gaps[gap].pop()
            taken = fill(gap, first, count)
            if taken < count:
                gaps[gap].append((first + taken, count - taken))
            if not gaps[gap]:
                del gaps[gap], order[at]
        for run in freed:
            leave(*run)
    return np.array(moves, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no sequence longer than ``capacity``, none with a hole."""
    order = [F.desc("length"), F.asc(id_column), F.asc("piece")]
    placed = settled(
        pieces.drop("__part", "__row").repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "pieces-by-length",
    )
    # One number per partition and one per length: neither grows with the documents.
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    histogram = {r["length"]: r["count"] for r in placed.groupBy("length").count().collect()}
    starts = np.zeros(max((p for p, _ in counts), default=0) + 1, dtype=np.int64)
    total = 0
    for part, count in counts:
        starts[part], total = total, total + count
    moves = plan(histogram, capacity)
    fields = [f for f in placed.schema if f.name not in ("__part", "__row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = starts[batch.column("__part").to_numpy()] + batch.column("__row").to_numpy()
            move = moves[np.searchsorted(moves[:, 0], rank, side="right") - 1]
            nth, each = rank - move[:, 0], move[:, 1]
            arrays = [batch.column(f.name) for f in fields]
            arrays += [pa.array(move[:, 2] + nth // each), pa.array(move[:, 3] + nth % each * move[:, 4])]
            yield pa.record_batch(arrays, names=[f.name for f in fields] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return placed.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text", with_ids: bool = True,
           entries: int = CACHE_ENTRIES) -> DataFrame:
    """Tokenise, cut and pack ``docs``; ``entries``: how many words a worker remembers."""
    return pack(settled(pieces(docs, tokenizer, capacity, id_column, text, with_ids, entries), "pieces"), capacity, id_column)
