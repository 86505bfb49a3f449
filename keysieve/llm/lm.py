"""Language-model scores by a weighted backoff automaton learnt from the corpus.

The model is a bigram model with Dirichlet smoothing: with history ``h``,
``p(w|h) = (c(h,w) + K p(w)) / (c(h) + K)``, where ``p(w)`` is the additively
smoothed unigram model. As an automaton: the root has an arc per word with
``log p(w)`` and one for all unknown words; every history has a state with an
arc per word seen after it, and a failure arc of weight ``log(K / (c(h) + K))``
to the root for all others. A text is read once from left to right: each word
takes an arc of the current state, or its failure arc and then the root's, and
leads to the word's own state; the weights add up.

The model of a large corpus fits nowhere whole, so texts are read in blocks of
bounded size, and a block asks only for the arcs it meets:

1. blocks count their words and keep their texts as word numbers;
2. buckets of words (by hash) add up the counts of all blocks, number the
   words, and answer every block;
3. buckets of word pairs (by hash) do the same for pairs of those numbers;
4. every block builds its part of the automaton and reads its texts.

A bucket gets one entry per block and word or pair, so frequent ones do not
gather in one place; entries travel sorted and compressed.

Defined cases
-------------
* A null or empty text is the end token alone.
* A null id is held out, as the empty string would be. Repeated rows count and
  are scored one by one. Other columns play no part.
* Without training texts every token is unknown with probability 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import press, settled, unpress, whole_text

#: Weight of the unigram model in every history, in tokens.
BACKOFF = 50.0
#: Added to every unigram count.
ADDED = 0.1
BLOCK_TOKENS = 3_000_000
BUCKET_BYTES = 32_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _squeeze(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _loosen(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split()


def held_out(id_column: str = "doc_id") -> Column:
    """Every tenth row by the checksum of its id's text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _spec(kind: str) -> str:
    return f"kind string, block bigint, bucket int, a binary, b binary, c binary, ids array<{kind}>, n bigint"


def _table(rows: list[dict], ids: pa.DataType) -> pa.Table:
    fields = [("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()),
              ("ids", pa.list_(ids)), ("n", pa.int64())]
    return pa.Table.from_pylist(rows, schema=pa.schema(fields))


def _blocks(docs: DataFrame, kind: str, buckets: int) -> DataFrame:
    """Per block: one row ``docs`` (word numbers, sizes, held-out marks, ids) and a row ``words`` per bucket."""

    def close(ids: pa.ChunkedArray, held: list[bool], texts: list[np.ndarray], known: dict[bytes, int]) -> list[dict]:
        block = uuid.uuid4().int >> 65
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        tokens = np.concatenate(texts)
        train = ~np.repeat(np.array(held, dtype=bool), sizes)
        counts = np.bincount(tokens[train], minlength=len(known) + 1)[1:]
        # Frequent words get small numbers, which compress better.
        words = list(known)
        by_bucket = np.array([xxhash.xxh64_intdigest(w) % buckets for w in words], dtype=np.int64)
        order = np.lexsort((-counts, by_bucket)) if words else np.empty(0, np.int64)
        rank = np.zeros(len(words) + 1, dtype=np.int64)
        rank[order + 1] = np.arange(1, len(words) + 1)
        rows = [{"kind": "docs", "block": block, "bucket": -1, "a": press(rank[tokens]), "b": press(sizes), "c": bytes(held),
                 "ids": ids, "n": int(np.sum(~np.array(held, dtype=bool)))}]
        edges = np.searchsorted(by_bucket[order], np.arange(buckets + 1))
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[bucket] : edges[bucket + 1]]
            rows.append({"kind": "words", "block": block, "bucket": bucket, "a": _squeeze([words[i] for i in own]), "b": press(counts[own])})
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, held, texts, n, id_type = [], [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for one, out, text in zip(*batch.columns, strict=True):
                words = text.as_py().encode().translate(_LOWER).split()
                texts.append(np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words)))
                texts[-1] = np.append(texts[-1], 0).astype(np.int32)
                ids.append(one.as_py())
                held.append(out.as_py())
                n += len(texts[-1])
                if n >= BLOCK_TOKENS:
                    yield from _table(close(ids, held, texts, known), id_type).to_batches()
                    known, ids, held, texts, n = {}, [], [], [], 0
        if texts:
            yield from _table(close(ids, held, texts, known), id_type).to_batches()

    return docs.mapInArrow(run, _spec(kind))


def _merge_words(buckets: int):
    """Add up a bucket's words over all blocks; answer each block with numbers and counts in its own order."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["block", "bucket", "a", "b"]).to_pylist(), key=lambda r: r["block"])
        bucket = rows[0]["bucket"]
        known: dict[bytes, int] = {}
        places = [np.array([known.setdefault(w, len(known)) for w in _loosen(r["a"])], dtype=np.int64) for r in rows]
        counts = np.zeros(len(known), dtype=np.int64)
        for r, place in zip(rows, places, strict=True):
            counts[place] += unpress(r["b"])
        if len(known) * buckets + buckets >= 1 << 32:
            raise OverflowError("word numbers must stay below 2**32")
        out = [{"kind": "numbers", "block": r["block"], "bucket": bucket, "a": press(p * buckets + bucket + 1), "b": press(counts[p])} for r, p in zip(rows, places, strict=True)]
        out.append({"kind": "total", "block": -1, "bucket": bucket, "a": press(counts.sum(keepdims=True)), "b": press(np.array([(counts > 0).sum()]))})
        return _table(out, table.schema.field("ids").type.value_type)

    return run


class Block:
    """A block's texts with the numbers and counts that the word buckets answered."""

    def __init__(self, rows: list[dict]) -> None:
        docs = next(r for r in rows if r["kind"] == "docs")
        answers = sorted((r for r in rows if r["kind"] == "numbers"), key=lambda r: r["bucket"])
        self.ids, self.held = docs["ids"], np.frombuffer(docs["c"], dtype=np.bool_)
        self.tokens, self.sizes = unpress(docs["a"]), unpress(docs["b"])
        # Token 0, the end, is also the history that every text starts with.
        self.numbers = np.concatenate([[0], *(unpress(r["a"]) for r in answers)]).astype(np.uint64)
        self.counts = np.concatenate([[0], *(unpress(r["b"]) for r in answers)]).astype(np.int64)

    def pairs(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs by (bucket, pair), the first place of each bucket, and the pair of every token."""
        stream = self.numbers[self.tokens]
        keys = (np.concatenate([np.zeros(1, np.uint64), stream[:-1]]) << np.uint64(32)) | stream
        distinct, of = np.unique(keys, return_inverse=True)
        bucket = ((distinct * _MULTIPLIER) >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return distinct[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), back[of]


def _send_pairs(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block(rows)
        pairs, edges, of = block.pairs(buckets)
        train = ~np.repeat(block.held, block.sizes)
        counts = np.bincount(of[train], minlength=len(pairs))
        out = []
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[bucket], edges[bucket + 1])
            steps = np.diff(pairs[own], prepend=np.uint64(0))
            out.append({"kind": "pairs", "block": rows[0]["block"], "bucket": bucket, "a": press(steps), "b": press(counts[own])})
        return _table(out, table.schema.field("ids").type.value_type)

    return run


def _merge_pairs(table: pa.Table) -> pa.Table:
    """Add up a bucket's pairs over all blocks; answer each block with counts in its own order."""
    rows = table.select(["block", "bucket", "a", "b"]).to_pylist()
    pairs = [np.cumsum(unpress(r["a"])) for r in rows]
    distinct, of = np.unique(np.concatenate(pairs), return_inverse=True)
    counts = np.bincount(of, weights=np.concatenate([unpress(r["b"]) for r in rows]), minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum([len(p) for p in pairs])
    out = [{"kind": "pair_counts", "block": r["block"], "bucket": r["bucket"], "a": press(counts[of[end - len(p) : end]])} for r, p, end in zip(rows, pairs, ends, strict=True)]
    return _table(out, table.schema.field("ids").type.value_type)


class Automaton:
    """The part of the backoff automaton that a set of texts can meet."""

    def __init__(self, counts: np.ndarray, pair_counts: np.ndarray, train_tokens: int, vocabulary: int, train_docs: int, backoff: float) -> None:
        counts = counts.copy()
        counts[0] = train_docs
        total = train_tokens + ADDED * (vocabulary + 1)
        self.counts, self.backoff, self.pair_counts = counts, backoff, pair_counts
        unigram = (counts + ADDED) / total if train_tokens else np.ones(len(counts))
        self.unigram = unigram
        self.root = np.log10(unigram)
        # A history never seen has no state: reading goes on from the root, at no cost.
        self.failure = np.log10(backoff / (counts + backoff))

    def read(self, tokens: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token, the weights at the root and along the path taken.

        The state before a token is that of the token before it; texts start
        in the state of the end token. ``pair`` numbers (state, token).
        """
        state = np.concatenate([[0], tokens[:-1]])
        seen = self.pair_counts[pair]
        failed = self.failure[state] + self.root[tokens]
        with np.errstate(divide="ignore"):
            arc = np.log10((seen + self.backoff * self.unigram[tokens]) / (self.counts[state] + self.backoff))
        return self.root[tokens], np.where(seen > 0, arc, failed)


def _score(buckets: int, train_tokens: int, vocabulary: int, train_docs: int, backoff: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block(rows)
        answers = sorted((r for r in rows if r["kind"] == "pair_counts"), key=lambda r: r["bucket"])
        automaton = Automaton(block.counts, np.concatenate([unpress(r["a"]) for r in answers]), train_tokens, vocabulary, train_docs, backoff)
        _, _, of = block.pairs(buckets)
        base, score = automaton.read(block.tokens, of)
        first = np.cumsum(block.sizes) - block.sizes
        known = np.add.reduceat((automaton.counts[block.tokens] > 0).astype(np.int64), first)
        return pa.table({
            "id": pa.array(block.ids, table.schema.field("ids").type.value_type), "held_out": pa.array(block.held), "n_tokens": pa.array(block.sizes),
            "n_known": pa.array(known), "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(score, first)),
        })

    return run


def scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text", held: Column | None = None, backoff: float = BACKOFF) -> DataFrame:
    """Per row its id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    ``held``: which rows the model does not learn from.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(held_out(id_column) if held is None else held, F.lit(True)).alias("held"), whole_text(text).alias("text"))
    blocks = settled(_blocks(read, kind, buckets), "lm-blocks")
    texts = blocks.filter("kind = 'docs'")
    merged = settled(blocks.filter("kind = 'words'").groupBy("bucket").applyInArrow(_merge_words(buckets), _spec(kind)), "lm-words")
    totals = [(int(unpress(r["a"])[0]), int(unpress(r["b"])[0])) for r in merged.filter("kind = 'total'").select("a", "b").collect()]
    train_docs = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    train_tokens, vocabulary = sum(t for t, _ in totals) + train_docs, sum(v for _, v in totals) + (train_docs > 0)
    numbers = merged.filter("kind = 'numbers'")
    sent = texts.unionByName(numbers).groupBy("block").applyInArrow(_send_pairs(buckets), _spec(kind))
    counted = sent.groupBy("bucket").applyInArrow(_merge_pairs, _spec(kind))
    result = texts.unionByName(numbers).unionByName(counted).groupBy("block").applyInArrow(
        _score(buckets, train_tokens, vocabulary, train_docs, backoff),
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return result.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
