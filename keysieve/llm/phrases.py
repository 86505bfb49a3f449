"""Phrase collocations by counting longest windows and summing their prefixes.

Every word begins one window of ``max_words`` words, padded where its piece
ends. Only these windows are counted. The count of a shorter phrase is the sum
over the windows that it begins, so no second set of n-grams is made: Spark's
ROLLUP adds up successively shorter prefixes of the lead columns.

Most windows occur once, and phrases below ``min_count`` matter only for the
sums of their prefixes. So windows are counted per task, meet in buckets by
their hash, and what stays below ``min_count`` goes on without its last word to
buckets by the hash of the rest, order by order. What reaches the ROLLUP are
the frequent windows and, padded, the sums of all others: every occurrence once. Equal windows are combined before each shuffle and the hash
covers the whole key, so a very common word or pair never meets in one task.

Defined cases
-------------
* Null and empty texts have no words. A null language counts as ``und``.
* Words are what white space (space, tab) and the cutting signs leave; other
  control characters belong to words. Only A-Z are lower-cased.
* Repeated rows count again; ids and other columns play no part.
* Ties in score go to the more frequent phrase, then to the first in UTF-8
  byte order. A language without candidates, or an empty table, gives no rows.
* Counts are 64-bit, products 38 decimal digits wide (counts up to 10^13).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm.common import press, settled, unpress
from keysieve.operators.skew import SPREAD, join_groups

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
UNIT = 1_000_000
#: A phrase goes if a longer one has at least this share of its occurrences.
INSIDE_PERCENT = 50
NO_LANGUAGE = "und"
#: Words a task holds before it counts them; bytes of text per bucket of windows.
CHUNK_WORDS = 1_000_000
BUCKET_BYTES = 8 << 20
SLICE_BYTES = 4 << 20
#: Occurrences from which on a phrase's candidates are spread over tasks.
COMMON = 200_000

#: No UTF-8 text holds this byte: it stands for the end of a piece.
_CUT = b"\xff"
_FLAT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _CUT * 10 + b" ")
_GAP = re.compile(rb"[ \xff]")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "bucket int, words binary, keys array<binary>, counts array<binary>"
_PARTS = f"{_BLOCK}, lang string, phrase array<string>, n bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Numbers of words in order of appearance; the padding and the cut are 0. Languages are words of their own kind."""

    def __init__(self) -> None:
        super().__init__({b"": 0, _CUT: 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.words)
        self.words.append(word)
        return value

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))


def _language(word: bytes) -> str:
    return bytes.fromhex(word[1:].decode()).decode()


def words_of(text: str) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, a slice at a time; ``_CUT`` stands between its pieces."""
    data = text.encode().translate(_FLAT).lower()
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + SLICE_BYTES)
        end = gap.start() if gap else len(data)
        yield data[start:end].replace(_CUT, b" \xff ").split()
        start = end


def summed(keys: list[np.ndarray], size: int, *counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the columns ``keys`` (numbers below ``size``), in order, and their sums of each of ``counts``, or numbers."""
    levels, place = [], keys[0].astype(np.int64)
    for column in keys[1:]:
        values, place = np.unique(place, return_inverse=True)
        levels.append(values)
        place = place * size + column
    if counts:
        values, place = np.unique(place, return_inverse=True)
        totals = [np.bincount(place, weights=c, minlength=len(values)).astype(np.int64) for c in counts]
    else:
        values, number = np.unique(place, return_counts=True)
        totals = [number]
    out = []
    for level in reversed(levels):
        out.append(values % size)
        values = level[values // size]
    return [values, *reversed(out)], totals


def _blocks(keys: list[np.ndarray], counts: list[np.ndarray], words: list[bytes], hashes: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of ``_BLOCK``: the keys of every bucket with the words they use."""
    vocabulary = pa.array(words, pa.binary())
    mixed = np.zeros(len(keys[0]), dtype=np.uint64)
    for column in keys:
        mixed = _mix(mixed * _GOLDEN + hashes[column])
    bucket = (mixed >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[b] : bounds[b + 1]]
        used = np.zeros(len(words), dtype=bool)
        for column in keys:
            used[column[own]] = True
        number = np.cumsum(used) - 1
        own_words = vocabulary.take(pa.array(np.flatnonzero(used)))
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(own_words)], own_words), b" ")[0].as_py()
        yield int(b), zstandard.ZstdCompressor(level=1).compress(text), [press(number[c[own]]) for c in keys], [press(c[own]) for c in counts]


def _batch(blocks: list[tuple], phrases: list[tuple] = ()) -> pa.RecordBatch:
    """``_PARTS`` rows: blocks first, then (lang, phrase, n)."""
    none = [None] * len(phrases)
    columns = list(zip(*blocks, strict=True)) or [()] * 4
    found = list(zip(*phrases, strict=True)) or [()] * 3
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.string(), pa.list_(pa.string()), pa.int64()]
    arrays = [[*c, *none] for c in columns] + [[None] * len(blocks) + list(c) for c in found]
    names = ["bucket", "words", "keys", "counts", "lang", "phrase", "n"]
    return pa.record_batch([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=names)


def _windows(docs: DataFrame, max_words: int, buckets: int) -> DataFrame:
    """Longest windows of every text, counted per task and dealt into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        codes: list[np.ndarray] = []
        langs: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal numbers, held
            flat, lang = np.concatenate(codes), np.concatenate(langs)
            starts = np.flatnonzero(flat)
            columns, lead = [lang[starts], flat[starts]], flat
            for k in range(1, max_words):
                # A window that has met its piece's end stays padded.
                lead = np.where(lead[: len(flat)] != 0, np.append(flat[k:], np.zeros(k, np.int32))[: len(flat)], 0)
                columns.append(lead[starts])
            keys, counts = summed(columns, len(numbers.words))
            for block in _blocks(keys, counts, numbers.words, numbers.hashes(), buckets):
                yield _batch([block])
            numbers = _Numbers()
            codes.clear()
            langs.clear()
            held = 0

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                named = numbers[b"\xff" + lang.as_py().encode().hex().encode()]
                for words in words_of(text.as_py() or ""):
                    codes.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                    langs.append(np.full(len(words), named, dtype=np.int32))
                    held += len(words)
                codes.append(np.zeros(1, dtype=np.int32))
                langs.append(np.zeros(1, dtype=np.int32))
                if held >= CHUNK_WORDS:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, _PARTS)


def _merge(parts: DataFrame, order: int, min_count: int, buckets: int) -> DataFrame:
    """One order of windows: frequent ones as phrases, all of them as blocks without their last word.

    A block has two counts of a window: all its occurrences, by which it is
    frequent or not, and those that no longer phrase has taken yet.
    """

    def run(table: pa.Table) -> pa.Table:
        numbers = _Numbers()
        columns: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        counts: list[list[np.ndarray]] = [[], []]
        for words, keys, n in zip(table["words"], table["keys"], table["counts"], strict=True):
            # Splitting keeps the padding, which is an empty word.
            own = zstandard.ZstdDecompressor().decompress(words.as_py()).split(b" ")
            lookup = np.fromiter(map(numbers.__getitem__, own), dtype=np.int32, count=len(own))
            for column, key in zip(columns, keys.as_py(), strict=True):
                column.append(lookup[unpress(key)])
            # Windows of full length have one count, which is both.
            for count, values in zip(counts, (n.as_py() * 2)[:2], strict=True):
                count.append(unpress(values))
        words = numbers.words
        keys, (total, left) = summed([np.concatenate(c) for c in columns], len(words), *(np.concatenate(c) for c in counts))
        often = (total >= min_count) & (keys[-1] != 0)
        taken = often & (left > 0)
        phrases = []
        for row in zip(*(k[taken].tolist() for k in keys), left[taken].tolist(), strict=True):
            lang, *phrase = [words[i] for i in row[:-1]]
            phrases.append((_language(lang), [p.decode() for p in phrase], row[-1]))
        shorter, (total, left) = summed(keys[:-1], len(words), total, np.where(often, 0, left))
        if order == 1:
            phrases += [(_language(words[i]), [], n) for i, n in zip(shorter[0].tolist(), left.tolist(), strict=True)]
            blocks = []
        else:
            blocks = list(_blocks(shorter, [total, left], words, numbers.hashes(), buckets))
        return pa.Table.from_batches([_batch(blocks, phrases)])

    return parts.filter("bucket is not null").select("bucket", "words", "keys", "counts").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, _PARTS)


def prefix_sums(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, size, phrase, n``: words of a language (size 0, empty phrase) and all phrases that occur ``min_count`` times."""
    named = docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit(NO_LANGUAGE)).alias("lang"))
    size = named.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    parts = _windows(named, max_words, buckets)
    found = None
    for order in range(max_words, 0, -1):
        parts = settled(_merge(parts, order, min_count, buckets), f"phrases-{order}")
        phrases = parts.filter("bucket is null").select("lang", "phrase", "n")
        found = phrases if found is None else found.unionByName(phrases)
    lead = [F.coalesce(F.get("phrase", F.lit(k)), F.lit("")).alias(f"w{k}") for k in range(max_words)]
    names = [f"w{k}" for k in range(max_words)]
    sums = found.select("lang", *lead, "n").rollup("lang", *names).agg(F.sum("n").alias("n"))
    # Rolled-up columns are null; padded ones are empty and stand for no phrase.
    phrase = F.array_compact(F.array(*names))
    kept = sums.filter("lang is not null").withColumn("phrase", phrase).withColumn("size", F.size("phrase"))
    whole = (F.col("size") == 0) | ((F.element_at("phrase", -1) != "") & (F.col("n") >= min_count))
    return kept.filter(whole).select("lang", "size", "phrase", "n")


def _decimal(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def _with_count(cuts: DataFrame, parts: DataFrame, side: str, name: str) -> DataFrame:
    """``cuts`` with the count of their part ``side`` as ``name``.

    A common part begins or ends many candidates: those are spread, and its one
    row is repeated. A part has at most ``max_words - 1`` candidates on a side
    for every ``min_count`` of its occurrences, so the others have few.
    """
    common = parts.filter(F.col("count") >= COMMON).select("lang", F.col("part").alias(side), F.lit(True).alias("__common"))
    salt = F.when(F.col("__common"), F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")
    salted = cuts.join(F.broadcast(common), ["lang", side], "left").withColumn("__salt", salt).drop("__common")
    salts = F.when(F.col("count") >= COMMON, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    repeated = parts.select("lang", F.col("part").alias(side), F.col("count").alias(name), F.explode(salts).alias("__salt"))
    return salted.join(repeated, ["lang", side, "__salt"]).drop("__salt")


def scored(sums: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Candidates with their lowest-scoring cut: ``lang, phrase, a, l, r, n, score`` and ``words``.

    ``sums`` is read several times; give a written table.
    """
    # No cut has a part of full length.
    by_phrase = sums.filter((F.col("size") > 0) & (F.col("size") < max_words)).select("lang", F.array_join("phrase", " ").alias("part"), F.col("n").alias("count"))
    cuts = sums.filter("size > 1").select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    cuts = cuts.withColumns({"head": F.array_join(F.slice("phrase", F.lit(1), F.col("k")), " "),
                             "tail": F.array_join(F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")), " ")})
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = _with_count(cuts, by_phrase, side, name)
    a, l, r = (_decimal(F.col(c)) for c in ("a", "l", "r"))
    cuts = cuts.withColumns({"__a": a, "__l": l, "__r": r}).withColumn("score", F.expr(f"({UNIT}BD * __a * __a) div (__l * __r)"))
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    total = sums.filter("size = 0").select("lang", "n")
    out = join_groups(least, total, "lang", "inner", ("phrase",))
    return out.select("lang", F.array_join("phrase", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"), F.col("phrase").alias("words"))


def outermost(candidates: DataFrame, sums: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """``candidates`` without those that lie inside a longer phrase with ``percent`` of their occurrences."""
    size = F.size("phrase")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: F.array_join(F.slice("phrase", at, m), " ")),
    ))
    inner = sums.filter("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n")
    largest = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    joined = candidates.join(largest, ["lang", "phrase"], "left")
    return joined.filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP
) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    sums = settled(prefix_sums(docs, text, lang, max_words, min_count), "prefix-sums")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = outermost(scored(sums, max_words), sums).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
