"""Removal of byte strings that earlier documents hold, over merged shard BWTs.

Every string of ``WINDOW`` bytes is assigned to one of its own ``GRAM``-byte
grams, the one with the least hash (its anchor): equal strings have equal
anchors. Neighbouring strings with one anchor form a segment.

1. Blocks of documents send the hashes of their anchors to buckets, which
   answer which of them other documents have too.
2. Blocks send their distinct segments at such anchors, with the smallest
   document id, to buckets by anchor.
3. A bucket puts the distinct segments of each block into a shard with a suffix
   array of bounded order and its Burrows-Wheeler transform, and merges: the
   interleave starts with one shard after another and is refined by stable
   sorting on the transform's symbols, two bytes a round, until it is right for
   ``WINDOW`` bytes. Where neighbours first differ bounds their common prefix;
   what never differs is a repeated interval, whose smallest document id goes
   back to the blocks for every string in it.
4. Blocks mark the strings whose smallest document id is below their own.

An anchor at which all segments are equal needs no merge. Suffixes no longer
within reach of a string's start are left out of later rounds.

Defined cases
-------------
* A null or empty text has no bytes. Texts shorter than the window stay whole.
* A row without an id is left as it is and is no earlier document to any other.
* Rows with the same id are one document: none of them is earlier than another.
* Strings never cross documents and are judged on the input. Texts are taken
  whole; very long ones are hashed piece by piece. Other columns play no part.
* Equal segments of a block are found by a 64-bit hash; across blocks by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import press, settled, unpress

WINDOW = 50
GRAM = 25
BLOCK_BYTES = 6_000_000
BUCKET_BYTES = 6_000_000
PIECE = 1_000_000
#: Bytes by which shards are sorted before the merge.
SHARD_ORDER = 16

_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15
#: Anchor hashes travel with the bits of the input's size and so many more: they only say where to look.
SPARE_BITS = 6
_SPEC = "kind string, block bigint, bucket int, a binary, b binary, c binary, d binary"
_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in "abcd")])

_powers: dict[int, np.ndarray] = {}


def _computed(base: int, n: int) -> np.ndarray:
    steps = np.full(n, _U(base))
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64; only what a piece needs stays in memory."""
    kept = PIECE + 2 * WINDOW
    if n > kept:
        return _computed(base, n)
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = _computed(base, kept)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


class _Hashes:
    """Hashes of any byte ranges of one array, by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.inverse = _power(pow(_FACTOR, -1, 1 << 64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=_U)
        power = _power(_FACTOR, len(data))
        for at in range(0, len(data), PIECE):
            part = slice(at, at + PIECE)
            np.cumsum((data[part].astype(_U) + _U(1)) * power[part], out=self.sums[1:][part])
            self.sums[1:][part] += self.sums[at]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self) -> np.ndarray:
        return _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: len(self.sums) - GRAM])


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width``."""
    done, out = 1, a
    while 2 * done <= width:
        out, done = pick(out[:-done], out[done:]), 2 * done
    if done < width:
        out = pick(out[: len(out) - (width - done)], out[width - done :])
    return out


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, anchor place and anchor hash of every segment of a text."""
    firsts, places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, _U)]
    width = WINDOW - GRAM + 1
    edge = np.zeros(width - 1, dtype=np.uint32)
    for at in range(0, len(data) - WINDOW + 1, PIECE):
        whole = _Hashes(data[at : at + PIECE + WINDOW - 1]).grams()
        gram = (whole >> _U(32)).astype(np.uint32)
        least = _slide(gram, width, np.minimum)
        chosen = _slide(np.concatenate([edge, least, edge]), width, np.maximum) == gram
        anchors = np.flatnonzero(chosen)
        # The first anchor from each window's start on, and then the first of them with the least hash.
        own = np.cumsum(chosen[: len(least)], dtype=np.int32) - chosen[: len(least)]
        value = gram[anchors]
        off = np.flatnonzero(value[own] != least)
        while off.size:
            own[off] += 1
            off = off[value[own[off]] != least[off]]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        firsts.append(at + first)
        places.append(at + anchors[own[first]])
        hashes.append(whole[places[-1] - at])
    return np.concatenate(firsts), np.concatenate(places), np.concatenate(hashes)


def _row(kind: str, block: int, bucket: int, *parts: bytes) -> dict:
    return {"kind": kind, "block": block, "bucket": bucket} | dict(zip("abcd", parts, strict=False))


def _bits(flags: np.ndarray) -> bytes:
    return press(np.packbits(flags))


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpress(data).astype(np.uint8))[:n].astype(bool)


class Block:
    """Distinct texts of a block, the documents that hold them, and their segments."""

    def __init__(self, ids: np.ndarray, text_of: np.ndarray, sizes: np.ndarray, data: np.ndarray, first: np.ndarray, place: np.ndarray, gram: np.ndarray | None = None) -> None:
        self.ids, self.text_of, self.sizes, self.data, self.first, self.place = ids, text_of, sizes, data, first, place
        self.gram = self.hashes.of(place, place + GRAM) if gram is None else gram
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.searchsorted(self.starts, first, side="right") - 1
        # A segment ends where the next begins, or with the last window of its text.
        self.ends = np.minimum(np.append(first[1:], len(data)), self.starts[owner + 1] - WINDOW + 1)
        self.owner = owner
        self.least = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(self.least, text_of, ids)
        self.most = np.full(len(sizes), np.iinfo(np.int64).min)
        np.maximum.at(self.most, text_of, ids)

    @classmethod
    def of(cls, ids: list[int], texts: list[bytes]) -> Block:
        numbers: dict[bytes, int] = {}
        text_of = np.array([numbers.setdefault(t, len(numbers)) for t in texts])
        sizes = np.array([len(t) for t in numbers], dtype=np.int64)
        firsts, places, grams = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, _U)]
        at = 0
        for t in numbers:
            first, place, gram = segments(np.frombuffer(t, dtype=np.uint8))
            firsts.append(first + at)
            places.append(place + at)
            grams.append(gram)
            at += len(t)
        data = np.frombuffer(b"".join(numbers), dtype=np.uint8)
        return cls(np.array(ids, dtype=np.int64), text_of, sizes, data, np.concatenate(firsts), np.concatenate(places), np.concatenate(grams))

    def pack(self, block: int) -> dict:
        head = np.concatenate([[len(self.ids), len(self.sizes)], self.ids, self.text_of, self.sizes]).astype(np.int64)
        places = press(np.diff(self.first, prepend=0)), press(self.place - self.first)
        return _row("texts", block, -1, zstandard.compress(head.tobytes(), 3), zstandard.compress(self.data.tobytes(), 3), *places)

    @classmethod
    def unpack(cls, row: dict) -> Block:
        head = np.frombuffer(zstandard.decompress(row["a"]), dtype=np.int64)
        n, m = head[:2]
        first = np.cumsum(unpress(row["c"]))
        data = np.frombuffer(zstandard.decompress(row["b"]), dtype=np.uint8)
        return cls(head[2 : 2 + n], head[2 + n : 2 + 2 * n], head[2 + 2 * n : 2 + 2 * n + m], data, first, first + unpress(row["d"]))

    def anchors(self, buckets: int, bits: int):
        """Sent hashes by (bucket, hash), distinct; the edges of the buckets; the number of each segment's."""
        sent = self.gram >> _U(64 - bits)
        distinct, of = np.unique(sent, return_inverse=True)
        bucket = (distinct % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return distinct[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), back[of]

    @property
    def hashes(self) -> _Hashes:
        if not hasattr(self, "_hashes"):
            self._hashes = _Hashes(self.data)
        return self._hashes

    def repeated(self, answers: list[dict], buckets: int, bits: int):
        """Segments at anchors that other documents have: their places, and the distinct ones in sending order."""
        distinct, edges, of = self.anchors(buckets, bits)
        found = np.zeros(len(distinct), dtype=bool)
        for r in answers:
            own = slice(edges[r["bucket"]], edges[r["bucket"] + 1])
            found[own] = _flags(r["a"], own.stop - own.start)
        chosen = np.flatnonzero(found[of])
        sent = distinct[of[chosen]]
        whole = self.hashes.of(self.first[chosen], self.ends[chosen] + WINDOW - 1)
        _, one, number = np.unique(whole, return_index=True, return_inverse=True)
        bucket = (sent[one] % _U(buckets)).astype(np.int64)
        order = np.lexsort((sent[one], bucket))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return chosen, back[number], chosen[one[order]], sent[one[order]], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _first_job(buckets: int, bits: int):
    def send(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        name, block = uuid.uuid4().int >> 65, Block.of(ids, texts)
        rows = [block.pack(name)]
        distinct, edges, of = block.anchors(buckets, bits)
        # An anchor is shared within the block if documents with different ids have it.
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, of, block.least[block.owner])
        np.maximum.at(high, of, block.most[block.owner])
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[bucket], edges[bucket + 1])
            rows.append(_row("anchors", name, bucket, press(np.diff(distinct[own], prepend=_U(0))), _bits(low[own] != high[own])))
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for one, text in zip(*batch.columns, strict=True):
                ids.append(one.as_py())
                texts.append(text.as_py().encode())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield send(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield send(ids, texts)

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    rows = table.select(["block", "bucket", "a", "b"]).to_pylist()
    sent = [np.cumsum(unpress(r["a"])) for r in rows]
    distinct, of, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared = counts > 1
    ends = np.cumsum([len(s) for s in sent])
    for r, s, end in zip(rows, sent, ends, strict=True):
        shared[of[end - len(s) : end]] |= _flags(r["b"], len(s))
    return pa.Table.from_pylist([_row("shared", r["block"], r["bucket"], _bits(shared[of[end - len(s) : end]])) for r, s, end in zip(rows, sent, ends, strict=True)], schema=_ARROW)


def _send_segments(buckets: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block.unpack(next(r for r in rows if r["kind"] == "texts"))
        chosen, number, one, sent, edges = block.repeated([r for r in rows if r["kind"] == "shared"], buckets, bits)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, number, block.least[block.owner[chosen]])
        windows = block.ends[one] - block.first[one]
        out = []
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[bucket], edges[bucket + 1])
            data = block.data[_ranges(block.first[one[own]], windows[own] + WINDOW - 1)].tobytes()
            numbers = press(windows[own]), least[own].tobytes(), press(np.diff(sent[own], prepend=_U(0)))
            out.append(_row("segments", rows[0]["block"], bucket, zstandard.compress(data, 3), numbers[0], zstandard.compress(numbers[1], 3), numbers[2]))
        return pa.Table.from_pylist(out, schema=_ARROW)

    return run


def shard_arrays(data: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Places by shard and, within it, by suffix; suffixes are compared over ``SHARD_ORDER`` bytes."""
    padded = np.concatenate([data, np.zeros(SHARD_ORDER + 8, np.uint8)])
    word = np.zeros(len(data) + SHARD_ORDER, dtype=_U)
    for k in range(8):
        word = (word << _U(8)) | padded[k : k + len(word)]
    keys = [word[k : k + len(data)] for k in range(SHARD_ORDER - 8, -1, -8)]
    edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(data)]
    return np.concatenate([a + np.lexsort([k[a:b] for k in keys]) for a, b in zip(edges[:-1], edges[1:], strict=True)]).astype(np.int32)


def merge_transforms(data: np.ndarray, shard: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' transforms: window places in merged order, and the interval of equal windows each lies in.

    ``data``: segments one after another; ``shard``: of every byte, ascending;
    segment k begins at ``starts[k]`` and has ``windows[k]`` windows.
    """
    # A window is reached from the byte after it: the last segment's last one needs a place past the end.
    data, shard = np.append(data, np.uint8(0)), np.append(shard, shard[-1])
    array = shard_arrays(data, shard)
    rank = np.empty(len(array), dtype=np.int32)
    rank[array] = np.arange(len(array), dtype=np.int32)
    # The transform in steps of two bytes: what stands before each suffix, and whose suffix that is.
    back = np.maximum(array - 2, 0)
    symbol = (data[back].astype(np.uint16) << 8) | data[back + 1]
    step = rank[back]
    # To how many bytes the order must be right for a suffix: those past the last window serve the ones before.
    offset = np.append(np.arange(len(data) - 1) - np.repeat(starts + windows - 1, windows + WINDOW - 1), WINDOW)
    depth = (WINDOW - np.maximum(offset, 0)).astype(np.int8)[array]
    reach = np.where(array >= 2, depth[step], np.int8(-1))
    order, interval = np.arange(len(array), dtype=np.int32), np.zeros(len(array), dtype=np.int32)
    for right in range(2, WINDOW + 1, 2):
        alive = reach[order] >= right
        order, interval = order[alive], interval[alive]
        key = symbol[order]
        sort = np.argsort(key, kind="stable")
        order, interval, key = order[sort], interval[sort], key[sort]
        differs = (key[1:] != key[:-1]) | (interval[1:] != interval[:-1])
        interval = np.concatenate([np.zeros(min(len(order), 1), np.int32), np.cumsum(differs, dtype=np.int32)])
        order = step[order]
    return array[order], interval


def _merge_segments(table: pa.Table) -> pa.Table:
    rows = sorted(table.select(["block", "bucket", "a", "b", "c", "d"]).to_pylist(), key=lambda r: r["block"])
    known: dict[tuple[int, bytes], int] = {}
    numbers, windows, least, anchor, shard = [], [], [], [], []
    for s, r in enumerate(rows):
        data, sizes = zstandard.decompress(r["a"]), unpress(r["b"])
        sent, own = np.cumsum(unpress(r["d"])).tolist(), np.frombuffer(zstandard.decompress(r["c"]), dtype=np.int64).tolist()
        ends = np.cumsum(sizes + WINDOW - 1).tolist()
        number = []
        for size, end, key, doc in zip(sizes.tolist(), ends, sent, own, strict=True):
            k = known.setdefault((key, data[end - size - WINDOW + 1 : end]), len(known))
            if k == len(least):
                windows.append(size)
                least.append(doc)
                anchor.append(key)
                shard.append(s)
            elif doc < least[k]:
                least[k] = doc
            number.append(k)
        numbers.append(np.array(number, dtype=np.int64))
    windows, least, anchor, shard = (np.array(x, dtype=np.int64) for x in (windows, least, anchor, shard))
    # Smallest document id per window: that of its segment, unless segments at its anchor differ.
    first = np.cumsum(windows) - windows
    smallest = np.repeat(least, windows)
    _, of, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(counts[of] > 1)
    if len(mixed):
        mixed = mixed[np.argsort(shard[mixed], kind="stable")]
        texts = list(known)
        lengths = windows[mixed] + WINDOW - 1
        data = np.frombuffer(b"".join(texts[k][1] for k in mixed.tolist()), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        merged, interval = merge_transforms(data, np.repeat(shard[mixed], lengths), starts, windows[mixed])
        owner = np.searchsorted(starts, merged, side="right") - 1
        docs = least[mixed[owner]]
        low = np.minimum.reduceat(docs, np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]]))[interval]
        smallest[first[mixed[owner]] + merged - starts[owner]] = low
    out = []
    for r, number in zip(rows, numbers, strict=True):
        values = smallest[_ranges(first[number], windows[number])]
        begins = np.zeros(len(values), dtype=bool)
        begins[np.cumsum(windows[number]) - windows[number]] = True
        turns = begins | np.r_[True, values[1:] != values[:-1]]
        out.append(_row("smallest", r["block"], r["bucket"], _bits(turns), zstandard.compress(values[turns].tobytes(), 3), press(np.array([len(values)]))))
    return pa.Table.from_pylist(out, schema=_ARROW)


def _clean(buckets: int, bits: int, as_text: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block.unpack(next(r for r in rows if r["kind"] == "texts"))
        chosen, number, one, _, edges = block.repeated([r for r in rows if r["kind"] == "shared"], buckets, bits)
        windows = block.ends[one] - block.first[one]
        at = np.cumsum(windows) - windows
        smallest = np.empty(int(windows.sum()), dtype=np.int64)
        for r in rows:
            if r["kind"] == "smallest":
                n = int(unpress(r["c"])[0])
                turns, start = _flags(r["a"], n), at[edges[r["bucket"]]]
                smallest[start : start + n] = np.frombuffer(zstandard.decompress(r["b"]), dtype=np.int64)[np.cumsum(turns) - 1]
        lengths = windows[number]
        place, low = _ranges(block.first[chosen], lengths), smallest[_ranges(at[number], lengths)]
        edges = np.searchsorted(place, block.starts)
        whole = block.data.tobytes()
        found: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept", "address")}
        for doc, text in zip(block.ids.tolist(), block.text_of.tolist(), strict=True):
            a, b = edges[text], edges[text + 1]
            hit = place[a:b][low[a:b] < doc]
            begin, end = int(block.starts[text]), int(block.starts[text + 1])
            cut = np.flatnonzero(np.diff(hit) > WINDOW)
            begins, ends = hit[np.r_[0, cut + 1]].tolist() if len(hit) else [], (hit[np.r_[cut, len(hit) - 1]] + WINDOW).tolist() if len(hit) else []
            found["address"].append(hashlib.sha256(whole[begin:end]).digest() if as_text else None)
            found["n_bytes"].append(end - begin)
            found["n_removed"].append(sum(ends) - sum(begins))
            found["n_spans"].append(len(begins))
            parts = [whole[x:y] for x, y in zip([begin, *ends], [*begins, end], strict=True)]
            found["kept"].append("".join(p.decode(errors="ignore") for p in parts) if as_text else b"".join(parts))
        kinds = {"kept": pa.string() if as_text else pa.binary(), "address": pa.binary()}
        if not as_text:
            del found["address"]
        return pa.table({"id": pa.array(block.ids), **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()}})

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """Per row its id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes).

    ``as_text``: ``kept`` is a string, without characters of which a part was removed,
    and ``address`` is the SHA-256 of the whole text, which tells rows with one id apart.
    """
    text_column = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("id"), text_column.alias("text"))
    size = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, bits = max(1, -(-size // BUCKET_BYTES)), min(64, int(size).bit_length() + SPARE_BITS)
    sent = settled(read.filter("id is not null").mapInArrow(_first_job(buckets, bits), _SPEC), "suffix-blocks")
    texts = sent.filter("kind = 'texts'")
    shared = settled(sent.filter("kind = 'anchors'").groupBy("bucket").applyInArrow(_answer_anchors, _SPEC), "suffix-anchors")
    segments_sent = texts.unionByName(shared).groupBy("block").applyInArrow(_send_segments(buckets, bits), _SPEC)
    smallest = segments_sent.groupBy("bucket").applyInArrow(_merge_segments, _SPEC)
    out = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept " + ("string, address binary" if as_text else "binary")
    cleaned = texts.unionByName(shared).unionByName(smallest).groupBy("block").applyInArrow(_clean(buckets, bits, as_text), out)
    zero = F.lit(0).cast("long")
    rest = read.filter("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("string" if as_text else "binary").alias("kept"), *[F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("address")] * as_text)
    return cleaned.unionByName(rest).withColumnRenamed("id", id_column)
