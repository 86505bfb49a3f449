"""Near-duplicate classes by BagMinHash signatures, banding and verified overlap.

A text is the multiset of its shingles of five words. Every shingle owns one
Poisson process per level of its weight: level 0 covers weights [0, 1), level
l covers [2^(l-1), 2^l), each at a rate equal to its length, so that a shingle
that occurs w times takes ``log2(w)`` processes. Points come in ascending
order of time; a point of a level that the weight covers in part counts if its
own place in the level lies below the weight. Each point belongs to one
component of the signature, which keeps its earliest point: two texts agree in
a component with the probability of their weighted Jaccard similarity. Points
later than the time by which all components are surely hit are never made.

Bands of components put texts into buckets. In every bucket one leader is
compared with all members; what is similar joins its class. Where members of
several classes are left, they meet again in cells, by single items in which
they differ from the leader: similar texts that the leader leaves in two
classes have at least one of their first differences in common. Members far
from the leader stay in their bucket without it. Within cells and such buckets, texts of
other classes than the largest lead in rounds, more and more of them,
and are compared with texts of other classes, unless their overlaps with the
first leader and with further candidates bound their own too low. It ends when
no text outside its cell's largest class is left that has not led. So every
pair of bucket members that end in different classes was compared or ruled
out, and a group of copies is never expanded into all its pairs. Similarity is
that of whole texts, as multisets of 64-bit shingle hashes.

Defined cases
-------------
* Equal texts are one class, empty ones as well; a null text is its own class.
* A text of one to four words is one shingle. A text without words is similar
  only to texts equal to it.
* Every input row gives one row, repeated rows too. ``class_id`` is the
  smallest id of the class; a null id is a class of its own if its text is,
  else it takes part like any other (null is never the class id then).
* Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm.common import first_rows, marked, settled

WIDTH = 5
THRESHOLD = 0.8
#: At similarity 0.8, a pair misses all bands with a probability of about 2e-5.
BANDS, ROWS = 36, 6
#: So many of a cell lead in the first round after the leader's, and so many times as many in each that follows.
FIRST, GROWTH = 64, 8
#: Members of a bucket that are farther than this from its leader stay together.
FAR = 0.6
BLOCK_TEXTS = 1000
BATCH_WORDS = 125_000
CACHE_ENTRIES = 200_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_weights(words: list[list[bytes]], hashes: dict, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and weight of every distinct shingle of every text, by text."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((hashes[x] for w in words for x in w), dtype=np.uint64, count=int(sizes.sum()))
    text = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = np.zeros(len(flat), dtype=np.uint64)
    for k in range(width):
        ahead = np.zeros(len(flat), dtype=np.uint64)
        ahead[: max(len(flat) - k, 0)] = flat[k:]
        # Words past the end of a short text count as nothing.
        ahead[place + k >= np.repeat(sizes, sizes)] = 0
        value = _mix(value + _GOLDEN) + ahead
    starts = (place == 0) | (place + width <= np.repeat(sizes, sizes))
    value, text = _mix(value[starts]), text[starts]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])]) if len(value) else np.empty(0, np.int64)
    return text[first], value[first], np.diff(np.r_[first, len(value)])


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures: per text and component, the time of its earliest point."""
    total = np.bincount(text, weights=weight, minlength=n_texts)
    # One process per level below the weight.
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    item = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1.0), 0.0)
    length = np.where(level > 0, low, 1.0)
    owner, top = text[item], weight[item].astype(np.float64)
    seed = _mix(shingle[item] + level.astype(np.uint64) * _GOLDEN)
    rate = length * size
    signature = np.full(n_texts * size, np.inf)
    limit = np.where(total > 0, (np.log(size) + 3) / np.maximum(total, 1), 0.0)
    time, step = np.zeros(len(item)), np.zeros(len(item), dtype=np.uint64)
    # ``time`` is that of the next point of each process.
    time += -np.log1p(-(_mix(seed + _GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
    while True:
        active = np.flatnonzero(time <= limit[owner])
        while len(active):
            ahead = 1 if len(active) > 20_000 else 64
            own, s, t, j, r = owner[active], seed[active], time[active], step[active], rate[active]
            for _ in range(ahead):
                point = _mix(s + (np.uint64(2) * j + np.uint64(2)) * _GOLDEN)
                component = ((point >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
                where = low[active] + (point & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length[active]
                counts = (where < top[active]) & (t <= limit[own])
                np.minimum.at(signature, own[counts] * size + component[counts], t[counts])
                # A process past its text's limit waits at its first point there: a later, wider limit counts it.
                going = t <= limit[own]
                j = j + going.astype(np.uint64)
                later = t + -np.log1p(-(_mix(s + (np.uint64(2) * j + np.uint64(1)) * _GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53) / r
                t = np.where(going, later, t)
                alive = t <= limit[own]
                if not alive.any():
                    break
                if ahead > 1 and alive.sum() < 0.5 * len(alive):
                    break
            time[active], step[active] = t, j
            active = active[alive]
        open_texts = np.isinf(signature.reshape(n_texts, size)).any(axis=1) & (total > 0)
        if not open_texts.any():
            return signature.reshape(n_texts, size)
        limit = np.where(open_texts, 2 * limit, 0.0)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * _GOLDEN + bits[:, :, r])
    return key.view(np.int64)


def _signed(docs: DataFrame, id_column: str, text: str, bands: int, rows: int) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            start = 0
            texts = batch.column(1).to_pylist()
            while start < len(texts):
                end, words, n = start, [], 0
                while end < len(texts) and (end == start or n < BATCH_WORDS):
                    words.append((texts[end] or "").encode().split())
                    n, end = n + len(words[-1]), end + 1
                keys = band_keys(signatures(*shingle_weights(words, hashes), len(words), bands * rows), bands, rows)
                lists = [k.tolist() if w else None for k, w in zip(keys, words, strict=True)]
                address = [None if t is None else hashlib.sha256(t.encode()).digest() for t in texts[start:end]]
                sizes = [max(len(w) - WIDTH + 1, 1) for w in words]
                yield pa.record_batch(
                    [batch.column(0).slice(start, end - start), pa.array(address, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["id", "address", "size", "keys"],
                )
                start = end

    return docs.select(id_column, text).mapInArrow(run, f"id {kind}, address binary, size bigint, keys array<bigint>").withColumn("row", F.monotonically_increasing_id())


def shingle_items(words: list[list[bytes]], hashes: dict) -> list[np.ndarray]:
    """Per text one 64-bit item for every occurrence of a shingle: the multiset as a set."""
    text, shingle, weight = shingle_weights(words, hashes)
    owner = np.repeat(np.arange(len(text)), weight)
    nth = (np.arange(len(owner)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
    items = _mix(shingle[owner] + nth * _GOLDEN).view(np.int64)
    return np.split(items, np.searchsorted(text[owner], np.arange(1, len(words))))


def _with_items(texts: DataFrame) -> DataFrame:
    """``node`` and ``items`` of candidate texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                items = shingle_items([t.as_py().encode().split() for t in part.column(1)], hashes)
                yield pa.record_batch([part.column(0), pa.array(items, pa.list_(pa.int64()))], names=["node", "items"])

    return texts.mapInArrow(run, "node bigint, items array<bigint>")


def similarities(items: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the pairs (a[i], b[i]) of item sets."""
    sizes = np.array([len(i) for i in items])
    numbers = np.unique(np.concatenate(items), return_inverse=True)[1]
    parts = np.split(numbers, np.cumsum(sizes)[:-1])
    common = np.zeros(len(a), dtype=np.int64)
    mark = np.zeros(len(numbers) + 1, dtype=bool)
    order = np.argsort(a, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        left = parts[a[own[0]]]
        mark[left] = True
        # The partners of one text, some at a time.
        for start in range(0, len(own), 256):
            some = own[start : start + 256]
            ends = np.cumsum(sizes[b[some]])
            hits = np.concatenate([[0], np.cumsum(mark[np.concatenate([parts[i] for i in b[some]])])])
            common[some] = hits[ends] - hits[ends - sizes[b[some]]]
        mark[left] = False
    union = sizes[a] + sizes[b] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def difference_keys(own: np.ndarray, leader: np.ndarray, name: int, threshold: float) -> np.ndarray:
    """Keys of the cells of an item set by its differences to a leader; both sets in order.

    Sets x and y of sizes n and m that are similar differ in at most
    k = (n + m) * s items, s being (1 - t) / (1 + t) for the threshold t. Let a
    and b be how many items they differ in from the leader: they have at least
    (a + b - k) / 2 of these in common. One of the two is not similar to the
    leader, or they were one class. If y is not, b exceeds (m + size of the
    leader) * s; if x is not, b is at least a - k, and m at most n / t. So two
    such sets have one of their first differences in common, in an order that
    the leader defines: items that it lacks before those that it alone has.
    """
    n = len(own)
    new, gone = np.setdiff1d(own, leader, assume_unique=True), np.setdiff1d(leader, own, assume_unique=True)
    a = len(new) + len(gone)
    common = (a + (len(leader) - n) * (1 - threshold) / (1 + threshold)) / 2
    if n - len(new) < threshold * (n + len(gone)) + 1e-6:
        common = min(common, a - n * (1 - threshold) / threshold)
    first = np.concatenate([new, gone])[: a - max(1, math.ceil(common - 1e-6)) + 1]
    return _mix(first.view(np.uint64) ^ _mix(np.array([name], dtype=np.int64).view(np.uint64))).view(np.int64)


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """One pair of blocks: rows with items are its texts, rows with a partner its pairs."""
        texts, pairs = table.filter(pc.is_valid(table["items"])), table.filter(pc.is_null(table["items"]))
        nodes = texts["node"].to_numpy()
        order = np.argsort(nodes)
        items = [texts["items"][int(i)].values.to_numpy() for i in order]
        a, b, keyed = pairs["node"].to_numpy(), pairs["partner"].to_numpy(), pairs["keyed"].to_pylist()
        left, right = np.searchsorted(nodes[order], a), np.searchsorted(nodes[order], b)
        found = similarities(items, left, right)
        keys: list[np.ndarray | None] = [None] * len(a)
        for i in np.flatnonzero(np.array(keyed, dtype=bool) & (found >= threshold - FAR - 1e-6)).tolist():
            keys[i] = difference_keys(np.sort(items[right[i]]), np.sort(items[left[i]]), int(a[i]), threshold)
        return pa.table({"a": pa.array(a), "b": pa.array(b), "sim": pa.array(found), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return run


def _verify(pairs: DataFrame, items: DataFrame, blocks: int, threshold: float) -> DataFrame:
    """``pairs`` (a, b, keyed) with the similarity of their whole texts and, if ``keyed``, ``keys`` of the cells of b by its differences to a.

    All pairs of a text ``b`` belong to the block of its first leader, so that
    it moves once; leaders go once to each block that needs them. A leader of
    very many texts has several blocks, each of about ``BLOCK_TEXTS``.
    """
    pairs = settled(pairs, "pairs")
    homed = pairs.withColumn("home", F.min("a").over(Window.partitionBy("b")))
    load = homed.filter("a = home").groupBy("home").agg(F.count(F.lit(1)).alias("load"))
    share = F.pmod(F.xxhash64("b"), F.ceil(F.col("load") / BLOCK_TEXTS))
    placed = homed.join(load, "home").select(F.pmod(F.xxhash64("home", share), F.lit(blocks)).alias("g"), "a", "b", "keyed")
    needed = placed.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    none = F.lit(None)
    rows = needed.join(items, "node").select("g", "node", none.cast("long").alias("partner"), none.cast("boolean").alias("keyed"), "items").unionByName(
        placed.select("g", F.col("a").alias("node"), F.col("b").alias("partner"), "keyed", none.cast("array<bigint>").alias("items"))
    )
    return rows.groupBy("g").applyInArrow(_compare(threshold), "a bigint, b bigint, sim double, keys array<bigint>")


def components(edges: DataFrame, passes: int | None = None) -> DataFrame:
    """``node`` and ``label`` (smallest node it is linked to) of all ends of ``edges`` (a, b).

    Each round takes the smallest label among the neighbours and then follows
    labels of labels, until nothing changes or, for labels that may still
    divide what is linked, ``passes`` times.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        stepped = settled(lower.join(far, "label", "left").select("node", F.least("label", "beyond").alias("label"), "was"), "labels")
        labels = stepped.select("node", "label")
        passes = None if passes is None else passes - 1
        if passes == 0 or stepped.filter("label <> was").isEmpty():
            return labels


def _chosen(places: DataFrame) -> DataFrame:
    """``bucket``, ``n`` and ``least`` (size of its smallest text) of the buckets of at least two texts; of buckets with equal members one."""
    texts = F.bit_xor(F.xxhash64("node")).alias("sum")
    buckets = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("size").alias("least"), texts)
    return buckets.filter("n > 1").groupBy("n", "low", "high", "least", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "least")


def _met(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``bucket, node, size``: the first rows of their texts in the buckets of at least two of them; of buckets with equal members one."""
    # Keys do not move with the rows they belong to. Few other rows of equal texts pass, which leave below.
    first = first_rows(signed.filter("keys is not null").select(F.col("row").alias("node"), "size", "keys"), nodes)
    # Most keys are a text's own: to deal the rows themselves, once, moves less than to deal partial counts and then rows.
    dealt = first.select("node", "size", F.explode("keys").alias("bucket")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    places = settled(dealt.filter("n > 1").drop("n").join(nodes.select("node"), "node", "left_semi"), "bucket-members")
    return places.join(_chosen(places), "bucket", "left_semi").select("bucket", "node", "size")


def _shared(places: DataFrame) -> DataFrame:
    """``places`` in buckets of at least two texts, with their number ``n``; buckets with equal members count once."""
    return places.join(_chosen(places.select("bucket", "node", "size")).drop("least"), "bucket")


def _members(bands: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Band buckets without the texts that cannot be similar to any other.

    ``shared`` counts a text's items that any other candidate has as well: no
    overlap is larger.
    """
    single = items.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    lone = single.filter("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    able = bands.join(lone, "node", "left").withColumn("shared", F.col("size") - F.coalesce("lone", F.lit(0)))
    return _shared(able.filter(F.col("shared") >= threshold * F.col("size") - 1e-6).drop("lone"))


def _pairs(met: DataFrame, tried: DataFrame) -> DataFrame:
    pairs = met.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti").withColumn("keyed", F.lit(False))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: their classes are linked instead of their texts."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    ends = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    open_links = settled(ends.filter("a <> b").distinct(), "open-links")
    if open_links.isEmpty():
        return labels
    merged = components(open_links).toDF("label", "into")
    known = labels.join(merged, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
    fresh = merged.toDF("node", "label").join(labels, "node", "left_anti")
    return settled(known.unionByName(fresh), "labels")


def _hopeful(members: DataFrame, threshold: float) -> DataFrame:
    """``members`` (bucket, node, size, shared) that may be similar to a text as small as the smallest there."""
    least = members.groupBy("bucket").agg(F.min("size").alias("least"))
    return members.join(least, "bucket").filter(_able("least", threshold)).drop("least")


def _able(least: str, threshold: float) -> Column:
    """Whether a text may be similar to any with ``least`` items or more."""
    # No partner shares more than ``shared`` items, nor has fewer than ``least``.
    union = F.col("size") + F.greatest(least, "shared") - F.col("shared")
    return F.col("shared") >= threshold * union - 1e-6


def _links(members: DataFrame, items: DataFrame, threshold: float) -> DataFrame | None:
    """Classes (node, label) of linked texts; None without any candidate.

    Round 0: in every bucket, the text with the most bucket places, which tends
    to lie in the middle of its group, is compared with all others. Members of
    several classes then go to cells by their differences to it. Later rounds:
    texts outside the cell's largest class so far lead, and are compared with
    the texts of other classes, unless what both share with the first leader,
    and with others, leaves too small an overlap.
    """
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    order = Window.partitionBy("bucket").orderBy(F.desc("weight"), F.xxhash64("node"), "node")

    def leading(some: DataFrame, take: int) -> DataFrame:
        """The first ``take`` of every bucket by ``nth``, and one more where there are more."""
        return some.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= take + 1)

    def possible(most: Column, least: float = threshold) -> Column:
        """Whether an overlap of ``most`` would make the texts similar."""
        return most >= least * (F.col("size") + F.col("sl") - most) - 1e-6

    members = settled(members.join(weight, "node"), "weighted-members")
    blocks = max(1, -(-items.count() // BLOCK_TEXTS))
    most = F.least("shared", "cl")
    first = settled(leading(members, 1).filter("nth = 1").select("bucket", F.col("node").alias("leader"), F.col("size").alias("sl"), F.col("shared").alias("cl")), "leaders")
    if first.isEmpty():
        return None
    # The order of leaders is one for all buckets: of two texts always the same one leads.
    met = first.join(members, "bucket").filter("leader <> node")
    pairs = met.filter(possible(most, threshold - FAR)).groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max(F.col("n") > 2).alias("keyed"))
    sims = settled(_verify(pairs, items, blocks, threshold), "similarities")
    tried = sims.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # One pass joins what its leaders have in common; the rest of the links counts with those that are found later.
    links = sims.filter(F.col("sim") >= threshold).select("a", "b")
    labels = components(links, 1)
    led = first.select("bucket", F.col("leader").alias("node"))
    larger = settled(_cells(met.filter("n > 2"), sims, labels, threshold), "cell-members")
    take = FIRST
    while True:
        tagged = larger.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        shares = tagged.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = shares.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
        open_members = settled(tagged.join(mixed.select("bucket", "main"), "bucket"), "open-members")
        waiting = open_members.filter("label <> main").join(led, ["bucket", "node"], "left_anti")
        ranked = settled(leading(waiting, take).select("nth", "bucket", F.col("node").alias("leader"), F.col("label").alias("ll"), F.col("size").alias("sl"), F.col("shared").alias("cl"), F.col("own").alias("ol"), F.col("other").alias("rl")), "leaders")
        chosen = ranked.filter(F.col("nth") <= take).drop("nth")
        if chosen.isEmpty():
            return _merged(labels, links)
        # A text ruled out for the first leader was not compared with it and has no overlap.
        within = F.coalesce(possible(F.least("own", "ol") + F.least("other", "rl")), F.lit(True))
        rivals = chosen.join(open_members, "bucket").filter((F.col("ll") != F.col("label")) & possible(most) & within)
        found = settled(_verify(_pairs(rivals, tried), items, blocks, threshold).drop("keys"), "similarities")
        tried = tried.unionByName(found.select("a", "b"))
        led = led.unionByName(chosen.select("bucket", F.col("leader").alias("node")))
        links = links.unionByName(found.filter(F.col("sim") >= threshold).select("a", "b"))
        # A bucket whose waiting texts have all led is done.
        more = ranked.filter(F.col("nth") > take).select("bucket")
        if more.isEmpty():
            return _merged(labels, links)
        labels = _merged(labels, links)
        larger = open_members.drop("label", "main").join(more, "bucket", "left_semi")
        take *= GROWTH


def _cells(met: DataFrame, sims: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``bucket, node, size, shared, weight, own, other``: where members of buckets that still have several classes meet again.

    ``own``: how many items the first leader has as well; ``other``: what only
    further texts have; null if the leader was not compared.
    """
    known = sims.select(F.col("a").alias("leader"), F.col("b").alias("node"), "sim")
    placed = met.join(labels, "node", "left").join(known, ["leader", "node"], "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    overlap = F.round(F.col("sim") * (F.col("size") + F.col("sl")) / (1 + F.col("sim"))).cast("long")
    shape = ["node", "size", "shared", "weight", "own", "other"]
    still = settled(placed.join(mixed, "bucket").withColumn("own", overlap).withColumn("other", F.col("shared") - overlap).select("bucket", "leader", "sim", *shape), "members-by-leader")
    far = _hopeful(still.filter("sim is null").unionByName(still.filter(F.col("sim") < 1 - FAR + 1e-6)).select("bucket", *shape), threshold)
    near = still.filter("sim is not null").select("leader", *shape).distinct()
    told = near.join(sims.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.explode("keys").alias("bucket")), ["leader", "node"])
    places = settled(told.select("bucket", *shape), "differences")
    cells = places.join(_chosen(places.select("bucket", "node", "size")), "bucket")
    return cells.filter(_able("least", threshold)).select("bucket", *shape).unionByName(far.select("bucket", *shape))


def classified(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``row`` (a number of its own), ``address`` (SHA-256 of the text), ``label`` (the row that its class is named by) and ``class_id``; the last three are null for a null text."""
    signed = settled(_signed(docs, id_column, text, bands, rows), "signatures")
    nodes = settled(signed.filter("address is not null").groupBy("address").agg(F.min("row").alias("node"), F.min("id").alias("least_id")), "nodes")
    bands = settled(_met(signed, nodes), "band-members")
    wanted = settled(nodes.join(bands.select("node").distinct(), "node").select("node", "address"), "candidates")
    addressed = docs.select(F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("address"), F.col(text).alias("text"))
    # Texts of one address are equal. Dealt by it, they move once, from each task one of a kind.
    texts = marked(addressed, wanted, "address").dropDuplicates(["address"]).join(wanted, "address").select("node", "text")
    items = settled(_with_items(texts), "candidate-items")
    labels = _links(settled(_members(bands, items, threshold), "members"), items, threshold)
    if labels is None:
        classes = nodes.select("address", "node", F.col("node").alias("label"), F.col("least_id").alias("class_id"))
    else:
        least = nodes.join(labels, "node").groupBy("label").agg(F.min("least_id").alias("class_id"))
        linked = labels.join(least, "label").select("node", "label", "class_id")
        classes = nodes.join(linked, "node", "left").select(
            "address", "node", F.coalesce("label", "node").alias("label"), F.coalesce("class_id", "least_id").alias("class_id")
        )
    return signed.select("id", "row", "address").join(classes.drop("node"), "address", "left").select("id", "row", "address", "label", "class_id")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id`` and ``first`` (true for the one row that stands for its class)."""
    placed = classified(docs, id_column, text, threshold, bands, rows)
    # The row that stands for a class is the one its label names.
    return placed.select(
        F.col("id").alias(id_column),
        F.coalesce("class_id", "id").alias("class_id"),
        (F.col("row") == F.coalesce("label", "row")).alias("first"),
    )


def keepers(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per class of texts that are not null: id and ``address`` of its row with the smallest id; null only if all its ids are."""
    placed = classified(docs, id_column, text).filter("address is not null")
    least = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "address")).alias("least")
    return placed.groupBy("label").agg(least).select(F.col("least.id").alias(id_column), "least.address")
