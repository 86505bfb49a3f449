"""Similarity join of shingle sets in the Jaccard metric, with pivots and Voronoi regions.

The Jaccard distance of sets is a metric. The join works on regions, at first
the cells below. In every region the best ranked texts that still matter
become pivots and the distance of every member to them is worked out. Members
go to the region of their nearest pivot; by the triangle inequality a linked
pair is at most ``radius`` apart, so a member is replicated to all pivots that
are no more than that beyond its nearest one, and a pair always shares the
region of whichever member lies closer to its pivot. Members far from all
pivots stay together without them and join again with more pivots, until few
are left. A group of copies is compared with its pivots, not expanded into its
pairs. In the region of a pivot the members meet again in cells by their
differences to it: sets that lie close to one pivot but are linked with each
other differ from it in the same shingles.

Within such cells nearly all pairs are close and not linked, and neither
pivots nor regions tell them apart. There the members outside the largest class
meet those of other classes, and sketches, the parities of the shingles in each
of some bits, rule out nearly all pairs: sets differ in as many shingles at
least as their sketches differ in bits. Texts are compared of the rest only.

Unrelated texts are all at distance 1, where no pivot tells them apart. So the
first regions are cells of texts that may be near: the hash values are cut into
more parts than linked sets of a size can have differences, so that linked sets
agree in all shingles of one part at least. A cell holds the texts with equal
shingles in a part. Parts are cut by size class; a text that may have a smaller
partner in the class below is in the cells of both. Agreement in a part of no
or few shingles says little: as there are more parts than needed, a text leaves
such parts out where enough others remain.

Only classes are found, not all links: texts that are in one class already are
not compared again. Sets are those of 64-bit hashes of the shingles, equal sets
are one by a 128-bit hash; a decision itself is exact, in whole numbers.

Defined cases
-------------
* Null and empty texts, and texts of white space, have no shingle and are
  linked with nothing; each row is its own class.
* Fewer words than a shingle's are one shingle, different from longer ones.
* Every input row gives one row, repeated rows too. The class id is the
  smallest id in the class; null ids take part but never name a class unless
  all its ids are null.
* Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm.common import first_rows, marked, settled
from keysieve.llm.neardup import components

WIDTH = 3
PERCENT = 90
#: Members farther than this from all pivots stay together.
FAR = 0.3
#: Members that are left without a pivot and are no more than this are ended by sketches.
SMALL = 64
#: So many outside a cell's largest class lead in the first round there, and how many times as many (pivots too) in each that follows.
FIRST, GROWTH = 64, 4
#: Sizes of a class lie this far apart at least; a part in so many is spare; parts of fewer shingles are left out.
CLASS_WIDTH, SPARE, FEW = 1.25, 6, 3
BATCH_WORDS = 400_000
BLOCK_TEXTS = 500
SEEN = 200_000
CACHE_ENTRIES = 200_000
_EPS = 1e-9

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_sets(texts: list[list[bytes]], hashes: dict, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, in order, one text after the other, and where each text's begin."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    flat = np.fromiter((hashes[w] for words in texts for w in words), dtype=np.uint64, count=int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    value = np.zeros(len(flat), dtype=np.uint64)
    for k in range(width):
        # Words past the end of a short text count as nothing.
        ahead = np.zeros(len(flat), dtype=np.uint64)
        ahead[: max(len(flat) - k, 0)] = flat[k:]
        value = _mix(value * _GOLDEN + np.where(left > k, ahead, np.uint64(k + 1)))
    starts = (place == 0) | (left >= width)
    value, text = value[starts], text[starts]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[first], text[first]
    return value, np.searchsorted(text, np.arange(len(texts) + 1))


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of some rows at a time."""
    first, texts, held = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        texts.append(words_of(value.as_py()))
        held += len(texts[-1])
        if held >= BATCH_WORDS or i + 1 == batch.num_rows:
            yield first, texts
            first, texts, held = i + 1, [], 0


def size_classes(largest: int, percent: int) -> np.ndarray:
    """Lower bounds of the size classes up to ``largest``, each at least as wide as linked sizes lie apart."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent), int(bounds[-1] * CLASS_WIDTH)))
    return np.array(bounds, dtype=np.int64)


def part_keys(shingles: np.ndarray, percent: int, bounds: np.ndarray) -> np.ndarray:
    """Keys of the parts of a set (its sorted shingles) in its own size class and, if need be, in the one below.

    Sets of sizes n <= m that are linked differ in (n + m) * (1 - p) / (1 + p)
    shingles at most, p being the share, and m is n / p at most: n * (1 - p) / p.
    """
    n = len(shingles)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    low = own - 1 if own and -(-percent * n // 100) < bounds[own] else own
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(shingles))])
    out = []
    for c in range(low, own + 1):
        differ = int(bounds[c + 1] - 1) * (100 - percent) // percent
        spare = 1 + differ // SPARE
        parts = differ + 1 + spare
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        cuts = np.concatenate([[0], np.searchsorted(shingles, edges), [n]])
        held = np.diff(cuts)
        # A part left out must be so for both sets: equal parts are equally large.
        least = next((w for w in range(FEW, 0, -1) if np.count_nonzero(held < w) <= spare), 0)
        own_parts = np.flatnonzero(held >= least)
        content = sums[cuts[1:]] - sums[cuts[:-1]] + held.astype(np.uint64) * _GOLDEN
        name = _mix(np.arange(parts, dtype=np.uint64) + np.uint64((c + 1) << 32))
        out.append(_mix(_mix(name) ^ content)[own_parts])
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by their lowest bits, twice as many as it has shingles or more, in words of 64; half as many bits are the words' halves, added."""
    words = 1 << (-(-len(shingles) // 32) - 1).bit_length()
    odd = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _apart(a: str, b: str) -> Column:
    """In how many bits two sketches differ, the longer one folded to the shorter."""
    short, long = f"if(size({a}) <= size({b}), {a}, {b})", f"if(size({a}) <= size({b}), {b}, {a})"
    part = f"slice({long}, cast(i * size({short}) + 1 as int), size({short}))"
    differ = f"aggregate(sequence(0, cast(size({long}) / size({short}) as int) - 1), {short}, (s, i) -> zip_with(s, {part}, (x, y) -> x ^ y))"
    return F.expr(f"aggregate({differ}, 0, (n, w) -> n + bit_count(w))")


def _signed(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """``id, n, address`` (of the set) and ``cells`` (keys of its parts); null address without words."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for first, texts in _batches(batch, 1):
                value, bounds = shingle_sets(texts, hashes, width)
                sizes = np.diff(bounds)
                classes = size_classes(int(sizes.max(initial=0)), percent)
                address, cells = [], []
                for at, n in zip(bounds.tolist(), sizes.tolist(), strict=False):
                    own = value[at : at + n]
                    address.append(xxhash.xxh3_128_digest(own.tobytes()) if n else None)
                    cells.append(part_keys(own, percent, classes).view(np.int64) if n else None)
                yield pa.record_batch(
                    [batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(address, pa.binary()), pa.array(cells, pa.list_(pa.int64()))],
                    names=["id", "n", "address", "cells"],
                )

    return docs.mapInArrow(run, f"id {kind}, n bigint, address binary, cells array<bigint>").withColumn("row", F.monotonically_increasing_id())


def _pressed_texts(docs: DataFrame, width: int) -> DataFrame:
    """``address`` and ``sketch`` of the set and the compressed words of the texts, equal sets of a task mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, pack = _Hashes(), set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for _, texts in _batches(batch, 0):
                value, bounds = shingle_sets(texts, hashes, width)
                address, words, sketches = [], [], []
                for i, (at, to) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    key = xxhash.xxh3_128_digest(value[at:to].tobytes())
                    if to > at and key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        address.append(key)
                        words.append(pack.compress(b" ".join(texts[i])))
                        sketches.append(sketch(value[at:to]))
                arrays = [pa.array(address, pa.binary()), pa.array(words, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.record_batch(arrays, names=["address", "words", "sketch"])

    return docs.select("text").mapInArrow(run, "address binary, words binary, sketch array<bigint>")


def _compare(width: int, percent: int, split: bool):
    least = percent / 100 - FAR

    def run(table: pa.Table) -> pa.Table:
        """One block: rows with words are its texts, the others its pairs."""
        held, pairs = table.filter(pc.is_valid(table["words"])), table.filter(pc.is_null(table["words"]))
        value, bounds = shingle_sets([zstandard.ZstdDecompressor().decompress(w.as_py()).split() for w in held["words"]], _Hashes(), width)
        sets = {n: value[a:b] for n, a, b in zip(held["node"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
        a, b = pairs["node"].to_pylist(), pairs["pivot"].to_pylist()
        both = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)]
        either = [len(sets[x]) + len(sets[y]) - c for x, y, c in zip(a, b, both, strict=True)]
        cells = [difference_keys(sets[x], sets[y], y, percent) if split and c >= least * u - 1 else None for x, y, c, u in zip(a, b, both, either, strict=True)]
        arrays = [pa.array(v, pa.int64()) for v in (a, b, both, either)] + [pa.array(cells, pa.list_(pa.int64()))]
        return pa.table(arrays, names=["node", "pivot", "both", "either", "cells"])

    return run


def difference_keys(own: np.ndarray, pivot: np.ndarray, name: int, percent: int) -> np.ndarray:
    """Keys of the cells, inside a pivot's region, of a set by its differences to the pivot.

    Two sets differ from each other where their differences to the pivot do.
    Let those be a and b in number and sets that are linked differ in k shingles
    at most: then both have (a + b - k) / 2 differences in common. Of two linked
    sets that are in different classes so far, one at least is not linked to the
    pivot, so that its differences are about k or more; so each set shares one of
    its first differences, those that the pivot lacks before those it alone has.
    """
    n, share = len(own), 100 - percent
    new, gone = np.setdiff1d(own, pivot, assume_unique=True), np.setdiff1d(pivot, own, assume_unique=True)
    a = len(new) + len(gone)
    # By how much k of the two can exceed what keeps the other apart from the pivot.
    slack = max(0, n - len(pivot)) * share // (100 + percent) + 1
    common = max(1, -(-(a - slack) // 2))
    if 100 * (n - len(new)) < percent * (n + len(gone)):
        # Not linked to the pivot: a partner may be, and then has a - k differences or more.
        common = max(1, min(common, a - n * share // percent))
    first = np.concatenate([new, gone])[: a - common + 1]
    return _mix(first ^ _mix(np.array([name], dtype=np.int64).view(np.uint64))).view(np.int64)


def _overlaps(pairs: DataFrame, texts: DataFrame, width: int, percent: int, split: bool) -> DataFrame:
    """``node, pivot, both, either`` of pairs: sizes of intersection and union; with ``split`` also ``cells`` of near ones.

    A node is sent to the block of its first pivot, a pivot to the blocks that
    need it; a pivot with very many nodes has several blocks.
    """
    pairs = settled(pairs, "pairs")
    home = pairs.groupBy("node").agg(F.min("pivot").alias("home"))
    load = home.groupBy("home").agg(F.count(F.lit(1)).alias("load"))
    blocks = max(1, -(-home.count() // BLOCK_TEXTS))
    share = F.pmod(F.xxhash64("node"), F.ceil(F.col("load") / BLOCK_TEXTS))
    placed = home.join(load, "home").select("node", F.pmod(F.xxhash64("home", share), F.lit(blocks)).alias("g"))
    dealt = settled(pairs.join(placed, "node"), "dealt-pairs")
    needed = dealt.select("g", F.explode(F.array("node", "pivot")).alias("node")).distinct()
    none = F.lit(None)
    rows = needed.join(texts, "node").select("g", "node", none.cast("long").alias("pivot"), "words").unionByName(
        dealt.select("g", "node", "pivot", none.cast("binary").alias("words"))
    )
    return rows.groupBy("g").applyInArrow(_compare(width, percent, split), "node bigint, pivot bigint, both bigint, either bigint, cells array<bigint>")


def _cells(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """``region, node`` of cells with at least two ``nodes``; of cells with equal members one."""
    # Most cells are a text's own: the places move once, and what is left is little.
    met = places.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("region"))).filter("size > 1").select("region", "node")
    members = settled(met.join(nodes, "node", "left_semi").distinct(), "cells")
    looks = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("sum"))
    chosen = looks.filter("size > 1").groupBy("size", "low", "high", "sum").agg(F.min("region").alias("region")).select("region")
    return members.join(chosen, "region", "left_semi").select("region", "node")


def _lone(texts: DataFrame, width: int) -> DataFrame:
    """``node`` and ``lone``: how many of a text's shingles no other candidate has, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                value, bounds = shingle_sets([zstandard.ZstdDecompressor().decompress(w.as_py()).split() for w in part.column(1)], hashes, width)
                # Shingles that fall together in 40 bits count as another text's: fewer are lone, never more.
                items = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((value >> np.uint64(24)).view(np.int64)))
                yield pa.record_batch([part.column(0), items], names=["node", "items"])

    items = texts.select("node", "words").mapInArrow(run, "node bigint, items array<bigint>")
    single = items.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    return single.filter("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))


def _classes(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``node, label`` after further links (a, b): classes known are linked instead of their nodes."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    ends = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(ends.filter("a <> b").distinct()).toDF("label", "into")
    known = labels.join(merged, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
    return settled(known.unionByName(merged.toDF("node", "label").join(labels, "node", "left_anti")), "labels")


def _open(members: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """``members`` of regions of several classes, with their ``label`` and the region's largest class (``main``).

    Texts of which each has shingles that no other has differ in these at
    least, and share none of them. A member leaves a region where nobody has so
    few of its own that the two could be linked.
    """
    tagged = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    shares = tagged.groupBy("region", "label").agg(F.count(F.lit(1)).alias("size"), F.min("lone").alias("fewest"))
    mixed = shares.groupBy("region").agg(F.max(F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("classes"), F.min("fewest").alias("fewest")).filter("classes > 1")
    able = (100 - percent) * (F.col("n") - F.col("lone")) >= percent * (F.col("lone") + F.col("fewest"))
    return tagged.join(mixed.select("region", "main", "fewest"), "region").filter(able).drop("fewest")


def _linked(members: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame | None:
    """Classes (node, label) of all nodes with a link; None without any. ``members``: ``region, node, n`` and ``lone``."""
    radius = 1 - percent / 100
    weight = members.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    members = settled(members.join(weight, "node"), "members")
    own = ["node", "n", "lone", "weight"]
    shape = members.select(*own).distinct()
    # The text in most regions, which tends to lie in the middle of its group, leads in all of them.
    order = Window.partitionBy("region").orderBy(F.desc("weight"), F.xxhash64("node"), "node")
    labels, tried, told, few, take = None, None, None, None, 1
    while True:
        open_members = settled(_open(members, labels, percent), "open-members")
        waiting = open_members.filter("label <> main.label or main.size = 1")
        ranked = settled(waiting.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= take + 1).select("region", F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("lone").alias("own"), "nth"), "pivots")
        pivots = ranked.filter(F.col("nth") <= take).drop("nth")
        if pivots.isEmpty():
            break
        met = open_members.select("region", "node", "n", "lone").join(pivots, "region").filter("node <> pivot")
        # What they can share at most puts the others beyond all that is looked at.
        most = F.least(F.col("n") - F.col("lone"), F.col("m") - F.col("own"))
        near = met.filter(most >= (1 - FAR - radius - _EPS) * (F.col("n") + F.col("m") - most))
        pairs = near.select("node", "pivot").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("node", "pivot"), ["node", "pivot"], "left_anti")
        found = settled(_overlaps(pairs, texts, width, percent, True), "overlaps")
        tried = found if tried is None else tried.unionByName(found)
        labels = _classes(labels, _links(found, percent))
        cells, far = _regions(open_members, near, ranked, tried, take, radius)
        told = cells if told is None else told.unionByName(cells)
        rest = settled(far.withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("region"))), "far-members")
        small = rest.filter(F.col("left") <= SMALL).select("region", *own)
        few = small if few is None else few.unionByName(small)
        members = rest.filter(F.col("left") > SMALL).select("region", *own)
        if members.isEmpty():
            break
        take *= GROWTH
    if told is None:
        return labels
    met_again = _cells(told, shape.select("node")).join(shape, "node").select("region", *own).unionByName(few)
    return _ended(settled(met_again, "members"), labels, tried.select("node", "pivot"), texts, percent, width)


def _links(found: DataFrame, percent: int) -> DataFrame:
    return found.filter(100 * F.col("both") >= percent * F.col("either")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def _regions(open_members: DataFrame, near: DataFrame, ranked: DataFrame, tried: DataFrame, take: int, radius: float) -> tuple[DataFrame, DataFrame]:
    """Of regions whose waiting members have not all been pivots: places (``node, region``) in the cells that follow, and the members that lie far from all pivots."""
    more = ranked.filter(F.col("nth") > take).select("region")
    distance = (1 - F.col("both") / F.col("either")).alias("d")
    placed = near.join(more, "region", "left_semi").select("region", "node", "pivot").join(tried.select("node", "pivot", distance), ["node", "pivot"])
    placed = settled(placed.withColumn("nearest", F.min("d").over(Window.partitionBy("region", "node"))), "distances")
    used = ranked.filter(F.col("nth") <= take).select("region", F.col("pivot").alias("node"))
    rest = open_members.drop("label", "main").join(more, "region", "left_semi").join(used, ["region", "node"], "left_anti")
    far = rest.join(placed.filter(F.col("nearest") <= FAR).select("region", "node"), ["region", "node"], "left_anti")
    # Voronoi regions of the pivots: with all that could be linked across a border.
    voronoi = placed.filter(F.col("d") <= F.least("nearest", F.lit(FAR)) + radius + _EPS).select("node", "pivot")
    # Within a region all are alike; what they differ in from the pivot tells them apart.
    cells = tried.filter("cells is not null").join(voronoi, ["node", "pivot"], "left_semi").select("node", F.explode("cells").alias("region"))
    return cells, far


def _ended(members: DataFrame, labels: DataFrame | None, tried: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame | None:
    """``labels`` after all links within a region of ``members``.

    Those outside its largest class lead, in order and in rounds. They meet the
    members of other classes that are not before them.
    """
    waits = F.col("label") != F.col("main.label")
    order = Window.partitionBy("region", waits).orderBy(F.desc("weight"), F.xxhash64("node"), "node")
    sketches = texts.select("node", "sketch")
    most = F.least(F.col("n") - F.col("lone"), F.col("m") - F.col("own"))
    able = (100 + percent) * most >= percent * (F.col("n") + F.col("m"))
    close = (100 + percent) * _apart("sketch", "mark") <= (100 - percent) * (F.col("n") + F.col("m"))
    take = FIRST
    while True:
        ranked = settled(_open(members, labels, percent).withColumn("nth", F.when(waits, F.row_number().over(order))).drop("main"), "ranked-members")
        first = ranked.filter(F.col("nth") <= take)
        if first.isEmpty():
            return labels
        marked_first = first.join(sketches, "node").select(
            "region", F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("lone").alias("own"), F.col("label").alias("of"), F.col("nth").alias("turn"), F.col("sketch").alias("mark")
        )
        later = F.col("nth").isNull() | (F.col("nth") > F.col("turn"))
        met = ranked.join(sketches, "node").join(marked_first, "region").filter(later & (F.col("label") != F.col("of")) & able & close)
        pairs = met.select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot")).distinct()
        known = tried.union(tried.select("pivot", "node"))
        found = settled(_overlaps(pairs.join(known, ["node", "pivot"], "left_anti"), texts, width, percent, False), "overlaps")
        tried = tried.unionByName(found.select("node", "pivot"))
        labels = _classes(labels, _links(found, percent))
        # A region whose waiting members have all led is done.
        more = ranked.filter(F.col("nth") > take).select("region").distinct()
        if more.isEmpty():
            return labels
        members = ranked.filter(F.coalesce(F.col("nth") > take, F.lit(True))).drop("label", "nth").join(more, "region", "left_semi")
        take *= GROWTH


def classified(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` and ``component_id``."""
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    signed = settled(_signed(docs, percent, width), "sets")
    nodes = settled(signed.filter("address is not null").groupBy("address").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.min("n").alias("n")), "nodes")
    # Keys do not move with the rows they belong to. Few other rows of equal sets pass, which leave with the cells.
    first = first_rows(signed.filter("cells is not null").select(F.col("row").alias("node"), "cells"), nodes)
    cells = settled(_cells(first.select(F.explode("cells").alias("region"), "node"), nodes.select("node")), "cell-members")
    wanted = settled(nodes.join(cells.select("node").distinct(), "node").select("node", "address", "n"), "candidates")
    # Texts of one address have equal sets. Dealt by it, they move once, from each task one of a kind.
    pressed = marked(_pressed_texts(docs, width), wanted, "address").dropDuplicates(["address"])
    texts = settled(pressed.join(wanted, "address").select("node", "words", "sketch"), "candidate-texts")
    sizes = wanted.select("node", "n").join(_lone(texts, width), "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    labels = _linked(cells.join(settled(sizes, "sizes"), "node"), texts, percent, width)
    if labels is None:
        classes = nodes.select("address", F.col("least_id").alias("class_id"))
    else:
        least = nodes.join(labels, "node").groupBy("label").agg(F.min("least_id").alias("class_id"))
        linked = labels.join(least, "label").select("node", "class_id")
        classes = nodes.join(linked, "node", "left").select("address", F.coalesce("class_id", "least_id").alias("class_id"))
    placed = signed.select("id", "n", "address").join(classes, "address", "left")
    return placed.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("component_id"))
