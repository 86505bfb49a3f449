"""Runs of repeated words by string synchronising sets.

A run is a stretch of words with smallest period q, at least twice as long as
q and as ``min_length``, that no neighbour extends. For every dyadic scale t
from 4 up, a position is synchronising if the least hash of the t-word windows
that start at it and up to t behind it is that of the first or the last;
windows of a period of t/3 or less take no part. Whether a position is one
depends on its next 2t words only, so equal contexts are chosen alike: where a
run of a period in [3t, 6t) repeats, it repeats such a position. Pairs of equal
contexts at such distances propose their distance as a period.

What this omits is supplied apart. Periods below 12 are found by comparing the
words with themselves that far on. A run whose first period is itself highly
periodic (period r at most t/3) has no synchronising position there; then the
run's two halves lie in two regions of period r that touch, and the distances
that bring their phases together are proposed.

Every proposal is extended to both sides by binary search over prefix hashes
(a polynomial in an odd base modulo 2^64) and checked word by word: no result
rests on a hash. Of equal stretches the smallest period stays, which is that
of the run.

Defined cases
-------------
* Null and empty texts have no words, no runs and an empty collapsed text.
* Words are what ASCII white space leaves. They are compared exactly.
* Each row is a document of its own; null or repeated ids pass through, other
  columns play no part. An empty table gives no rows.
* Very long texts take a batch for themselves; all work is near linear.
* Runs may overlap or lie in each other; all are reported, by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
#: The first scale; periods below three times it are compared directly.
FIRST_SCALE = 4
BATCH_WORDS = 400_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOUND = "n_runs bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Hashes:
    """Hashes of any window of a sequence of numbers, in constant time each."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        values = _mix((codes.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def all(self, width: int) -> np.ndarray:
        """Of the windows at every start."""
        return _mix((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])

    def at(self, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        return (self.sums[start + width] - self.sums[start]) * self.back[start]


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def _reach(hashes: _Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``a`` and ``b`` on (step 1) or before them (step -1) are equal, up to ``most``."""
    low, high = np.zeros(len(a), dtype=np.int64), most.copy()
    while True:
        some = np.flatnonzero(low < high)
        if not len(some):
            return low
        middle = (low[some] + high[some] + 1) // 2
        left, right = (a[some], b[some]) if step > 0 else (a[some] - middle, b[some] - middle)
        equal = hashes.at(left, middle) == hashes.at(right, middle)
        low[some] = np.where(equal, middle, low[some])
        high[some] = np.where(equal, high[some], middle - 1)


def _extended(codes: np.ndarray, hashes: _Hashes, at: np.ndarray, period: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period) around the proposals; hashes find them and the words decide."""
    inside = (at >= 0) & (at + period < len(codes))
    at, period = at[inside], period[inside]
    right = _reach(hashes, at, at + period, len(codes) - at - period, 1)
    left = _reach(hashes, at, at + period, at, -1)
    runs = np.unique(np.stack([at - left, at + period + right, period], axis=1), axis=0)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])]
    exact = []
    for start, end, q in runs.tolist():
        if np.array_equal(codes[start : end - q], codes[start + q : end]):
            exact.append((start, end, q))
        else:
            # Unequal words had one hash: the stretches of this distance are found by the words.
            begins, ends = _stretches(codes[start : end - q] == codes[start + q : end])
            exact += [(start + b, start + e + q, q) for b, e in zip(begins.tolist(), ends.tolist(), strict=True) if e - b + q >= max(least, 2 * q)]
    return np.array(exact, dtype=np.int64).reshape(-1, 3)


def _touching(codes: np.ndarray, hashes: _Hashes, runs: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals (place, period) from touching regions of one small period."""
    regions = runs[(3 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= 3 * scale)]
    regions = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for (b1, e1, r1), (b2, e2, r2) in zip(regions[:-1].tolist(), regions[1:].tolist(), strict=True):
        if r1 != r2 or not 0 <= e1 - b2 < r1:
            continue
        shifts = np.arange(1, r1 + 1)
        phase = hashes.at(b2 - shifts - r1, np.full(r1, r1)) == hashes.at(np.full(r1, b2), np.full(r1, r1))
        for shift in shifts[phase].tolist():
            first = shift + -(-max(3 * scale - shift, 0) // r1) * r1
            own = np.arange(first, min(6 * scale, e1 - b1 + 1, e2 - b2 + 1), r1)
            places.append(np.maximum(b2 - own, b1))
            periods.append(own)
    return np.concatenate(places), np.concatenate(periods)


def synchronising(hashes: _Hashes, n: int, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Positions of a scale; ``periodic`` marks window starts of a small period."""
    window = hashes.all(scale)
    window[periodic[: len(window)]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least, width = window, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    # Starts 0 .. n - 2 * scale: the window of starts [i, i + scale] is there.
    count = n - 2 * scale + 1
    if count <= 0:
        return np.empty(0, np.int64)
    ends = np.minimum(window[:count], window[scale : scale + count])
    chosen = (np.minimum(least[:count], window[scale : scale + count]) == ends) & (ends != np.uint64(0xFFFFFFFFFFFFFFFF))
    return np.flatnonzero(chosen)


def _pairs(hashes: _Hashes, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal contexts at a distance in [3 * scale, 6 * scale): place and distance."""
    context = hashes.at(places, np.full(len(places), 2 * scale))
    order = np.argsort(context, kind="stable")
    context, places = context[order], places[order]
    found_at, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    some, ahead = np.arange(len(places)), 1
    while len(some):
        some = some[some + ahead < len(places)]
        distance = places[some + ahead] - places[some]
        near = (context[some + ahead] == context[some]) & (distance < 6 * scale)
        some, distance = some[near], distance[near]
        wide = distance >= 3 * scale
        found_at.append(places[some[wide]])
        found.append(distance[wide])
        ahead += 1
    return np.concatenate(found_at), np.concatenate(found)


def runs_of(codes: np.ndarray, longest: int, least: int = MIN_LENGTH) -> np.ndarray:
    """All runs (start, end, period) of a sequence of numbers, none longer than ``longest``; by start, then period."""
    n = len(codes)
    small = 3 * FIRST_SCALE
    found = []
    for q in range(1, min(small, n)):
        begins, ends = _stretches(codes[:-q] == codes[q:])
        # Short regions that the first scales must leave out are kept until the end.
        wide = ends - begins + q >= min(max(least, 2 * q), 4 * q)
        found.append(np.stack([begins[wide], ends[wide] + q, np.full(wide.sum(), q)], axis=1))
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    scale = FIRST_SCALE
    hashes = _Hashes(codes) if longest >= 6 * scale else None
    while longest >= 6 * scale:
        periodic = np.zeros(n + 1, dtype=np.int32)
        own = runs[(3 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
        np.add.at(periodic, own[:, 0], 1)
        np.add.at(periodic, own[:, 1] - scale + 1, -1)
        at, period = _pairs(hashes, synchronising(hashes, n, scale, np.cumsum(periodic[:-1]) > 0), scale)
        more_at, more = _touching(codes, hashes, runs, scale)
        at, period = np.concatenate([at, more_at]), np.concatenate([period, more])
        if len(at):
            runs = np.concatenate([runs, _extended(codes, hashes, at, period, least)])
        scale *= 2
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])]
    # A stretch has each multiple of its smallest period as well.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batch_rows(texts: list[list[bytes]]) -> tuple[list[int], list[list[dict]], list[str]]:
    sizes = np.array([len(w) for w in texts])
    # A number of its own follows each text: no stretch goes across.
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    numbers: dict[bytes, int] = {}
    codes = np.empty(starts[-1], dtype=np.int64)
    for words, at in zip(texts, starts.tolist(), strict=False):
        codes[at : at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    codes[starts[1:] - 1] = len(numbers) + np.arange(len(texts))
    runs = runs_of(codes, int(sizes.max(initial=0)))
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    counts, lists, collapsed = [], [], []
    for i, words in enumerate(texts):
        own = runs[bounds[i] : bounds[i + 1]] - np.array([starts[i], starts[i], 0])
        counts.append(len(own))
        lists.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
        if len(own):
            gone = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(gone, own[:, 0] + own[:, 2], 1)
            np.add.at(gone, own[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        collapsed.append(b" ".join(words).decode())
    return counts, lists, collapsed


def find_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, ``n_runs``, ``runs`` (start, length and period in words) and ``collapsed``.

    The collapsed text keeps of every run the first period; kept words are joined by one space.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, held = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                texts.append((value.as_py() or "").encode().split())
                held += len(texts[-1])
                if held >= BATCH_WORDS or i + 1 == batch.num_rows:
                    counts, lists, collapsed = _batch_rows(texts)
                    ids = batch.column(0).slice(first, len(texts))
                    yield pa.record_batch([ids, pa.array(counts, pa.int64()), pa.array(lists, run_type), pa.array(collapsed, pa.string())],
                                          names=["id", "n_runs", "runs", "collapsed"])
                    texts, first, held = [], i + 1, 0

    return docs.select(id_column, text).mapInArrow(run, f"id {kind}, {_FOUND}").withColumnRenamed("id", id_column)


def longest_run() -> F.Column:
    """Of the column ``runs``: the longest, ties to the smallest start, then period; null without any."""
    order = lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    return F.array_min(F.transform("runs", order))
