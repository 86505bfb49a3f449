"""Exact top-k inner products by dual-tree search over cover trees.

Vectors lie in blocks of bounded size, each with a cover tree: a node's centre
is one of its vectors, its children cover it at a radius smaller by ``BASE``.
Queries lie in blocks with trees of the same kind. Some blocks of queries and
some of data form a cell, which is one task: the data pass by one block after
the other and both trees are descended together. A pair of nodes is given up
when ``c.d + |c|R + |d|r + rR`` (centres c and d, covering radii r and R), the
most that any of its vectors can score, lies below the worst k-th score that
this group of queries has from the blocks before. Every block of queries goes
to a cell for each part of the data; cells are dealt by their number, so that
nothing is joined and nothing of it goes through the driver.

Defined cases
-------------
* Vectors that are null, or hold null, NaN or infinite components, and rows
  without an id take no part.
* Shorter vectors count as padded with zeros; empty ones score 0 everywhere.
* Each row is a candidate of its own, also when it repeats another; a query is
  never its own candidate, but rows equal to it are. Ties go to the smaller id.
* Scores must lie within 64 bits. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm.common import settled

SCALE = 256
BLOCK = 4096
LEAF = 32
BASE = 1.3
CHUNK = 2048
#: Queries of a leaf at most, and of groups too small for a leaf of their own: each passes over the data in steps of its own.
QUERY_LEAF, FEW = 256, 16
#: Centres whose distances are worked out at once.
CENTRES = 32
#: Of one cell: components of its queries, which stay in memory, and of its data at most; products of components, about.
QUERY_VALUES, DATA_VALUES, PRODUCTS = 1 << 22, 1 << 25, 1 << 38
#: Cells at least, where there are as many blocks of data.
SPREAD = 32


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """Each component as ``floor(scale * x)`` in 64 bits."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


class CoverTree:
    """Leaves of a cover tree over the rows of ``x``, with every node's centre, radius and points.

    A leaf holds ``leaf`` points, or equal ones; children of ``few`` points or less share leaves.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, few: int = 1) -> None:
        self.x = x.astype(np.float64)
        self.centres: list[int] = []
        self.radii: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray | None] = []
        self.below: list[np.ndarray] = []
        squares = np.einsum("ij,ij->i", self.x, self.x)
        self.most = float(max(np.abs(self.x).max(initial=0), 1))
        self.norm = float(np.sqrt(squares.max(initial=0)))

        def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(squares[points] + squares[centres][:, None] - 2 * (self.x[centres] @ self.x[points].T), 0))

        def node(points: np.ndarray, centre: int, away: np.ndarray) -> int:
            self.centres.append(centre)
            self.radii.append(float(away.max()))
            self.children.append([])
            self.members.append(None)
            self.below.append(points)
            return len(self.centres) - 1

        if not len(x):
            return
        everything = np.arange(len(x))
        away = distances(everything, everything[:1])[0]
        todo = [(node(everything, 0, away), everything, away)]
        while todo:
            n, points, away = todo.pop()
            if len(points) <= leaf or self.radii[n] <= 1e-6 * (1 + float(np.sqrt(squares[self.centres[n]]))):
                self.members[n] = points
                continue
            reach = self.radii[n] / BASE
            singles: list[np.ndarray] = []

            def cover(own: np.ndarray, centre: int, away: np.ndarray, n: int = n, singles: list = singles) -> None:
                if len(own) <= few:
                    singles.append(own)
                else:
                    self.children[n].append(child := node(own, centre, away))
                    todo.append((child, own, away))

            near = away <= reach
            cover(points[near], self.centres[n], away[near])
            points = points[~near]
            while len(points):
                # The next centres are the first points left; one that an earlier centre covers is none.
                left, far = np.ones(len(points), dtype=bool), distances(points, points[:CENTRES])
                for j in range(len(far)):
                    if left[j]:
                        near = left & (far[j] <= reach)
                        near[j] = True
                        cover(points[near], int(points[j]), far[j][near])
                        left &= ~near
                points = points[left]
            # Vectors with few neighbours share leaves, or each would be a node of its own.
            lone = np.concatenate(singles) if singles else np.empty(0, dtype=np.int64)
            for start in range(0, len(lone), leaf):
                own = lone[start : start + leaf]
                child = node(own, int(own[0]), distances(own, own[:1])[0])
                self.members[child] = own
                self.children[n].append(child)

    @cached_property
    def single(self) -> np.ndarray:
        return self.x.astype(np.float32)

    @cached_property
    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all nodes: centres, their norms, radii, and whether it is a leaf."""
        centres = self.x[self.centres]
        return centres, np.sqrt((centres**2).sum(1)), np.array(self.radii), np.array([m is not None for m in self.members])


class Best:
    """The k best candidates of every query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.row = np.full((queries, k), -1, dtype=np.int64)

    def worst(self, queries: np.ndarray) -> float:
        """The least k-th score of ``queries``."""
        full = self.row[queries, -1] >= 0
        return float(self.score[queries, -1].min()) if full.all() else -np.inf

    def add(self, queries: np.ndarray, own: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``score``: of the candidates ``ids`` in ``rows``, one after the other, with ``queries``, whose rows are ``own``; a query is not its own candidate."""
        k = self.score.shape[1]
        full, last, last_id = self.row[queries, -1] >= 0, self.score[queries, -1], self.id[queries, -1]
        low = np.where(full, last, np.iinfo(np.int64).min).astype(score.dtype)
        if len(score) > k and not full.all():
            # k others of these, besides the query itself, are better than what is below.
            low = np.maximum(low, np.partition(score.T, -k - 1, axis=1)[:, -k - 1])
        hits = np.flatnonzero(score >= low)
        if not len(hits):
            return
        of, at = np.divmod(hits, len(queries))
        new = score.reshape(-1)[hits].astype(np.int64)
        keep = (rows[of] != own[at]) & ~(full[at] & (new == last[at]) & (ids[of] >= last_id[at]))
        if not keep.any():
            return
        # Only the queries with something new are sorted again.
        changed, at = np.unique(at[keep], return_inverse=True)
        of, new, changed = of[keep], new[keep], queries[changed]
        query = np.concatenate([np.repeat(np.arange(len(changed)), k), at])
        s = np.concatenate([self.score[changed].reshape(-1), new])
        i = np.concatenate([self.id[changed].reshape(-1), ids[of]])
        r = np.concatenate([self.row[changed].reshape(-1), rows[of]])
        order = np.lexsort((i, ~s, r < 0, query))
        sizes = np.bincount(query)
        top = order[(np.cumsum(sizes) - sizes)[:, None] + np.arange(k)]
        self.score[changed], self.id[changed], self.row[changed] = s[top], i[top], r[top]


def dual_search(queries: CoverTree, data: CoverTree, q: dict, d: dict, best: Best) -> None:
    """Add to ``best`` what is better in ``data``; ``q`` and ``d``: the arrays ``v`` (vectors), ``id`` and ``row`` of both sides."""
    if not len(q["id"]) or not len(d["id"]):
        return
    width = max(q["v"].shape[1], 1)
    most = queries.most * data.most * width
    exact = most < 2**52
    # Sums of products below 2^24 are whole in single precision as well.
    qx, dx = (queries.single, data.single) if queries.norm * data.norm < 2**24 - 1 else (queries.x, data.x)
    (qc, qn, qr, _), (dc, dn, dr, leaf) = queries.nodes, data.nodes
    # Radii come from squares; where these are rounded, by a share of 1e-14, radii are by 1e-7 of the vectors.
    slack = 1e-6 + 1e-9 * most if max(queries.most, data.most) ** 2 * width < 2**52 else 1e-5 * most

    def bound(a: int, nodes: np.ndarray) -> np.ndarray:
        return dc[nodes] @ qc[a] + dn[nodes] * qr[a] + qn[a] * dr[nodes] + qr[a] * dr[nodes] + slack

    def split(nodes: np.ndarray) -> np.ndarray:
        inner = nodes[~leaf[nodes]]
        return np.array(nodes[leaf[nodes]].tolist() + [c for n in inner.tolist() for c in data.children[n]], dtype=np.int64)

    todo = [(0, np.array([0]))]
    while todo:
        a, nodes = todo.pop()
        nodes = split(nodes)
        if queries.members[a] is None:
            # Both trees go down a level; what is out of reach of the whole group stays behind.
            nodes = nodes[bound(a, nodes) >= best.worst(queries.below[a])]
            if len(nodes):
                todo += [(c, nodes) for c in queries.children[a]]
            continue
        points = queries.members[a]
        # The group is a leaf now: its data nodes in the order of what they may hold at most.
        while True:
            high = bound(a, nodes)
            keep = high >= best.worst(points)
            nodes, high = nodes[keep], high[keep]
            if leaf[nodes].all():
                break
            nodes = split(nodes)
        order = np.argsort(-high, kind="stable")
        nodes, high = nodes[order], high[order]
        asking = (qx[points] if exact else q["v"][points].astype(np.int64)).T
        at = done = 0
        while at < len(nodes) and high[at] >= best.worst(points):
            # As many as all before: where little is given up, few steps do.
            members, size = [], 0
            while at < len(nodes) and size < max(CHUNK, done):
                members.append(data.members[nodes[at]])
                size, at = size + len(members[-1]), at + 1
            done += size
            chosen = np.concatenate(members)
            score = (dx.take(chosen, axis=0) if exact else d["v"][chosen].astype(np.int64)) @ asking
            best.add(points, q["row"][points], score, d["id"][chosen], d["row"][chosen])


def _packed(arrays: dict) -> bytes:
    """Ids, rows and vectors, in as few bytes a component as the largest needs."""
    v = arrays["v"]
    most = max(-1 - int(v.min(initial=0)), int(v.max(initial=0)))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
    return arrays["id"].tobytes() + arrays["row"].tobytes() + v.astype(kind).tobytes()


def _unpacked(n: int, width: int, data: pa.Buffer) -> dict:
    numbers, rest = np.frombuffer(data, dtype=np.int64, count=2 * n).copy(), data.size - 16 * n
    v = np.frombuffer(data, dtype=f"i{rest // (n * width)}", offset=16 * n).reshape(n, width) if rest else np.empty((n, width), np.int8)
    return {"id": numbers[:n], "row": numbers[n:], "v": v}


def _blocks(vectors: DataFrame, width: int) -> DataFrame:
    """One row per partition: its number, its size and its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, parts = [], [], []
        for batch in batches:
            v = batch.column("v")
            sizes = np.asarray(v.value_lengths())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            padded = np.zeros((batch.num_rows, width), dtype=np.int64)
            padded[np.arange(width) < sizes[:, None]] = flat
            parts.append(padded)
            ids.append(batch.column("id").to_numpy())
            rows.append(batch.column("row").to_numpy())
        if ids:
            arrays = {"id": np.concatenate(ids), "row": np.concatenate(rows), "v": np.concatenate(parts)}
            yield pa.record_batch(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(arrays["id"])], pa.int64()), pa.array([_packed(arrays)], pa.binary())],
                names=["block", "n", "data"],
            )

    return vectors.mapInArrow(run, "block int, n bigint, data binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best partners of every query row.

    ``is_query``: a condition on the id column of ``vectors``.
    """
    v = F.col(vector)
    base = vectors.filter(F.col(id_column).isNotNull() & usable(v)).select(
        F.col(id_column).cast("long").alias("id"), is_query.alias("asks"), whole_components(v).alias("v"), F.monotonically_increasing_id().alias("row")
    )
    base = settled(base, "vectors")
    n, asking, width = base.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    group, wide = max(1, block // 4), max(1, width)
    blocks, groups = max(1, -(-n // block)), max(1, -(-asking // group))
    # A cell has a side of the queries and a part of the data.
    held = max(1, QUERY_VALUES // (group * wide))
    sides = -(-groups // held)
    least = max(-(-SPREAD // sides), -(-n * min(asking, held * group) * wide // PRODUCTS), -(-blocks * block * wide // DATA_VALUES))
    parts = min(blocks, least)
    number = lambda part, side: (part.cast("int") * sides + side.cast("int")).alias("cell")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = _blocks(base.repartition(blocks), width).withColumn("side", every(sides))
    queries = _blocks(base.filter("asks").repartition(groups), width).withColumn("part", every(parts))
    met = data.select(number(F.col("block") % parts, F.col("side")), F.lit(False).alias("asks"), "block", "n", "data").unionByName(
        queries.select(number(F.col("part"), F.col("block") % sides), F.lit(True).alias("asks"), "block", "n", "data")
    )
    met = met.repartitionById(parts * sides, F.col("cell")).sortWithinPartitions("cell", F.desc("asks"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Queries of the cell come first; they stay while its data pass by.
        asked: list[tuple[dict, CoverTree, Best]] = []

        def answers() -> Iterator[pa.RecordBatch]:
            for q, _, best in asked:
                query, place = np.nonzero(best.row >= 0)
                yield pa.record_batch(
                    [pa.array(q["row"][query]), pa.array(q["id"][query]), pa.array(best.id[query, place]), pa.array(best.score[query, place])],
                    names=["query_row", "query_id", "vec_id", "score"],
                )

        cell = None
        for batch in batches:
            numbers, asks, sizes = (batch.column(c).to_pylist() for c in ("cell", "asks", "n"))
            for at in range(batch.num_rows):
                if numbers[at] != cell:
                    yield from answers()
                    asked, cell = [], numbers[at]
                arrays = _unpacked(sizes[at], width, batch.column("data")[at].as_buffer())
                if asks[at]:
                    asked.append((arrays, CoverTree(arrays["v"], QUERY_LEAF, FEW), Best(sizes[at], k)))
                elif asked:
                    tree = CoverTree(arrays["v"])
                    for q, q_tree, best in asked:
                        dual_search(q_tree, tree, q, arrays, best)
        yield from answers()

    found = met.mapInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
