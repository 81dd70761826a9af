"""Nearest neighbours by vantage-point trees, one per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import map_arrow

#: Rows of a shard, on average; a task holds one shard and a batch of queries.
SHARD_ROWS = 32_768
#: Rows of a leaf, at most.
LEAF = 128
#: Slack for rounding: of a distance between unit vectors, and of a cosine.
_D, _C = 1e-6, 1e-12


def _summed(x: np.ndarray) -> np.ndarray:
    """Row sums, added from left to right whatever the shape."""
    return np.cumsum(x, axis=1)[:, -1]


class Tree:
    """A vantage-point tree over unit vectors, its leaves runs of one array.

    Every node has a vantage point and, for each half of its rows, the nearest
    and farthest distance to that point.  For a query at distance d from it,
    no row of a half is nearer than max(d - farthest, nearest - d).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], vectors[order]
        self.norm = np.sqrt(_summed(self.raw * self.raw))
        self.unit = self.raw / self.norm[:, None]
        self.points: list[np.ndarray] = []
        self.bounds: list[tuple[int, int, int, float, float]] = []  # a half: its node, start, end, nearest, farthest
        self.leaves: list[tuple[int, int]] = []
        self.place = np.arange(len(ids))
        todo = [(0, len(ids))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                self.leaves.append((a, b))
                continue
            rows = self.place[a:b]
            v = self.unit[rows[(b - a) // 2]]
            d = np.sqrt(np.maximum(0, 2 - 2 * (self.unit[rows] @ v)))
            by = np.argsort(d, kind="stable")
            self.place[a:b], d = rows[by], d[by]
            mid = (b - a) // 2
            self.points.append(v)
            for x, y in ((0, mid), (mid, b - a)):
                self.bounds.append((len(self.points) - 1, a + x, a + y, float(d[x]), float(d[y - 1])))
                todo.append((a + x, a + y))
        self.leaves.sort()
        self.starts = np.array([a for a, _ in self.leaves])
        self.place_unit = self.unit[self.place]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> list[list[tuple[float, int]]]:
        """For each query, its ``k`` best (score, id) here, best first.

        A leaf is left out for a query if its bound times ``factor`` is beyond
        the k-th distance so far: 1 is exact, more is faster and may miss.
        """
        norm = np.sqrt(_summed(queries * queries))
        unit = queries / norm[:, None]
        low = np.zeros((len(queries), len(self.leaves)))
        if self.points:
            far = np.sqrt(np.maximum(0, 2 - 2 * (unit @ np.array(self.points).T)))
            for node, a, b, nearest, farthest in self.bounds:
                i, j = np.searchsorted(self.starts, (a, b))
                d = far[:, node]
                bound = np.maximum(d - farthest, nearest - d)
                np.maximum(low[:, i:j], bound[:, None], out=low[:, i:j])
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        kth = np.full(len(ids), np.inf)
        floor = np.full(len(ids), -np.inf)

        def visit(leaf: int, active: np.ndarray) -> None:
            a, b = self.leaves[leaf]
            rows = self.place[a:b]
            near = unit[active] @ self.place_unit[a:b].T
            for q in np.flatnonzero((near >= (floor[active] - _C)[:, None]).any(axis=1)).tolist():
                at = active[q]
                own = rows[near[q] >= floor[at] - _C]
                own = own[self.ids[own] != ids[at]]
                if not len(own):
                    continue
                score = _summed(self.raw[own] * queries[at]) / (self.norm[own] * norm[at])
                found = best[at] + [(-s, i) for s, i in zip(score.tolist(), self.ids[own].tolist(), strict=True)]
                found.sort()
                best[at] = found[:k]
                if len(found) >= k:
                    floor[at] = -best[at][-1][0]
                    kth[at] = np.sqrt(max(0.0, 2 - 2 * floor[at]))

        home = low.argmin(axis=1)
        for leaf in np.unique(home):
            visit(leaf, np.flatnonzero(home == leaf))
        for leaf in range(len(self.leaves)):
            active = np.flatnonzero((low[:, leaf] * factor <= kth + _D) & (home != leaf))
            if len(active):
                visit(leaf, active)
        return [[(-s, i) for s, i in b] for b in best]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding of rows that take part, equal rows once."""
    e = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite).where(F.exists(e, lambda x: x != 0)).dropDuplicates(["vec_id", "embedding"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest rows.

    Nearness is the largest cosine in double precision, ties to the smaller
    id; fewer candidates give fewer rows.  Vectors that are null, empty, zero
    or hold null or non-finite parts take no part, nor do null ids; rows with
    the query's own id are no candidates; a query meets vectors of its own
    length only; an id that several vectors have counts once, with its best.

    Rows are dealt to shards by a hash of their id, so equal vectors spread.
    Each shard gets every query, builds its tree and keeps ``k`` per query;
    the shards' results are then ranked.  A task holds one shard, whose size
    ``shard_rows`` sets, and streams the queries through it.
    """
    rows, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    both = rows.select(shard.alias("shard"), F.size("embedding").alias("dim"), F.lit(0).alias("kind"), "vec_id", "embedding").unionByName(
        asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("embedding").alias("dim"), F.lit(1).alias("kind"), "vec_id", "embedding")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, tree = None, None
        for batch in batches:
            shard, dim, kind = (batch.column(c).to_numpy() for c in ("shard", "dim", "kind"))
            ids = batch.column("vec_id").to_numpy()
            flat = batch.column("embedding").flatten().to_numpy()
            ends = np.cumsum(dim)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(ids)].tolist(), strict=True):
                if a == b:
                    continue
                if at != (shard[a], dim[a]):
                    at, tree, held = (shard[a], dim[a]), None, []
                part = flat[ends[a] - dim[a] : ends[b - 1]].reshape(b - a, dim[a])
                if kind[a] == 0:
                    held.append((ids[a:b], part))
                    continue
                if tree is None and held:
                    tree = Tree(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                    held = []
                if tree is None:
                    continue
                for c in range(0, b - a, 512):
                    own, q = ids[a + c : min(b, a + c + 512)], part[c : c + 512]
                    found = tree.search(own, q, k, factor)
                    out = [(i, v, s) for i, best in zip(own.tolist(), found, strict=True) for s, v in best]
                    yield pa.RecordBatch.from_pydict({n: pa.array([o[j] for o in out], t) for j, (n, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "vec_id")
    found = map_arrow(dealt, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a row of a repeated id can be found by several of the query's vectors; the best holds
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
