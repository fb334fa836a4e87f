"""Clustering around centroids with ball trees: balls that one centroid is sure of aren't looked into.

Vectors are whole numbers.  Every block of vectors that a task reads gets a tree of its own, stored once and used
by all rounds: a ball has a centre, a radius, a count and the exact sum of its vectors.  A round goes down each tree
with the centroids that may still be nearest to something in a ball; where one is left, the ball's count and sum
go to it whole, and in leaves distances are worked out exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of one tree and of a leaf, at most.
BLOCK, LEAF = 8192, 32
#: Components beyond this have squared distances that no 64-bit number holds.
MOST = 1 << 27
#: Relative slack for distances in floating point, so that rounding never decides between centroids.
_SLACK = 1e-9


@dataclass
class Tree:
    """A balanced tree of balls over the rows of ``x``, which it puts in order.  Ball b has the rows from
    ``low[b]`` to ``high[b]``; its children are 2 b + 1 and 2 b + 2, where ``low`` is not -1."""

    order: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        n, dim = x.shape
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        balls = (2 << depth) - 1
        order = np.arange(n)
        low, high = np.full(balls, -1, np.int64), np.full(balls, -1, np.int64)
        centre, radius, total = np.zeros((balls, dim)), np.zeros(balls), np.zeros((balls, dim), np.int64)
        low[0], high[0] = 0, n
        for b in range(balls):
            if low[b] < 0 or low[b] == high[b]:
                low[b] = -1
                continue
            rows = x[order[low[b] : high[b]]]
            total[b] = rows.sum(axis=0)
            centre[b] = total[b] / len(rows)
            away = rows - centre[b]
            away = np.einsum("ij,ij->i", away, away)
            radius[b] = np.sqrt(away.max()) * (1 + _SLACK)
            if 2 * b + 2 >= balls:
                continue
            one = rows[away.argmax()]  # split by the distance to the two ends of a long way through the ball
            to_one = ((rows - one).astype(np.float64) ** 2).sum(axis=1)
            two = rows[to_one.argmax()]
            half = len(rows) // 2
            order[low[b] : high[b]] = order[low[b] : high[b]][np.argpartition(rows @ (two - one), half)] if len(rows) > 1 else order[low[b] : high[b]]
            low[2 * b + 1], high[2 * b + 1] = low[b], low[b] + half
            low[2 * b + 2], high[2 * b + 2] = low[b] + half, high[b]
        return cls(order, x[order], low, high, centre, radius, total)

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(whole balls as (ball, centroid), rows of leaves that were looked into, their centroids).  Ties go
        to the centroid of smaller number."""
        sure: list[tuple[int, int]] = []
        rows, nearest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        balls, open_ = np.array([0] if len(self.x) else [], np.int64), np.ones((1 if len(self.x) else 0, len(centroids)), bool)
        far = centroids.astype(np.float64)
        while len(balls):
            gap = np.stack([np.sqrt(((self.centre[balls] - c) ** 2).sum(axis=1)) for c in far], axis=1)
            gap[~open_] = np.inf
            r = self.radius[balls][:, None]
            reach = (gap.min(axis=1)[:, None] + r) * (1 + _SLACK)
            open_ &= (gap - r) * (1 - _SLACK) <= reach + _SLACK  # nothing in the ball is nearer to the others
            only = open_.sum(axis=1) == 1
            sure += zip(balls[only].tolist(), open_[only].argmax(axis=1).tolist(), strict=True)
            balls, open_ = balls[~only], open_[~only]
            leaf = (2 * balls + 2 >= len(self.low)) | (self.low[np.minimum(2 * balls + 1, len(self.low) - 1)] < 0)
            for b, some in zip(balls[leaf].tolist(), open_[leaf], strict=True):
                at = np.arange(self.low[b], self.high[b])
                which = np.nonzero(some)[0]
                rows.append(at)
                nearest.append(which[squared(self.x[at], centroids[which]).argmin(axis=1)])
            balls, open_ = balls[~leaf], open_[~leaf]
            balls = np.concatenate((2 * balls + 1, 2 * balls + 2))
            open_ = np.concatenate((open_, open_))
            held = self.low[balls] >= 0
            balls, open_ = balls[held], open_[held]
        return sure, np.concatenate(rows), np.concatenate(nearest)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each of ``x``."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


_ARRAYS = ["low", "high", "centre", "radius", "total", "x"]


def trees(vectors: DataFrame, dim: int, scale: float, block: int = BLOCK) -> DataFrame:
    """(ids, and the arrays of the tree as bytes) of every block of the (id, v) of ``vectors``; ``v`` becomes
    floor(scale * v)."""

    def row(ids: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        tree = Tree.build(x)
        ids = pa.concat_arrays(ids).take(pa.array(tree.order))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([getattr(tree, a).tobytes()], pa.binary()) for a in _ARRAYS)], ["ids", *_ARRAYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                flat = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(scale * flat.reshape(-1, dim))
                if len(x) and np.abs(x).max() > MOST:
                    raise OverflowError(f"components beyond {MOST} have squared distances that no 64-bit number holds")
                while len(x):
                    k = min(block - held, len(x))
                    ids.append(some.column(0).slice(some.num_rows - len(x), k))
                    parts.append(x[:k].astype(np.int64))
                    held, x = held + k, x[k:]
                    if held == block:
                        yield row(ids, parts)
                        ids, parts, held = [], [], 0
        if held:
            yield row(ids, parts)

    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", "v").mapInArrow(run, f"ids array<{kind}>, {', '.join(f'{a} binary' for a in _ARRAYS)}")


def _read(batch: pa.RecordBatch, k: int, dim: int) -> Tree:
    raw = {a: batch.column(batch.schema.get_field_index(a))[k].as_buffer() for a in _ARRAYS}
    kinds = {"centre": np.float64, "radius": np.float64}
    found = {a: np.frombuffer(b, kinds.get(a, np.int64)) for a, b in raw.items()}
    for a in ("centre", "total", "x"):
        found[a] = found[a].reshape(-1, dim)
    return Tree(order=np.zeros(0, np.int64), **found)


def round_sums(stored: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]] | None]:
    """(count, sum of each component) of the vectors nearest to each centroid, None where there are none.  A
    task adds up what it reads, so the driver gets a row for each centroid and component."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, np.zeros((k, dim), object)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _read(batch, i, dim)
                sure, rows, nearest = tree.assign(centroids)
                here, several = np.zeros((k, dim), np.int64), np.bincount(nearest, minlength=k)
                np.add.at(here, nearest, tree.x[rows])
                for b, c in sure:
                    here[c] += tree.total[b]
                    several[c] += tree.high[b] - tree.low[b]
                total += here
                count = [a + int(b) for a, b in zip(count, several, strict=True)]
        some = [c for c in range(k) if count[c]]
        cols = [pa.array([c for c in some for _ in range(dim)], pa.int32()), pa.array(list(range(dim)) * len(some), pa.int32()), pa.array([count[c] for c in some for _ in range(dim)], pa.int64()), pa.array([str(s) for c in some for s in total[c]], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["c", "at", "n", "s"])

    part = stored.mapInArrow(run, "c int, at int, n long, s string")
    exact = F.sum(F.col("s").cast("decimal(38,0)"))
    found: list[tuple[int, list[int]] | None] = [None] * k
    for r in part.groupBy("c", "at").agg(F.sum("n").alias("n"), exact.alias("s")).orderBy("c", "at").collect():
        if found[r.c] is None:
            found[r.c] = (r.n, [])
        found[r.c][1].append(int(r.s))
    return found


def assigned(stored: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """(id, cluster, distance) of every vector of the stored trees."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _read(batch, i, dim)
                cluster = np.zeros(len(tree.x), np.int32)
                sure, rows, nearest = tree.assign(centroids)
                cluster[rows] = nearest
                for b, c in sure:
                    cluster[tree.low[b] : tree.high[b]] = c
                distance = ((tree.x - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return stored.mapInArrow(run, f"id {kind}, cluster int, distance long")


def first_centroids(vectors: DataFrame, number: int, scale: float) -> np.ndarray:
    """The ``number`` vectors of the (id, v) whose ``1:<id>`` has the smallest SHA-256; of one id the lesser
    components come first, and null ids last."""
    hashed = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("h"), F.transform("v", lambda x: F.floor(x * F.lit(scale))).alias("x"))
    rows = hashed.orderBy(F.asc_nulls_last("h"), "x").limit(number).collect()
    return np.array([r.x for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: float = 64.0, number: int = 16, rounds: int = 3, block: int = BLOCK) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component x counts as
    floor(scale * x).  The first centroids are ``first_centroids``.  Each round gives every vector to its
    nearest centroid, the one of smaller number where two are as near, and moves every centroid that has
    vectors to the floor of their mean; then vectors are given once more.  Distances are squared and exact,
    and so are the sums; ``centroid_sha256`` digests the cluster's final centroid.

    Repeated rows and ids count each; rows with a null id are clustered but start no cluster while there are
    others.  With fewer vectors than centroids there are as many centroids as vectors.  An empty table, or one
    without a kept vector, gives an empty result.  Further columns aren't looked at.  Components beyond
    ``MOST`` are an error, as their distances fit no 64-bit number.
    """
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") == dim) & ~odd)
    kind = dict(kept.dtypes)["id"]
    schema = f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(kept, number, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    stored = materialize(trees(kept, dim, scale, block), "balls")
    for _ in range(rounds):
        for c, found in enumerate(round_sums(stored, centroids)):
            if found:
                centroids[c] = [s // found[0] for s in found[1]]
    rows = materialize(assigned(stored, centroids, kind), "assigned")
    # one row for each centroid, whose number is a parameter
    digest = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = rows.agg(F.sum("distance").alias("inertia"))
    ends = sums.join(F.broadcast(vectors.sparkSession.createDataFrame(digest, "cluster int, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(whole))
    return rows.join(F.broadcast(ends), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
