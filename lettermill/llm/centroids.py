"""Exact centroid clustering of integer vectors by filtering kd-trees.

Each task builds kd-trees over blocks of its vectors; a node holds its vectors' count, sums and box. In a round, centroids that another one
beats everywhere in a node's box are dropped on the way down; a node that one centroid is left for is counted whole, and what reaches a
leaf is compared vector by vector. All numbers are integers, so results do not depend on how vectors lie in partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors in a tree and in a leaf.
BLOCK, LEAF = 16384, 64
#: Components below this keep squared distances within 64 bits.
LARGEST = 1 << 27
TREE = "vectors binary, first binary, end binary, child binary, low binary, high binary, sums binary"


class Tree:
    """A kd-tree over integer vectors: nodes split at the median of their box's widest side, until they are small or their vectors are equal."""

    __slots__ = ("vectors", "first", "end", "child", "low", "high", "sums")

    @classmethod
    def over(cls, vectors: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it holds the vectors."""
        order = np.arange(len(vectors))
        first, end, child, low, high = [0], [len(vectors)], [-1], [], []
        at = 0
        while at < len(first):  # nodes are numbered as they are made; a node's second child follows its first
            a, b = first[at], end[at]
            own = vectors[order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            low.append(lo)
            high.append(hi)
            widest = int(np.argmax(hi - lo))
            if b - a > leaf and hi[widest] > lo[widest]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, widest], half)]
                child[at] = len(first)
                first += [a, a + half]
                end += [a + half, b]
                child += [-1, -1]
            at += 1
        tree = cls()
        tree.vectors = np.ascontiguousarray(vectors[order])
        tree.first, tree.end, tree.child = (np.array(x, np.int64) for x in (first, end, child))
        tree.low, tree.high = np.array(low, np.int64), np.array(high, np.int64)
        before = np.concatenate([np.zeros((1, vectors.shape[1]), np.int64), np.cumsum(tree.vectors, axis=0, dtype=np.int64)])
        tree.sums = before[tree.end] - before[tree.first]
        return tree, order

    def stored(self) -> list[bytes]:
        return [np.asarray(getattr(self, name), np.int64 if name in ("first", "end", "child", "sums") else np.int32).tobytes() for name in self.__slots__]

    @classmethod
    def read(cls, columns: list[bytes], dims: int) -> Tree:
        tree = cls()
        for name, data in zip(cls.__slots__, columns, strict=True):
            x = np.frombuffer(data, np.int64 if name in ("first", "end", "child", "sums") else np.int32).astype(np.int64)
            setattr(tree, name, x if name in ("first", "end", "child") else x.reshape(-1, dims))
        return tree

    def groups(self, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | int]]:
        """Of each part that is settled: (node, None, centroid) for a whole node, (node, squared distances, centroids) for a leaf's vectors."""
        exact = max(int(np.abs(centres).max()), int(np.abs(self.low[0]).max()), int(np.abs(self.high[0]).max())) < 1 << 20
        kind = np.float64 if exact else np.int64  # products and sums of such numbers are exact in either
        norms = (centres * centres).sum(axis=1)
        stack = [(0, np.arange(len(centres)))]
        while stack:
            node, left = stack.pop()
            left = self._undominated(node, left, centres)
            if len(left) == 1:
                yield node, None, int(left[0])
            elif self.child[node] >= 0:
                stack += [(int(self.child[node]), left), (int(self.child[node]) + 1, left)]
            else:
                x = self.vectors[self.first[node] : self.end[node]].astype(kind)
                z = centres[left].astype(kind)
                square = ((x * x).sum(axis=1)[:, None] - 2 * (x @ z.T) + norms[left].astype(kind)).astype(np.int64)
                best = np.argmin(square, axis=1)  # of equal ones the first, and so the smallest number
                yield node, square[np.arange(len(x)), best], left[best]

    def _undominated(self, node: int, left: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Without the centroids that are farther than the one nearest to the box's middle from every place in the box."""
        if len(left) == 1:
            return left
        lo, hi = self.low[node], self.high[node]
        z = centres[left]
        off = 2 * z - (lo + hi)
        star = z[np.argmin((off * off).sum(axis=1))]
        away = z - star
        # of all corners the one that lies farthest in the direction from the one to the other decides
        return left[(away * (z + star - 2 * np.where(away > 0, hi, lo))).sum(axis=1) <= 0]


def _trees(dims: int, scale: int, block: int):
    """Trees over blocks of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, kind = [], [], None

        def tree(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
            made, order = Tree.over(vectors)
            own = ids.take(pa.array(order))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *(pa.array([x], pa.binary()) for x in made.stored())], ["vec_ids", *Tree.__slots__])

        for b in batches:
            column = b.column("x")
            x = np.floor(np.asarray(column.flatten(), np.float64).reshape(-1, dims) * scale)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"components of {LARGEST / scale:g} and more have no squared distances in 64 bits")
            kind = b.column("vec_id").type
            ids.append(b.column("vec_id"))
            held.append(x.astype(np.int32))
            while sum(map(len, held)) >= block:
                all_ids, all_held = pa.concat_arrays(ids), np.concatenate(held)
                yield tree(all_ids[:block], all_held[:block])
                ids, held = [all_ids[block:]], [all_held[block:]]
        if sum(map(len, held)):
            yield tree(pa.concat_arrays(ids), np.concatenate(held))

    return run


def _read(b: pa.RecordBatch, dims: int) -> Iterator[tuple[int, Tree]]:
    for k in range(b.num_rows):
        yield k, Tree.read([b.column(c)[k].as_py() for c in Tree.__slots__], dims)


def _sums(centres: np.ndarray):
    """Of a task's trees: for each centroid the number (place -1) and the sums (place 0 on) of the vectors nearest to it."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            for _, tree in _read(b, dims):
                for node, square, nearest in tree.groups(centres):
                    if square is None:
                        total[nearest, 0] += tree.end[node] - tree.first[node]
                        total[nearest, 1:] += tree.sums[node]
                    else:
                        np.add.at(total[:, 0], nearest, 1)
                        np.add.at(total[:, 1:], nearest, tree.vectors[tree.first[node] : tree.end[node]])
        cluster, place = np.nonzero(np.repeat(total[:, :1] > 0, dims + 1, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place - 1, pa.int32()), pa.array(total[cluster, place])], ["cluster", "place", "n"])

    return run


def _nearest(centres: np.ndarray):
    """Each vector's centroid and squared distance."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, tree in _read(b, dims):
                cluster, distance = np.zeros((2, len(tree.vectors)), np.int64)
                for node, square, nearest in tree.groups(centres):
                    at = slice(tree.first[node], tree.end[node])
                    if square is None:
                        away = tree.vectors[at] - centres[nearest]
                        square = (away * away).sum(axis=1)
                    cluster[at], distance[at] = nearest, square
                yield pa.RecordBatch.from_arrays([b.column("vec_ids")[k].values, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def clustered(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster and squared distance of each vector; the final centroids).

    Vectors of exactly `dims` components, none null or non-finite, become integers floor(scale * x); others go. Centroids begin as the k vectors
    whose hash of seed, colon and vec_id is smallest. A round moves each centroid that has vectors to the floor of their mean; a vector
    belongs to the nearest centroid, of equally near ones to that of the smallest number. The driver gets k centroids and k * dims sums a round.

    Repeated rows are vectors of their own, also as first centroids (of one vec_id the smaller vector first); a null vec_id is clustered but begins
    no centroid; with fewer vectors than k there are fewer centroids. No vectors give no rows. Components of 2 ** 27 / scale and more are an
    error, as their squared distances need more than 64 bits. Other columns are ignored.
    """
    usable = (F.size("x") == dims) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(F.coalesce(usable, F.lit(False)))
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    trees = written(rows.mapInArrow(_trees(dims, scale, block), f"vec_ids array<{kind}>, {TREE}"), "kd-trees")
    first = rows.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.transform("x", lambda v: F.floor(v * scale))).limit(k)
    centres = np.array([[int(np.floor(v * scale)) for v in r.x] for r in first.select("x").collect()], np.int64).reshape(-1, dims)
    nodes = trees.drop("vec_ids")
    for _ in range(rounds if len(centres) else 0):
        sums = nodes.mapInArrow(_sums(centres), "cluster int, place int, n long").groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        found = {(r.cluster, r.place): int(r.n) for r in sums.collect()}
        centres = np.array([[found[c, i] // found[c, -1] for i in range(dims)] if (c, -1) in found else old.tolist() for c, old in enumerate(centres)], np.int64)
    if not len(centres):
        return trees.select(F.explode("vec_ids").alias("vec_id"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    assigned = trees.select("vec_ids", *Tree.__slots__).mapInArrow(_nearest(centres), f"vec_id {kind}, cluster int, distance long")
    return written(assigned, "kd-assigned"), centres.tolist()


def with_inertia(assigned: DataFrame, centres: list[list[int]]) -> DataFrame:
    """assigned with cluster_inertia, inertia (sums of squared distances of the cluster and of all) and centroid_sha256 (of the centroid's numbers, joined by commas).

    assigned is a stored table. A row for each centroid passes through the driver; rows without a cluster get nulls.
    """
    own = {r.cluster: r.n for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    whole = sum(n or 0 for n in own.values())
    rows = [(c, own.get(c, 0), whole, hashlib.sha256(",".join(map(str, z)).encode()).hexdigest()) for c, z in enumerate(centres)]
    each = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
