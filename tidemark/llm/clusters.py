"""Centroid clustering over kd-trees: every partition keeps its vectors in trees whose nodes hold a count, integer sums and a box.

A round carries the centroids down each tree. At a node one candidate near the middle of the box is taken, and every other one
that is farther away than it at all points of the box goes. A node with one candidate left is assigned whole, by its count and
sums; leaves with several compare their rows with them. All numbers are integers, so results do not depend on partitions.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, written

#: Rows of a tree and of a leaf; pairs of nodes and centroids that are compared at a time.
TREE_ROWS, LEAF_ROWS, PAIRS = 8192, 64, 1 << 14
#: Components must be smaller in size than this once they are integers: every distance and every test then fits 64 bits.
LIMIT = 1 << 26


@dataclass(frozen=True)
class Tree:
    """rows: the vectors, those of a node being rows[start:stop]; place: which input row each was; left is -1 for leaves."""

    rows: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as x:
            return Tree(**{f.name: x[f.name] for f in fields(Tree)})


def build(rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Nodes are halved at the middle row of their widest side; a node whose rows are all equal is a leaf of any size."""
    place = np.arange(len(rows))
    low, high, sums, start, stop, left, right = [], [], [], [], [], [], []
    todo = [(0, len(rows), -1, left)]
    while todo:
        a, b, parent, side = todo.pop()
        own = rows[place[a:b]]
        node = len(start)
        if parent >= 0:
            side[parent] = node
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        sums.append(own.sum(axis=0))
        start.append(a)
        stop.append(b)
        left.append(-1)
        right.append(-1)
        width = high[-1] - low[-1]
        if b - a <= leaf_rows or not width.any():
            continue
        middle = (b - a) // 2
        place[a:b] = place[a:b][np.argpartition(own[:, width.argmax()], middle)]
        todo += [(a, a + middle, node, left), (a + middle, b, node, right)]
    each = [np.array(x, np.int64) for x in (low, high, sums, start, stop, left, right)]
    return Tree(rows[place], place, *each)


def settle(tree: Tree, centers: np.ndarray, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that are assigned whole with their clusters, and leaves with the candidates (one row of flags each) they are left with.

    compared[0] grows by the pairs of a node and a centroid that were tested."""
    k = len(centers)
    _, first = np.unique(centers, axis=0, return_index=True)
    flags = np.zeros((1, k), bool)
    flags[0, first] = True  # of equal centroids only the first can win
    nodes, whole, owner, leaves, open_flags = np.zeros(1, np.int64), [], [], [], []
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        middle, twice = (low + high).astype(np.float64), 2.0 * centers
        near = (twice * twice).sum(axis=1) - 2.0 * middle @ twice.T
        near[~flags] = np.inf
        best = near.argmin(axis=1)  # any candidate would be right here, so doubles may choose it
        others = flags.copy()
        others[np.arange(len(nodes)), best] = False
        at, z = np.nonzero(others)
        if compared is not None:
            compared[0] += len(at)
        for lo in range(0, len(at), PAIRS):
            n, c = at[lo : lo + PAIRS], z[lo : lo + PAIRS]
            towards = centers[c] - centers[best[n]]
            corner = np.where(towards > 0, high[n], low[n])
            farther = (towards * (centers[c] + centers[best[n]] - 2 * corner)).sum(axis=1) > 0
            flags[n[farther], c[farther]] = False
        alone = flags.sum(axis=1) == 1
        whole.append(nodes[alone])
        owner.append(flags[alone].argmax(axis=1))
        left = tree.left[nodes]
        end = ~alone & (left < 0)
        leaves.append(nodes[end])
        open_flags.append(flags[end])
        go = ~alone & (left >= 0)
        nodes, flags = np.concatenate([left[go], tree.right[nodes[go]]]), np.concatenate([flags[go], flags[go]])
    return np.concatenate(whole), np.concatenate(owner), np.concatenate(leaves), np.concatenate(open_flags)


def _places(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the nodes, and which node (by its place in nodes) each belongs to."""
    n = tree.stop[nodes] - tree.start[nodes]
    of = np.repeat(np.arange(len(nodes)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + tree.start[nodes][of], of


def _nearest(rows: np.ndarray, flags: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest of each row's candidates, the smaller number of equals; in doubles only where these hold every product."""
    exact = len(rows) and float(np.abs(rows).max()) * float(np.abs(centers).max()) * rows.shape[1] < 2.0**51
    products = (rows.astype(np.float64) @ centers.T.astype(np.float64)).astype(np.int64) if exact else rows @ centers.T
    far = (centers * centers).sum(axis=1) - 2 * products
    far[~flags] = np.iinfo(np.int64).max
    return far.argmin(axis=1)


def sums(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count and the sums of the rows that are nearest to each centroid."""
    whole, owner, leaves, flags = settle(tree, centers)
    count, total = np.zeros(len(centers), np.int64), np.zeros(centers.shape, np.int64)
    np.add.at(count, owner, tree.stop[whole] - tree.start[whole])
    np.add.at(total, owner, tree.sums[whole])
    if len(leaves):
        at, of = _places(tree, leaves)
        found = _nearest(tree.rows[at], flags[of], centers)
        np.add.at(count, found, 1)
        np.add.at(total, found, tree.rows[at])
    return count, total


def assigned(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and the squared distance of each row that the tree was built from, in their order."""
    whole, owner, leaves, flags = settle(tree, centers)
    found = np.zeros(len(tree.rows), np.int64)
    at, of = _places(tree, whole)
    found[at] = owner[of]
    if len(leaves):
        at, of = _places(tree, leaves)
        found[at] = _nearest(tree.rows[at], flags[of], centers)
    gap = tree.rows - centers[found]
    cluster, distance = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
    cluster[tree.place], distance[tree.place] = found, (gap * gap).sum(axis=1)
    return cluster, distance


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def usable(vector: Column, size: int, scale: int) -> Column:
    """Whether a vector has so many components, all finite, none so large that its integer leaves LIMIT."""
    held = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LIMIT / scale)
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, held), F.lit(False))


def forest(kept: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(ids, tree): trees of so many of a partition's rows (id long, v array<long>) at most. Map-only."""

    def made(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        flat = pa.chunked_array(ids).combine_chunks()
        held = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        return pa.RecordBatch.from_arrays([held, pa.array([build(np.concatenate(rows)).to_bytes()], pa.binary())], names=["ids", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, tree_rows - n)
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                n, at = n + part.num_rows, at + part.num_rows
                if n == tree_rows:
                    yield made(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield made(ids, rows)

    return kept.select("id", "v").mapInArrow(run, "ids array<long>, tree binary")


def _sums_of(trees: DataFrame, centers: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Counts and sums over all trees. Each task adds up its own; Spark adds the tasks' cells; the driver gets one table of clusters x components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centers), np.int64), np.zeros(centers.shape, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                n, s = sums(Tree.from_bytes(data), centers)
                count, total = count + n, total + s
        cells = np.hstack([count[:, None], total])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), flat], names=["cluster", "cells"])

    cells = trees.select("tree").mapInArrow(run, "cluster int, cells array<long>").select("cluster", F.posexplode("cells").alias("pos", "x"))
    out = [[0] * (centers.shape[1] + 1) for _ in centers]
    for cluster, pos, x in cells.groupBy("cluster", "pos").agg(F.sum(F.col("x").cast(T.DecimalType(38, 0)))).collect():
        out[cluster][pos] = int(x)
    return [row[0] for row in out], [row[1:] for row in out]


def first_centers(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt:id, in that order; of equal ids the smaller vector first."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = kept.where("id is not null").orderBy(order, "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def lloyd(trees: DataFrame, centers: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds: each moves to the floor of its rows' mean, componentwise; one without rows stays."""
    for _ in range(rounds):
        counts, totals = _sums_of(trees, centers)
        centers = np.array([[s // n for s in total] if n else own for n, total, own in zip(counts, totals, centers.tolist(), strict=True)], np.int64)
    return centers


def assignments(trees: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every row of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                cluster, distance = assigned(Tree.from_bytes(data), centers)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return trees.mapInArrow(run, "id long, cluster int, distance long")


def cluster_report(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, size: int = 64, salt: str = "2", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector, one row for each row.

    Vectors that are null, have another length, or hold a null or non-finite component take no part; neither do those with a
    component of LIMIT / scale (262,144) or more in size, whose squared distances a long might not hold. Repeated rows are rows of their own.
    A vector with a null id is assigned but never a first centroid. With fewer than k ids there are fewer clusters, without any no rows.
    An inertia that no long holds is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector}`")
    kept = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(usable(F.col("v"), size, scale)).select("id", integers(F.col("v"), scale).alias("v"))
    centers = first_centers(kept, k, salt)
    if not len(centers):
        return spark.createDataFrame([], f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees, path = written(forest(kept), "kd-trees")
    centers = lloyd(trees, centers, rounds)
    found, _ = written(assignments(trees, centers), "kd-assigned")
    drop(spark, path)
    total = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(T.DecimalType(38, 0))).alias("s")).collect()}  # a row a cluster
    fit = lambda x: x if x < 1 << 63 else None
    rows = [(c, fit(s), fit(sum(total.values())), hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for c, s in total.items()]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
