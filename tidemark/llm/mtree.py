"""Exact top-k search by inner product: a forest of M-trees, searched best first under stored triangle-inequality bounds."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, written

#: Rows of a leaf page, entries of an inner page, rows of a tree, trees of a group, queries that a task searches at once.
LEAF, FANOUT, TREE_ROWS, TREES, QUERY_BLOCK = 128, 16, 1 << 14, 8, 4096
#: Pivots at most, and rows that are worth a task of their own while trees are built.
PIVOTS, PART_ROWS = 256, 1024


@dataclass(frozen=True)
class Tree:
    """Pages over integer vectors, which lie in the order of the leaves.

    The metric is Euclid's after one more coordinate has brought all vectors to the same length: then the nearer, the larger
    the inner product. Page p holds the entries lo[p]:hi[p], of rows if it is a leaf, else of child pages. An entry of a
    child page has a routing row, a covering radius and its distance to the routing row of the page it is in; rows have that
    distance alone.
    """

    rows: np.ndarray
    ids: np.ndarray
    row_parent: np.ndarray
    leaf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least_id: np.ndarray
    root_row: np.ndarray
    router: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    child: np.ndarray
    longest: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as x:
            return Tree(**{f.name: x[f.name] for f in fields(Tree)})


def _power(x: np.ndarray) -> float:
    """1 for what squares safely, else a power of two that brings x under 2."""
    most = float(np.abs(x).max()) if x.size else 0.0
    return 1.0 if most < 2.0**400 else 2.0 ** min(1023, math.frexp(most)[1])


def build(rows: np.ndarray, ids: np.ndarray) -> Tree:
    """Bulk load: pivots far from each other share out the rows, page by page, until they fit a leaf."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    small = rows / _power(rows)
    square = (small * small).sum(axis=1)
    longest = square.max()
    points = np.concatenate([small, np.sqrt(np.maximum(longest - square, 0))[:, None]], axis=1)
    distance = lambda at, to: np.sqrt(np.maximum(((points[at] - points[to]) ** 2).sum(axis=1), 0))
    pages: list[list] = [[]]  # leaf, lo, hi, least id
    entries: dict[str, list[np.ndarray]] = {n: [] for n in ("router", "radius", "parent", "child")}
    placed: list[np.ndarray] = []
    parents: list[np.ndarray] = []
    sizes = [0, 0]
    todo = [(0, np.arange(len(rows)), 0)]
    while todo:
        number, own, router = todo.pop()
        if len(own) <= LEAF:
            placed.append(own)
            parents.append(distance(own, router))
            pages[number] = [True, sizes[0], sizes[0] + len(own), ids[own].min()]
            sizes[0] += len(own)
            continue
        pivots = [int(own[0])]
        near = distance(own, pivots[0])
        side = np.zeros(len(own), np.int64)
        for k in range(1, min(FANOUT, -(-len(own) // LEAF))):
            if near.max() <= 0:
                break
            pivots.append(int(own[near.argmax()]))
            to = distance(own, pivots[-1])
            side[to < near] = k
            near = np.minimum(near, to)
        groups = [own[side == k] for k in range(len(pivots))]
        if len(pivots) == 1:  # equal rows: cut them in the order of their ids
            groups = np.array_split(own, min(FANOUT, -(-len(own) // LEAF)))
            pivots *= len(groups)
        children = np.arange(len(pages), len(pages) + len(groups))
        pages += [[] for _ in groups]
        todo += zip(children.tolist(), groups, pivots, strict=True)
        router_rows = np.array(pivots)
        for name, value in (("router", router_rows), ("radius", np.array([distance(g, p).max() for g, p in zip(groups, pivots, strict=True)])), ("parent", distance(router_rows, router)), ("child", children)):
            entries[name].append(value)
        pages[number] = [False, sizes[1], sizes[1] + len(children), ids[own].min()]
        sizes[1] += len(children)
    leaf, lo, hi, least = (np.array(x) for x in zip(*pages, strict=True))
    placed_at = np.concatenate(placed)
    where = np.argsort(placed_at)
    flat = {n: np.concatenate(v) if v else np.zeros(0) for n, v in entries.items()}
    return Tree(rows[placed_at], ids[placed_at], np.concatenate(parents), leaf, lo, hi, least, where[:1], where[flat["router"].astype(np.int64)], flat["radius"], flat["parent"], flat["child"].astype(np.int64), np.array([longest]))


_LEAST, _MOST = -(2**63), 2**63 - 1


def search(tree: Tree, query: np.ndarray, own_id: int, k: int, best: list[tuple[int, int]], seen: list[int] | None = None) -> None:
    """Puts the tree's best rows for the query into best, a heap of (score, -id) that holds k at most. seen counts distances computed.

    Where doubles do not hold inner products as whole numbers, they still bound pages and rows, with room for their error, and
    the rows left are scored in whole numbers of any length, then cut to a long.
    """
    whole = exact(tree.rows, query)
    power, by = _power(tree.rows), _power(query)
    rows, asked = (tree.rows, query) if power == by == 1 else (tree.rows / power, query / by)
    unit = int(power) * int(by)
    words = None if whole else [int(x) for x in query]
    reach = float(asked @ asked + tree.longest[0])
    slack = (1e-9 if whole else 1e-6) * reach + (1e-6 if unit == 1 else 0.0)
    far = lambda score: np.sqrt(np.maximum(reach - 2.0 * score, 0.0))
    todo = [(0.0, 0, float(far(rows[tree.root_row[0]] @ asked)))]
    while todo:
        bound, p, to_router = heapq.heappop(todo)
        lo, hi = tree.lo[p], tree.hi[p]
        full = len(best) == k
        if full:
            # the k-th score in the units of the bounds; one cut to a long bounds nothing above it
            least = float(np.float64(best[0][0] / unit)) if unit > 1 else float(best[0][0])
            most = (reach - bound * bound) / 2 + slack
            most = np.floor(most) if whole else most
            if most < least:
                return
            if whole and most == least and tree.least_id[p] > -best[0][1]:
                continue
            limit = float(far(least)) + (slack if whole else math.sqrt(slack))
        if tree.leaf[p]:
            at = np.arange(lo, hi)
            if full:
                at = at[np.abs(to_router - tree.row_parent[lo:hi]) <= limit]
            scores, ids = rows[at] @ asked, tree.ids[at]
            if seen is not None:
                seen[0] += len(ids)
            if full:
                good = scores >= least - (0.0 if whole else slack)
                scores, ids, at = scores[good], ids[good], at[good]
            if whole:
                found = scores.astype(np.int64).tolist()
            else:
                found = [max(_LEAST, min(_MOST, sum(int(a) * b for a, b in zip(r, words, strict=True)))) for r in tree.rows[at].tolist()]
            for entry in zip(found, (-ids).tolist(), strict=True):
                if -entry[1] == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        else:
            at = np.arange(lo, hi)
            if full:
                at = at[np.abs(to_router - tree.parent[lo:hi]) - tree.radius[lo:hi] <= limit]
            to = far(rows[tree.router[at]] @ asked)
            if seen is not None:
                seen[0] += len(at)
            for d, r, c in zip(to.tolist(), tree.radius[at].tolist(), tree.child[at].tolist(), strict=True):
                heapq.heappush(todo, (max(bound, d - r), c, d))


def matrix(vectors: list, width: int = 0) -> np.ndarray:
    """floor(1024 x) of every component, in doubles; shorter vectors end in zeros."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(1024.0 * np.asarray(v, np.float64))
    return out


def exact(rows: np.ndarray, query: np.ndarray) -> bool:
    """Whether inner products are whole numbers that doubles hold: how scores are computed, not how they are found."""
    if max(_power(rows), _power(query)) > 1:
        return False
    return rows.size == 0 or query.size == 0 or float(np.abs(rows).max()) * float(np.abs(query).max()) * rows.shape[1] < 2.0**53 and float((rows * rows).sum(axis=1).max()) < 2.0**53


def usable(vector: Column) -> Column:
    """Whether every component of a vector of doubles has a finite floor(1024 x); beyond 1.75e305 a double has none."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 1024.0) < float("inf")))


def _pivots(rows: DataFrame, n: int) -> list[list]:
    """The vectors of n of the rows (id, v), by least hash of the id: they only say which rows share a tree."""
    return [r.v for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(n).collect()]


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each tree of TREE_ROWS rows at most: part, pivot, number, centre, reach, tree (its pages as bytes).

    Every usable row with a key is in one tree. Rows go to the nearest of at most PIVOTS pivots, a sample, and are dealt by ranges of
    pivot and key, so that many rows of one pivot are many tasks; a tree's rows have one pivot (centre) and are no further than
    reach from it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n = rows.count()
    pivots = matrix(_pivots(rows, max(1, min(PIVOTS, -(-n // TREE_ROWS)))))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own, centres = _level(matrix(list(batch.v)), pivots)
                with np.errstate(over="ignore", invalid="ignore"):
                    batch["pivot"] = ((centres * centres).sum(axis=1) - 2 * (own @ centres.T)).argmin(axis=1).astype(np.int32)
                yield batch

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, now = TaskContext.get().partitionId(), 0, None
        ids: list[int] = []
        held: list = []

        def ready() -> pd.DataFrame:
            own, centres = _level(matrix(held), pivots[now : now + 1])
            with np.errstate(over="ignore", invalid="ignore"):
                reach = float(np.sqrt(((own - centres) ** 2).sum(axis=1)).max())
            return pd.DataFrame({"part": [part], "pivot": [now], "number": [number], "centre": [pivots[now]], "reach": [reach], "tree": [build(own, np.array(ids, np.int64)).to_bytes()]})

        for batch in batches:
            for i, v, pivot in zip(batch.id, batch.v, batch["pivot"], strict=True):
                if ids and (pivot != now or len(ids) == TREE_ROWS):
                    yield ready()
                    number += 1
                    ids, held = [], []
                now = pivot
                ids.append(i)
                held.append(v)
        if ids:
            yield ready()

    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parallel, -(-n // PART_ROWS)), -(-n // (TREES * TREE_ROWS)))
    dealt = rows.mapInPandas(nearest, "id long, v array<double>, pivot int").repartitionByRange(parts, "pivot", "id").sortWithinPartitions("pivot", "id")
    return dealt.mapInPandas(trees, "part int, pivot int, number int, centre array<double>, reach double, tree binary")


def _level(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the width of the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


@dataclass(frozen=True)
class Balls:
    """What is known of the rows of each pivot: none is further than reach from centre, so no inner product with a query q is
    over q centre + |q| reach. At most PIVOTS of them."""

    pivot: np.ndarray
    centre: np.ndarray
    reach: np.ndarray

    @staticmethod
    def of(index: DataFrame) -> Balls:
        found = index.groupBy("pivot").agg(F.first("centre").alias("centre"), F.max("reach").alias("reach")).orderBy("pivot").collect()
        width = max((len(r.centre) for r in found), default=0)
        return Balls(np.array([r.pivot for r in found], np.int32), np.array([r.centre + [0.0] * (width - len(r.centre)) for r in found]).reshape(len(found), width), np.array([r.reach for r in found]))

    def first(self, queries: np.ndarray) -> np.ndarray:
        """The pivot with the largest inner product for each query."""
        q, centre = _level(queries, self.centre)
        with np.errstate(over="ignore", invalid="ignore"):
            return self.pivot[(q @ centre.T).argmax(axis=1)]

    def open(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which pivots (columns) may have rows that score least or more, with room for rounding; least is -inf for no bound."""
        q, centre = _level(queries, self.centre)
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((q * q).sum(axis=1))[:, None]
            most = q @ centre.T + length * self.reach
            room = 1e-9 * length * (np.sqrt((centre * centre).sum(axis=1)) + self.reach)
            return ~(most + room < least[:, None])  # what overflows stays open


def searched_groups(balls: Balls, asked: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, id, v, least, least_id): the groups that each query (id, v, least, least_id, own) still has to pass, which are those of
    open pivots but the one (own) that it has been to."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                least = batch.least.astype("float64").to_numpy(na_value=np.nan)
                may = balls.open(matrix(list(batch.v)), np.where(np.isnan(least), -np.inf, least))
                yield batch.assign(pivots=[balls.pivot[m].tolist() for m in may])

    opened = asked.mapInPandas(ask, "id long, v array<double>, least long, least_id long, own string, pivots array<int>")
    return opened.withColumn("pivot", F.explode("pivots")).join(groups, "pivot").where("g <> own").select("g", "id", "v", "least", "least_id")


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of each query with rows of another key; ties to smaller keys.

    Trees of a pivot, TREES at most, are a group, held by one task. A query first passes one group of the pivot that it has the
    largest inner product with. Its k-th score there goes with it to the groups of those pivots that may still beat it, and to no
    others; they hand on what does. Queries pass a group QUERY_BLOCK at a time; through the driver go counts and PIVOTS vectors.
    Vectors that are null or hold null or non-finite components, or one over 1.75e305 in size (usable()), and null keys, take no part;
    of repeated queries one is answered; repeated rows are found as often as they stand there. Scores beyond a long are cut to
    its range, then ties again go to smaller keys; no rows or no queries give no rows.
    """
    spark = index.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = index.count()
    together = max(1, min(TREES, n // parallel))
    tasks = max(1, -(-n // together))
    g = F.concat_ws(":", "pivot", "part", F.floor(F.col("number") / together))
    groups = index.select("pivot", g.alias("g")).distinct()
    balls = Balls.of(index)
    if not len(balls.pivot):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = queries.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(pivot=balls.first(matrix(list(batch.v))))

    def search_group(held: list[Tree], some: list[tuple]) -> pd.DataFrame:
        vectors = matrix([v for _, v, _ in some])
        # a k-th score from elsewhere stands k times, to be beaten; one cut to a long's least bounds nothing
        best: list[list] = [[] if floor is None else [floor] * k for _, _, floor in some]
        for tree in held:
            width = max(tree.rows.shape[1], vectors.shape[1])
            wide = replace(tree, rows=np.pad(tree.rows, ((0, 0), (0, width - tree.rows.shape[1]))))
            for (own, _, _), query, heap in zip(some, np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))), best, strict=True):
                search(wide, query, own, k, heap)
        out = [(q, -i, s) for (q, _, floor), heap in zip(some, best, strict=True) for s, i in heap if floor is None or (s, i) > floor]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, some = None, [], []
        for batch in batches:
            for at, kind, i, v, least, least_id, tree in zip(*(batch[c] for c in ("g", "kind", "id", "v", "least", "least_id", "tree")), strict=True):
                if at != now:
                    if some:
                        yield search_group(held, some)
                    now, held, some = at, [], []
                if kind == 0:
                    held.append(Tree.from_bytes(tree))
                    continue
                some.append((i, v, None if least is None or int(least) == _LEAST else (int(least), -int(least_id))))
                if len(some) == QUERY_BLOCK:
                    yield search_group(held, some)
                    some = []
        if some:
            yield search_group(held, some)

    none = F.lit(None).cast("long")
    trees = index.select(g.alias("g"), F.lit(0).alias("kind"), none.alias("id"), F.lit(None).cast("array<double>").alias("v"), none.cast("string").alias("least"), none.cast("string").alias("least_id"), "tree")

    def passed(some: DataFrame) -> DataFrame:
        """Queries (g, id, v, least, least_id) through their groups."""
        # numbers as text: pandas would turn a column of longs with nulls into doubles
        each = some.select("g", F.lit(1).alias("kind"), "id", "v", F.col("least").cast("string").alias("least"), F.col("least_id").cast("string").alias("least_id"), F.lit(None).cast("binary").alias("tree"))
        rows = trees.withColumn("id", F.lit(0).cast("long")).unionByName(each).repartition(tasks, "g").sortWithinPartitions("g", "kind", "id")
        return rows.mapInPandas(run, "query_id long, vec_id long, score long")

    counts = groups.groupBy("pivot").agg(F.count("*").alias("m"))
    placed = groups.withColumn("at", F.row_number().over(Window.partitionBy("pivot").orderBy("g")) - 1)
    own = asked.mapInPandas(first, "id long, v array<double>, pivot int").join(counts, "pivot").withColumn("at", F.pmod(F.xxhash64("id"), "m").cast("int")).join(placed, ["pivot", "at"])
    sent, sent_at = written(own.select("g", "id", "v", none.alias("least"), none.alias("least_id")), "mtree-sent")
    near, near_at = written(passed(sent), "mtree-near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"), F.col("vec_id").alias("least_id"))
    again = sent.select("id", "v", F.col("g").alias("own")).join(kth, "id", "left").select("id", "v", "least", "least_id", "own")
    rest, rest_at = written(passed(searched_groups(balls, again, groups)), "mtree-rest")
    found = near.unionByName(rest)
    out, _ = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "mtree-found")
    drop(spark, sent_at, near_at, rest_at)
    return out


def search_report(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k best of every row for the rows whose id is divisible by every; top_k() says what odd rows, ties and empty tables give."""
    index, path = written(build_index(vectors), "mtree")
    out = top_k(index, vectors.where(F.col("vec_id") % every == 0), k)
    drop(vectors.sparkSession, path)
    return out
