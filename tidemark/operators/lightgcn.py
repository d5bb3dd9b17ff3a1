"""Graph factors: embeddings propagated over users and liked items, trained on triples by Adam."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import left_to_caller, passing, written
from . import graph, sampling
from .factors import _sums, dot, lists_of, vectors_of
from .feedback import LIKED, liked
from .peers import Peers, Routes, task_count

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def vector_sums(parts: DataFrame, size: int) -> DataFrame:
    """(node, vec): the sum of w * vec over the parts (node, w, vec) of each node, added in the tasks before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names = b.column(0).dictionary_encode()
                keys, sums = _sums(names.indices.to_numpy().astype(np.int64), vectors_of(b.column(2)) * b.column(1).to_numpy()[:, None])
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys)), lists_of(sums)], names=["node", "vec"])

    once = parts.select("node", F.col("w").cast("double").alias("w"), "vec").mapInArrow(add, "node string, vec array<double>")
    cells = once.groupBy("node").agg(*(F.sum(F.col("vec")[k]).alias(str(k)) for k in range(size)))
    return cells.select("node", F.array(*(F.col(str(k)) for k in range(size))).alias("vec"))


def smoothed(a: DataFrame, vectors: DataFrame, layers: int, size: int) -> DataFrame:
    """The mean of the vectors and of their first so many propagations. It is its own transpose, so gradients take the same way back.

    v + a (v + a (v + ...)) needs one chain of joins, in which every layer is computed once.
    """
    every = now = vectors.select("node", F.lit(1.0).alias("w"), "vec")
    for _ in range(layers):
        step = a.join(now.select(F.col("node").alias("dst"), "vec"), "dst").select(F.col("src").alias("node"), "w", "vec")
        now = vector_sums(step.unionByName(every), size)
    return now.select("node", F.transform("vec", lambda x: x / (layers + 1)).alias("vec"))


def _initial(nodes: DataFrame, size: int, seed: int) -> DataFrame:
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vec = [np.random.default_rng([seed, *name.encode()]).normal(0, 0.1, size) for name in b["node"]]
            yield pd.DataFrame({"node": b["node"], "vec": vec, "m": [np.zeros(size)] * len(b), "v": [np.zeros(size)] * len(b)})

    return nodes.mapInPandas(draw, "node string, vec array<double>, m array<double>, v array<double>")


def _adam(rate: float, first: float, second: float):
    return lambda m, v: rate * m / first / (F.sqrt(v / second) + EPSILON)


def fit(y: DataFrame, size: int = 16, layers: int = 3, rate: float = 0.001, weight: float = 1e-4, epochs: int = 10, seed: int = 42, threshold: float = LIKED, batch_size: int = 2048, most_steps: int | None = None, losses: list[float] | None = None, in_tasks: bool = False) -> DataFrame:
    """(node, vec): final propagated factors, nodes named as in graph.edges(). Each epoch draws fresh triples and takes one Adam step
    for every batch_size of them, in the order of the draws, which is random: on the mean of -log sigmoid(score difference) plus
    half the weight times the mean squared norm of the embeddings drawn. A step's tables go with the next one.

    A step passes over the whole graph, so steps must not grow with the triples on large graphs: with most_steps an epoch takes
    at most so many, of larger batches, and the rate grows with the square root of the batch, as Adam asks. losses gets the mean
    loss of each epoch. With in_tasks the same steps are taken in barrier tasks (fit_in_tasks()), which is the way for many of them.
    """
    if in_tasks:
        if most_steps is not None:
            raise ValueError("barrier tasks take every step")
        return fit_in_tasks(y, size, layers, rate, weight, epochs, seed, threshold, batch_size, losses)
    if batch_size < 1 or (most_steps is not None and most_steps < 1):
        raise ValueError("batch_size and most_steps must be positive")
    spark = y.sparkSession
    likes = written(liked(y, threshold), "likes")
    a = written(graph.adjacency(graph.edges(likes)), "adjacency")
    items = written(y.select("itemid").distinct(), "items")
    ready = sampling.prepared(likes, items)
    nodes = y.select(F.concat(F.lit("u"), "userid").alias("node")).unionByName(y.select(F.concat(F.lit("i"), "itemid").alias("node"))).distinct()
    state, steps, old = written(_initial(nodes, size, seed), "embeddings"), 0, []
    for epoch in range(1, epochs + 1):
        with passing(spark):
            name = lambda c, of: F.concat(F.lit(of), c).alias
            triples = sampling.draws(likes, items, seed + epoch, ready).select("id", name("userid", "u")("u"), name("liked", "i")("p"), name("other", "i")("n"))
            size_now, rate_now = batch_size, rate
            if most_steps is not None and -(-ready.n_likes // batch_size) > most_steps:
                size_now = -(-ready.n_likes // most_steps)
                rate_now = rate * (size_now / batch_size) ** 0.5
            drawn = written(triples.withColumn("batch", F.floor(F.col("id") / size_now)), "triples")
            counts = sorted(drawn.groupBy("batch").count().collect())
            epoch_losses: list[float] = []
            for batch, n in counts:
                steps += 1
                some = drawn.where(F.col("batch") == batch).select("u", "p", "n")
                with passing(spark) as made:
                    made += old
                    state = written(_step(a, some, n, state, layers, size, rate_now, weight, steps), "embeddings")
                    old = [made.pop()]
                    if losses is not None:
                        epoch_losses.append(bpr_loss(smoothed(a, state.select("node", "vec"), layers, size), some))
            if losses is not None and epoch_losses:
                losses.append(sum(epoch_losses) / len(epoch_losses))
    left_to_caller(old)
    return written(smoothed(a, state.select("node", "vec"), layers, size), "smoothed")


#: Likes that a barrier task is given; epochs that one job takes at most, and triples that it takes beyond the first epoch.
LIKES_A_TASK, EPOCHS_A_JOB, TRIPLES_A_JOB = 1 << 14, 10, 1 << 22
#: Edges whose vectors a task multiplies at a time; cells for each edge up to which they are multiplied as one whole matrix.
EDGES, CELLS_AN_EDGE = 1 << 15, 16
_ROWS = "kind int, owner int, a long, b long, c long, at int, at2 int, epoch int, batch int, w double, x array<double>"


def fit_in_tasks(y: DataFrame, size: int = 64, layers: int = 3, rate: float = 0.001, weight: float = 1e-4, epochs: int = 1000, seed: int = 42, threshold: float = LIKED, batch_size: int = 2048, losses: list[float] | None = None, tasks: int | None = None) -> DataFrame:
    """The factors of fit(): one Adam step for every batch_size triples of each epoch. A job takes some epochs, not one step.

    Barrier tasks keep their users and items with their moments, and the edges of their users, from step to step. To propagate,
    a task fetches each item that its users like once, and sends back one sum for each: an item that everybody likes costs one
    row a task. A step sends these rows and the items of its triples from task to task; the state is written behind each job,
    where a lost task begins again. losses gets the mean over each epoch's batches of their loss before the step.
    """
    if batch_size < 1 or epochs < 0:
        raise ValueError("batch_size must be positive")
    spark = y.sparkSession
    likes = written(liked(y, threshold), "likes")
    a = written(graph.adjacency(graph.edges(likes)), "adjacency")
    items = written(y.select("itemid").distinct(), "items")
    ready = sampling.prepared(likes, items)
    nodes = y.select(F.concat(F.lit("u"), "userid").alias("node")).unionByName(y.select(F.concat(F.lit("i"), "itemid").alias("node"))).distinct()
    state, old = written(_initial(nodes, size, seed), "embeddings"), []
    n_tasks = tasks or task_count(spark, ready.n_likes, LIKES_A_TASK)
    n_batches = -(-ready.n_likes // batch_size)
    together = max(1, min(EPOCHS_A_JOB, TRIPLES_A_JOB // max(1, ready.n_likes)))
    owner = lambda node: F.pmod(F.xxhash64(node), F.lit(n_tasks)).cast("int")
    item_owner = lambda c: owner(F.concat(F.lit("i"), c))
    number = lambda c: F.expr(f"substring({c}, 2)").cast("long")
    names = [c.split()[0] for c in _ROWS.split(", ")]
    row = lambda df, **c: df.select(*((c[n] if n in c else F.lit(None)).cast(k).alias(n) for n, k in (x.split(" ", 1) for x in _ROWS.split(", "))))
    edges = row(a.where(F.col("src").startswith("u")), kind=F.lit(2), owner=owner(F.col("src")), a=number("src"), b=number("dst"), at=owner(F.col("dst")), w=F.col("w"))
    for first in range(0, epochs if n_batches else 0, together):
        last = min(epochs, first + together)
        with passing(spark) as made:
            made += old
            rows = row(state, kind=F.when(F.col("node").startswith("u"), 0).otherwise(1), owner=owner(F.col("node")), a=number("node"), x=F.concat("vec", "m", "v")).unionByName(edges)
            for epoch in range(first, last):
                d = sampling.draws(likes, items, seed + epoch + 1, ready)
                rows = rows.unionByName(row(d, kind=F.lit(3), owner=owner(F.concat(F.lit("u"), "userid")), a=F.col("userid"), b=F.col("liked"), c=F.col("other"), at=item_owner("liked"), at2=item_owner("other"), epoch=F.lit(epoch - first), batch=F.floor(F.col("id") / batch_size), w=F.col("id")))
            run = Training(size, layers, rate, weight, n_batches, first * n_batches, last - first, n_tasks > 1).run
            trained = written(rows.select(*names).repartitionById(n_tasks, "owner").mapInArrow(run, "kind int, a long, x array<double>", barrier=n_tasks > 1), "trained")
            if losses is not None:
                losses += [x for r in trained.where("kind = 2").select("x").collect() for x in r.x]
            part = lambda k: F.slice("x", k * size + 1, size)
            state = trained.where("kind < 2").select(F.concat(F.when(F.col("kind") == 0, "u").otherwise("i"), F.col("a").cast("string")).alias("node"), part(0).alias("vec"), part(1).alias("m"), part(2).alias("v"))
            old = [made.pop()]
    left_to_caller(old)
    return written(smoothed(a, state.select("node", "vec"), layers, size), "smoothed")


@dataclass(frozen=True)
class Training:
    """The task of a job: rows as in _ROWS in, (kind, a, x) of the vectors it keeps out, and from task 0 the losses."""

    size: int
    layers: int
    rate: float
    weight: float
    n_batches: int
    number: int
    epochs: int
    barrier: bool

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peers = Peers(BarrierTaskContext.get() if self.barrier else None)
        held = [b for b in batches if b.num_rows]
        whole = pa.Table.from_batches(held) if held else pa.table({c.split()[0]: [] for c in _ROWS.split(", ")})
        kinds = whole.column("kind").to_numpy(zero_copy_only=False)

        def columns(kind: int, *names: str) -> list[np.ndarray]:
            some = whole.take(pa.array(np.flatnonzero(kinds == kind), pa.int64()))
            return [some.column(c).to_numpy(zero_copy_only=False).astype(np.float64 if c == "w" else np.int64) for c in names]

        sides = []
        for kind in (0, 1):
            (ids,) = columns(kind, "a")
            at = np.flatnonzero(kinds == kind)
            x = vectors_of(whole.column("x").take(pa.array(at, pa.int64())).combine_chunks()).reshape(-1, 3, self.size) if len(at) else np.zeros((0, 3, self.size))
            order = np.argsort(ids)
            sides.append((ids[order], [np.ascontiguousarray(x[order, c]) for c in range(3)]))
        (users, of_users), (items, of_items) = sides
        smooth = self._smoother(peers, users, items, *columns(2, "a", "b", "at", "w"))
        user, liked_, other, at, at2, epoch, batch, place = columns(3, "a", "b", "c", "at", "at2", "epoch", "batch", "w")
        step = epoch * self.n_batches + batch
        order = np.lexsort((place, step))
        user, liked_, other, at, at2, step = (c[order] for c in (user, liked_, other, at, at2, step))
        user = np.searchsorted(users, user)
        bounds = np.searchsorted(step, np.arange(self.epochs * self.n_batches + 1))
        losses = np.zeros((self.epochs, 2))
        for s in range(self.epochs * self.n_batches):
            here = slice(bounds[s], bounds[s + 1])
            mine, k = user[here], bounds[s + 1] - bounds[s]
            both = np.concatenate([liked_[here], other[here]])
            wanted, first, inverse = np.unique(both, return_index=True, return_inverse=True)
            routes = Routes(peers, wanted, np.concatenate([at[here], at2[here]])[first], items)
            out_users, out_items = smooth(of_users[0], of_items[0])
            u, i = out_users[mine], routes.fetch(out_items)[inverse]
            p, q = i[:k], i[k:]
            gap = (u * (p - q)).sum(axis=1)
            n, loss = peers.total(np.array([k, np.logaddexp(0, -gap).sum()]))
            if not n:
                continue
            losses[s // self.n_batches] += (1, loss / n)
            g = (-1 / (1 + np.exp(gap)) / n)[:, None]
            outer_users, outer_items = np.zeros((len(users), self.size + 1)), np.zeros((len(items), self.size + 1))
            np.add.at(outer_users, mine, np.hstack([g * (p - q), np.ones((k, 1))]))
            back = np.zeros((len(wanted), self.size + 1))
            np.add.at(back, inverse, np.hstack([np.concatenate([g * u, -g * u]), np.ones((2 * k, 1))]))
            routes.push(back, outer_items)
            inner = smooth(outer_users[:, :-1], outer_items[:, :-1])
            for (vec, m, v), g_, drawn in ((of_users, inner[0], outer_users[:, -1:]), (of_items, inner[1], outer_items[:, -1:])):
                adam(vec, m, v, g_ + self.weight / n * drawn * vec, self.rate, self.number + s + 1)
        peers.close()
        for kind, (ids, (vec, m, v)) in enumerate(sides):
            for lo in range(0, len(ids), 1 << 12):
                yield _out(kind, ids[lo : lo + (1 << 12)], np.hstack([x[lo : lo + (1 << 12)] for x in (vec, m, v)]))
        if peers.me == 0:
            yield _out(2, np.zeros(1, np.int64), (losses[:, 1] / np.maximum(losses[:, 0], 1))[None])

    def _smoother(self, peers: Peers, users: np.ndarray, items: np.ndarray, src: np.ndarray, dst: np.ndarray, at: np.ndarray, w: np.ndarray):
        """smooth(rows of users, rows of items): the mean of them and of their propagations, over the edges of all tasks."""
        halo, first, item = np.unique(dst, return_index=True, return_inverse=True)
        routes = Routes(peers, halo, at[first], items)
        user = np.searchsorted(users, src)
        if len(users) * len(halo) <= CELLS_AN_EDGE * len(src):
            matrix = np.zeros((len(users), len(halo)))
            matrix[user, item] = w
            ways = [matrix, matrix.T]
        else:
            ways = []
            for to, of in ((user, item), (item, user)):
                order = np.lexsort((of, to))
                ways.append((to[order], of[order], w[order][:, None]))

        def spread(way: np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, n: int) -> np.ndarray:
            if isinstance(way, np.ndarray):
                return way @ rows
            to, of, weight = way
            out = np.zeros((n, self.size))
            for lo in range(0, len(to), EDGES):
                here = slice(lo, lo + EDGES)
                starts = np.flatnonzero(np.diff(to[here], prepend=-1))
                out[to[here][starts]] += np.add.reduceat(weight[here] * rows[of[here]], starts, axis=0)
            return out

        def smooth(of_users: np.ndarray, of_items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u, i = of_users, np.ascontiguousarray(of_items)
            for _ in range(self.layers):
                more = of_items.copy()
                to_users = spread(ways[0], routes.fetch(i), len(users))
                routes.push(spread(ways[1], u, len(halo)), more)
                u, i = of_users + to_users, more
            return u / (self.layers + 1), i / (self.layers + 1)

        return smooth


def _out(kind: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), lists_of(x)], names=["kind", "a", "x"])


#: Cells that an Adam step takes at a time: what it makes on the way stays in a processor's cache.
CELLS = 1 << 14


def adam(x: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: float, number: int, rows: np.ndarray | None = None) -> None:
    """The number-th step, in place. With rows g has these rows alone, each once, and is 0 in all others."""
    m, v, x, g = (a if a.ndim > 1 else a[:, None] for a in (m, v, x, g))
    if rows is not None:
        m *= BETA1
        v *= BETA2
        m[rows] += (1 - BETA1) * g
        v[rows] += (1 - BETA2) * g * g
    some = max(1, CELLS // max(1, x.shape[1]))
    one, two = 1 - BETA1**number, 1 - BETA2**number
    for lo in range(0, len(x), some):
        m_, v_, x_ = (a[lo : lo + some] for a in (m, v, x))
        if rows is None:
            g_ = g[lo : lo + some]
            m_ *= BETA1
            m_ += (1 - BETA1) * g_
            v_ *= BETA2
            v_ += (1 - BETA2) * g_ * g_
        root = v_ / two
        np.sqrt(root, out=root)
        root += EPSILON
        step = rate / one * m_
        step /= root
        x_ -= step


def _step(a: DataFrame, drawn: DataFrame, n: int, state: DataFrame, layers: int, size: int, rate: float, weight: float, number: int) -> DataFrame:
    """The state after one Adam step, the number-th, on n triples (u, p, n)."""
    out = written(smoothed(a, state.select("node", "vec"), layers, size), "smoothed")
    three = drawn
    for c in "upn":
        three = three.join(out.select(F.col("node").alias(c), F.col("vec").alias(f"v{c}")), c)

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, p, q = (vectors_of(b.column(c)) for c in ("vu", "vp", "vn"))
                g = -1 / (1 + np.exp((u * (p - q)).sum(axis=1, keepdims=True))) / n
                nodes = pa.concat_arrays([b.column(c) for c in "upn"])
                yield pa.RecordBatch.from_arrays([nodes, pa.array(np.ones(len(nodes))), lists_of(np.concatenate([g * (p - q), g * u, -g * u]))], names=["node", "w", "vec"])

    outer = written(vector_sums(three.mapInArrow(gradients, "node string, w double, vec array<double>"), size), "gradients")
    inner = smoothed(a, outer, layers, size)
    used = drawn.select(F.explode(F.array("u", "p", "n")).alias("node")).groupBy("node").agg((F.count("*") * weight / n).alias("decay"))
    zero = F.array(*(F.lit(0.0) for _ in range(size)))
    both = state.join(inner.withColumnRenamed("vec", "g"), "node", "left").join(used, "node", "left")
    g = F.zip_with(F.coalesce("g", zero), "vec", lambda x, e: x + e * F.coalesce("decay", F.lit(0.0)))
    both = both.withColumn("g", g).withColumn("m", F.zip_with("m", "g", lambda m, x: BETA1 * m + (1 - BETA1) * x)).withColumn("v", F.zip_with("v", "g", lambda v, x: BETA2 * v + (1 - BETA2) * x * x))
    step = F.zip_with("m", "v", _adam(rate, 1 - BETA1**number, 1 - BETA2**number))
    return both.select("node", F.zip_with("vec", step, lambda x, s: x - s).alias("vec"), "m", "v")


def bpr_loss(vectors: DataFrame, drawn: DataFrame) -> float:
    """The mean of -log sigmoid(score difference) over triples (u, p, n) of nodes."""
    three = drawn
    for c in "upn":
        three = three.join(vectors.select(F.col("node").alias(c), F.col("vec").alias(f"v{c}")), c)
    gap = dot("vu", "vp") - dot("vu", "vn")
    return float(three.agg(F.avg(F.log1p(F.exp(-F.abs(gap))) + F.greatest(-gap, F.lit(0.0)))).first()[0] or 0.0)


def factors_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User and item factors for ranking."""
    side = lambda c, key: vectors.where(F.col("node").startswith(c)).select(F.expr("substring(node, 2)").cast("long").alias(key), "vec")
    return side("u", "userid"), side("i", "itemid")
