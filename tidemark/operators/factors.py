"""Weighted matrix factorisation by alternating least squares: plain, with a signal, with item co-occurrence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .cooccurrence import Parts, frequencies, sppmi_of
from .feedback import LIKED, liked
from .positions import codes

if TYPE_CHECKING:
    from .rules import Signal

#: Users and items of a group and of a block; best items that a group keeps for its users.
USER_BLOCK, ITEM_BLOCK, KEPT = 1 << 16, 1 << 12, 1 << 20
#: What is added to the seed for items and for contexts.
ITEM_STREAM, CONTEXT_STREAM = 104_729, 209_759


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists_of(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (rows.shape[1] if rows.ndim > 1 else 0), pa.int32()), pa.array(rows.ravel(), pa.float64()))


def initial(keys: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """(key, vec): normal factors of deviation 0.01, each row's drawn from its own key, so that partitions do not matter."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.random.default_rng([seed, abs(k)]).normal(0, 0.01, size) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), lists_of(np.array(rows).reshape(-1, size))], names=[key, "vec"])

    return keys.select(F.col(key).cast("long").alias(key)).distinct().mapInArrow(draw, f"{key} long, vec array<double>")


def gram(vectors: DataFrame, vec: str = "vec") -> np.ndarray:
    """The sum of v v' over all rows: tasks add their own, Spark adds the cells of these, the driver gets one small matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = vectors_of(b.column(0))
                total = m.T @ m + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists_of(total.reshape(1, -1))], names=["g"])

    cells = vectors.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(partial, "g array<double>").select(F.posexplode("g"))
    found = np.array([r.g for r in cells.groupBy("pos").agg(F.sum("col").alias("g")).orderBy("pos").collect()])
    return found.reshape(int(np.sqrt(len(found))), -1) if len(found) else np.zeros((0, 0))


def _sums(keys: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, both = keys[order], both[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[at], np.add.reduceat(both, at, axis=0)


def least_squares(parts: DataFrame, size: int, base: np.ndarray, sums: DataFrame | None = None) -> DataFrame:
    """(row, vec) solving (base + sum w v v') x = sum r v over the parts (row, w, r, vec) of each row.

    sums (row, s) are such totals made elsewhere, as equation_sums() gives them.
    """
    return _equations(parts, size, base, sums)


def equation_sums(parts: DataFrame, size: int) -> DataFrame:
    """(row, s): the size * size cells of sum w v v', then sum r v, over the parts (row, w, r, vec) of each row."""
    return _equations(parts, size, None, None)


def _equations(parts: DataFrame, size: int, base: np.ndarray | None, sums: DataFrame | None) -> DataFrame:
    """A row with many parts in a task is added up there before the shuffle, so no row brings more than about size records a
    task to its solver; the parts of other rows, shorter than a total, go as they are."""
    width = size * size + size
    step = max(64, (1 << 22) // width)

    def totals(w: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.concatenate([(v[:, :, None] * v[:, None, :]).reshape(len(v), size * size) * w[:, None], v * r[:, None]], axis=1)

    def record(rows: np.ndarray, w: np.ndarray, r: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(w, pa.float64()), pa.array(r, pa.float64()), lists_of(v)], names=["row", "w", "r", "vec"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, w, r = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v = vectors_of(b.column(3))
            _, which, count = np.unique(rows, return_inverse=True, return_counts=True)
            many = np.flatnonzero(count[which] > size)
            one = np.flatnonzero(count[which] <= size)
            if len(one):
                yield record(rows[one], w[one], r[one], v[one])
            many = many[np.argsort(rows[many], kind="stable")]
            for at in range(0, len(many), step):
                some = many[at : at + step]
                keys, added = _sums(rows[some], totals(w[some], r[some], v[some]))
                yield record(keys, np.zeros(len(keys)), np.zeros(len(keys)), added)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(keys: np.ndarray, added: np.ndarray) -> pa.RecordBatch:
            if base is None:
                return pa.RecordBatch.from_arrays([pa.array(keys), lists_of(added)], names=["row", "s"])
            left = added[:, : size * size].reshape(-1, size, size) + base
            return pa.RecordBatch.from_arrays([pa.array(keys), lists_of(np.linalg.solve(left, added[:, size * size :, None])[:, :, 0])], names=["row", "vec"])

        keys, held = np.zeros(0, np.int64), np.zeros((0, width))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                rows, w, r = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                lengths = np.diff(b.column(3).offsets.to_numpy())
                flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(lengths))
                plain = lengths == size
                got = np.zeros((len(rows), width))
                at_plain, at_sum = (ends[:-1][m][:, None] + np.arange(n) for m, n in ((plain, size), (~plain, width)))
                got[plain] = totals(w[plain], r[plain], flat[at_plain])
                got[~plain] = flat[at_sum]
                keys, held = _sums(np.concatenate([keys, rows]), np.concatenate([held, got]))
                if len(keys) > step:  # rows come in order: all but the last are complete
                    yield solved(keys[:-1], held[:-1])
                    keys, held = keys[-1:], held[-1:]
        if len(keys):
            yield solved(keys, held)

    kind = "row long, w double, r double, vec array<double>"
    added = parts.select(F.col("row").cast("long").alias("row"), F.col("w").cast("double").alias("w"), F.col("r").cast("double").alias("r"), "vec").mapInArrow(partial, kind)
    if sums is not None:
        added = added.unionByName(sums.select("row", F.lit(0.0).alias("w"), F.lit(0.0).alias("r"), F.col("s").alias("vec")))
    return added.repartition("row").sortWithinPartitions("row").mapInArrow(final, f"row long, {'s' if base is None else 'vec'} array<double>")


def _parts(cells: DataFrame, row: str, col: str, fixed: DataFrame, w: Column, r: Column) -> DataFrame:
    return cells.join(fixed.withColumnRenamed(fixed.columns[0], col), col).select(F.col(row).alias("row"), w.alias("w"), r.alias("r"), "vec")


def _every(keys: DataFrame, key: str, size: int) -> DataFrame:
    """Empty parts of all keys: rows without any other get zero factors."""
    return keys.select(F.col(key).alias("row"), F.lit(0.0).alias("w"), F.lit(0.0).alias("r"), F.array(*(F.lit(0.0) for _ in range(size))).alias("vec"))


def _half(parts: DataFrame, keys: DataFrame, key: str, size: int, base: np.ndarray, sums: DataFrame | None = None) -> DataFrame:
    """(key, vec) of all keys, as a table."""
    found = least_squares(parts.unionByName(_every(keys, key, size)), size, base, sums)
    return written(found.withColumnRenamed("row", key), "factors")


def report_due(sweep: int, every: int | None) -> bool:
    """Whether losses are reported after this sweep, counted from 1: after the first and every so many."""
    return every is not None and (sweep == 1 or sweep % every == 0)


def checked_schedule(sweeps: int, every: int | None) -> None:
    for name, value in (("sweeps", sweeps), ("report_every", every)):
        if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value <= 0):
            raise ValueError(f"{name} must be a positive whole number")


def squares(*tables: DataFrame) -> float:
    """The sum of all squared cells of factor tables."""
    return float(sum((t.agg(F.sum(dot("vec", "vec"))).first()[0] or 0.0) for t in tables))


def _signal_sums(signal: Signal, base: DataFrame, key: str, fixed: DataFrame, size: int, gamma: float) -> DataFrame:
    """What the shared part of a signal adds to the equations of users or items (key): all cells of profiles as if none were
    blocked, from one total a profile."""
    square = size * size
    weighed = lambda by: F.transform("s_all", lambda x, i: F.when(i < square, gamma * x).otherwise(gamma * by * x)).alias("s")
    if key == "userid":
        parts = base.join(fixed, "itemid").select(F.col("profile").alias("row"), F.lit(1.0).alias("w"), F.col("s").alias("r"), "vec")
        totals = equation_sums(parts, size).select(F.col("row").alias("profile"), F.col("s").alias("s_all"))
        return signal.users.join(F.broadcast(totals), "profile").select(F.col("userid").alias("row"), weighed(F.col("scale")))
    parts = signal.users.join(fixed, "userid").select(F.col("profile").alias("row"), F.lit(1.0).alias("w"), F.col("scale").alias("r"), "vec")
    totals = equation_sums(parts, size).select(F.col("row").alias("profile"), F.col("s").alias("s_all"))
    return base.join(F.broadcast(totals), "profile").select(F.col("itemid").alias("row"), weighed(F.col("s")))


def fit_wmf(y: DataFrame, size: int = 8, rate: float = 0.1, alpha: float = 10.0, sweeps: int = 10, seed: int = 42, threshold: float = LIKED, signal: Signal | None = None, gamma: float = 0.0, fit_users: DataFrame | None = None, report_every: int | None = None, report: Callable[[dict], None] | None = None, in_tasks: bool = False) -> tuple[DataFrame, DataFrame]:
    """User and item factors. Liked cells weigh 1 + alpha with target 1, all others 1 with target 0; a signal adds its cells with
    weight gamma and their value as target. A sweep is two shuffles of the liked cells and of the signal's own cells; what
    users share of the signal is added profile by profile.

    With fit_users (userid) only these move the items' factors; the other users of y are then folded in, items staying as
    they are. report gets the losses over the fitting users after the first sweep and every report_every. With in_tasks all sweeps
    are one job of barrier tasks (als.fit()), without fit_users and reports.
    """
    checked_schedule(sweeps, report_every)
    if in_tasks:
        from . import als

        if fit_users is not None or report is not None:
            raise ValueError("barrier tasks neither fold in nor report")
        return als.fit(y, size, rate, alpha, sweeps, seed, threshold, signal, gamma)
    likes = written(liked(y, threshold), "likes")
    users, items = (written(y.select(F.col(c).cast("long").alias(c)).distinct(), c) for c in ("userid", "itemid"))
    signal = signal if gamma > 0 else None
    delta = written(signal.delta(), "delta") if signal is not None else None
    own = users
    if fit_users is not None:
        own = written(users.join(fit_users.select("userid"), "userid", "left_semi"), "fit-users")
        if own.isEmpty():
            raise ValueError("fit_users must hold a user of y")
    only = lambda df, who: df if who is None else df.join(who, "userid", "left_semi")
    chosen = own if fit_users is not None else None
    q = written(initial(items, "itemid", size, seed + ITEM_STREAM), "factors")
    p = q

    def half(key: str, keys: DataFrame, fixed: DataFrame, who: DataFrame | None) -> DataFrame:
        other = "itemid" if key == "userid" else "userid"
        parts, sums = _parts(only(likes, who), key, other, fixed, F.lit(alpha), F.lit(1 + alpha)), None
        if signal is not None:
            parts = parts.unionByName(_parts(only(delta, who), key, other, fixed, gamma * F.col("w"), gamma * F.col("r")))
            some = signal if who is None else signal.of(who)
            sums = _signal_sums(some, signal.base, key, fixed, size, gamma)
            if key == "itemid":
                sums = sums.join(items.select(F.col("itemid").alias("row")), "row", "left_semi")
        return _half(parts, keys, key, size, gram(fixed) + rate * np.eye(size), sums)

    for sweep in range(1, sweeps + 1):
        p = half("userid", own, q, chosen)
        q = half("itemid", items, p, chosen)
        if report is not None and report_due(sweep, report_every):
            loss = {"sweep": sweep, "wmf": wmf_loss(only(likes, chosen), p, q, alpha), "signal": signal_loss(signal if chosen is None else signal.of(chosen), p, q, gamma) if signal is not None else 0.0, "l2": squares(p, q)}
            report(loss | {"total": loss["wmf"] + loss["signal"] + rate * loss["l2"]})
    if fit_users is not None:
        rest = users.join(own, "userid", "left_anti")
        p = p.unionByName(half("userid", rest, q, rest))
    return p, q


def fit_coded(y: DataFrame, fit: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """fit() over feedback with ids of any type: it gets their dense numbers, its factors get the ids back."""
    numbers = {c: written(codes(y, c, "_idx"), "codes") for c in ("userid", "itemid")}
    coded = y
    for c, table in numbers.items():
        coded = coded.join(table, c).drop(c).withColumnRenamed("_idx", c)
    return tuple(f.join(numbers[c].select(F.col(c).alias("_id"), F.col("_idx").alias(c)), c).select(F.col("_id").alias(c), "vec") for f, c in zip(fit(coded), numbers, strict=True))


def fold_in(cells: DataFrame, items: DataFrame, size: int, rate: float, alpha: float) -> DataFrame:
    """Factors of users from their liked cells alone, the items' factors staying as they are."""
    return least_squares(_parts(cells, "userid", "itemid", items, F.lit(alpha), F.lit(1 + alpha)), size, gram(items) + rate * np.eye(size)).withColumnRenamed("row", "userid")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda acc, x: acc + x)


def residuals(m: DataFrame, q: DataFrame, z: DataFrame) -> DataFrame:
    """(i, j, value, score): the co-occurrence cells with their factor products."""
    return m.join(q.select(F.col("itemid").alias("i"), F.col("vec").alias("_q")), "i").join(z.select(F.col("itemid").alias("j"), F.col("vec").alias("_z")), "j").select("i", "j", "value", dot("_q", "_z").alias("score"))


def item_bias(cells: DataFrame, other: DataFrame, g: float, by: str, against: str) -> DataFrame:
    """(by, bias): the mean of value - score - the other side's bias - g."""
    return cells.join(other.select(F.col(other.columns[0]).alias(against), F.col("bias").alias("_o")), against, "left").groupBy(by).agg(F.avg(F.col("value") - F.col("score") - F.coalesce("_o", F.lit(0.0)) - g).alias("bias"))


def global_bias(cells: DataFrame, b: DataFrame, d: DataFrame) -> float:
    left = cells.join(b.select("i", F.col("bias").alias("_b")), "i", "left").join(d.select("j", F.col("bias").alias("_d")), "j", "left")
    return left.agg(F.avg(F.col("value") - F.col("score") - F.coalesce("_b", F.lit(0.0)) - F.coalesce("_d", F.lit(0.0)))).first()[0] or 0.0


def _places(ids: np.ndarray, pairs: pa.Table) -> list[np.ndarray]:
    return [np.searchsorted(ids, pairs.column(c).to_numpy()) for c in "ij"]


def _columns(items: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """The items of a part, sorted, with their values."""
    ids = items.column(0).to_numpy()
    order = np.argsort(ids)
    return ids[order], items.take(pa.array(order))


def biases(likes: DataFrame, q: DataFrame, z: DataFrame, g: float, negatives: float = 1.0, contexts: bool = True) -> tuple[DataFrame, DataFrame | None, float | None]:
    """Item biases (i, bias), context biases (j, bias) and the global bias of residuals(sppmi_of(likes, negatives), q, z), as
    item_bias() and global_bias() give them in this order from g; without contexts the first alone.

    Cells go once to parts of two blocks of items, which have factors and frequencies of these; a part gives one row of sums an
    item. The biases of contexts take the cells, kept as pairs of ids, once more to the same parts, where they meet those of items.
    """
    f, total = frequencies(likes)
    parts, shift = Parts.of(likes), math.log(negatives) if negatives > 1 else 0.0
    of = lambda t, name: t.select(F.col(t.columns[0]).cast("long").alias("id"), F.col("vec").alias(name))
    items = f.select(F.col("itemid").cast("long").alias("id"), F.col("f").cast("double").alias("f")).join(of(q, "q"), "id").join(of(z, "z"), "id")
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("s", pa.float64()), ("c", pa.float64())])

    def first(pairs: pa.Table, own: pa.Table) -> pa.Table:
        ids, own = _columns(own)
        freq, (q_, z_) = own.column("f").to_numpy(), (vectors_of(own.column(c).combine_chunks()) for c in "qz")
        n, s, c = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        out = []
        for lo in range(0, pairs.num_rows, 1 << 17):
            some = pairs.slice(lo, 1 << 17)
            i, j = _places(ids, some)
            value = np.log(some.column("n").to_numpy() * float(total) / (freq[i] * freq[j])) - shift
            here = np.flatnonzero(value > 0)
            i, j, value = i[here], j[here], value[here]
            for a, b in ((i, j), (j, i)):
                left = value - (q_[a] * z_[b]).sum(axis=1)
                n += np.bincount(a, minlength=len(ids))
                s += np.bincount(a, left, len(ids))
                c += np.bincount(b, left, len(ids))
            if contexts:
                no = pa.nulls(len(i), pa.float64())
                out.append(pa.Table.from_arrays([pa.array(np.zeros(len(i), np.int32)), pa.array(ids[i]), pa.array(ids[j]), pa.nulls(len(i), pa.int64()), no, no], schema=schema))
        met = np.flatnonzero(n)
        out.append(pa.Table.from_arrays([pa.array(np.ones(len(met), np.int32)), pa.array(ids[met]), pa.nulls(len(met), pa.int64()), pa.array(n[met]), pa.array(s[met]), pa.array(c[met])], schema=schema))
        return pa.concat_tables(out)

    found = parts.meet(parts.pairs, items, first, "kind int, a long, b long, n long, s double, c double")
    if contexts:
        found = written(found, "cells")
    sums = found.where("kind = 1").groupBy(F.col("a").alias("i")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    biased = written(sums.withColumn("bias", F.col("s") / F.col("n") - g), "bias")
    b = biased.select("i", "bias")
    if not contexts:
        return b, None, None

    def second(pairs: pa.Table, own: pa.Table) -> pa.Table:
        ids, own = _columns(own)
        bias, t = own.column("bias").to_numpy(), np.zeros(len(ids))
        for lo in range(0, pairs.num_rows, 1 << 20):
            i, j = _places(ids, pairs.slice(lo, 1 << 20))
            t += np.bincount(i, bias[j], len(ids)) + np.bincount(j, bias[i], len(ids))
        return pa.table({"j": ids, "t": t})

    cells = parts.dealt(found.where("kind = 0").select(F.col("a").alias("i"), F.col("b").alias("j")))
    near = parts.meet(cells, b, second, "j long, t double").groupBy("j").agg(F.sum("t").alias("t"))
    d = written(near.join(biased.withColumnRenamed("i", "j"), "j").select("j", "n", ((F.col("c") - F.col("t")) / F.col("n") - g).alias("bias")), "bias")
    n, left = biased.agg(F.sum("n"), F.sum(F.col("s") - F.col("n") * F.col("bias"))).first()
    taken = d.agg(F.sum(F.col("n") * F.col("bias"))).first()[0]
    return b, d.select("j", "bias"), (left - taken) / n if n else 0.0


def fit_cofactor(y: DataFrame, size: int = 8, rate: float = 0.1, alpha: float = 10.0, gamma: float = 1.0, context_rate: float | None = None, negatives: float = 1.0, sweeps: int = 10, seed: int = 42, threshold: float = LIKED, report_every: int | None = None, report: Callable[[dict], None] | None = None, in_tasks: bool = False) -> tuple[DataFrame, DataFrame]:
    """As fit_wmf(), item factors also reproducing shifted PMI with context factors and biases; updates in the order users,
    items, contexts, item biases, context biases, global bias, each from the latest values."""
    checked_schedule(sweeps, report_every)
    if in_tasks:
        from . import als

        if report is not None:
            raise ValueError("barrier tasks do not report")
        return als.fit(y, size, rate, alpha, sweeps, seed, threshold, None, gamma, context_rate, negatives)
    likes = written(liked(y, threshold), "likes")
    users, items = (written(y.select(F.col(c).cast("long").alias(c)).distinct(), c) for c in ("userid", "itemid"))
    m = written(sppmi_of(likes, negatives), "sppmi")
    q, z = (written(initial(items, "itemid", size, seed + s), "factors") for s in (ITEM_STREAM, CONTEXT_STREAM))
    zero = items.withColumn("bias", F.lit(0.0))
    b, d, g = zero.withColumnRenamed("itemid", "i"), zero.withColumnRenamed("itemid", "j"), 0.0
    eye = np.eye(size)
    p = q
    for sweep in range(1, sweeps + 1):
        p = _half(_parts(likes, "userid", "itemid", q, F.lit(alpha), F.lit(1 + alpha)), users, "userid", size, gram(q) + rate * eye)
        biased = m.join(b.withColumnRenamed("bias", "_b"), "i", "left").join(d.withColumnRenamed("bias", "_d"), "j", "left").select("i", "j", (F.col("value") - F.coalesce("_b", F.lit(0.0)) - F.coalesce("_d", F.lit(0.0)) - g).alias("t"))
        parts = _parts(likes, "itemid", "userid", p, F.lit(alpha), F.lit(1 + alpha)).unionByName(_parts(biased, "i", "j", z, F.lit(gamma), gamma * F.col("t")))
        q = _half(parts, items, "itemid", size, gram(p) + rate * eye)
        z = _half(_parts(biased, "j", "i", q, F.lit(gamma), gamma * F.col("t")), items, "itemid", size, (gamma * rate if context_rate is None else context_rate) * eye)
        cells = written(residuals(m, q, z), "residuals")
        b = written(item_bias(cells, d, g, "i", "j"), "bias")
        d = written(item_bias(cells, b, g, "j", "i"), "bias")
        g = global_bias(cells, b, d)
        if report is not None and report_due(sweep, report_every):
            report({"sweep": sweep, "wmf": wmf_loss(likes, p, q, alpha), "cooccurrence": cooccurrence_loss(cells, b, d, g, gamma), "l2": squares(p, q), "context_l2": squares(z)})
    return p, q


def cooccurrence_loss(cells: DataFrame, b: DataFrame, d: DataFrame, g: float, gamma: float) -> float:
    """gamma times the squared errors of the co-occurrence cells (i, j, value, score), biases included."""
    left = cells.join(b.select("i", F.col("bias").alias("_b")), "i", "left").join(d.select("j", F.col("bias").alias("_d")), "j", "left")
    error = F.col("value") - F.col("score") - F.coalesce("_b", F.lit(0.0)) - F.coalesce("_d", F.lit(0.0)) - g
    return gamma * float(left.agg(F.sum(error * error)).first()[0] or 0.0)


def wmf_loss(likes: DataFrame, p: DataFrame, q: DataFrame, alpha: float) -> float:
    """The weighted squared error over all cells: the Gram product for targets 0, corrected at the liked cells."""
    cells = likes.join(p.withColumnRenamed("vec", "_p"), "userid").join(q.withColumnRenamed("vec", "_q"), "itemid").select(dot("_p", "_q").alias("s"))
    liked_part = cells.agg(F.sum((1 + alpha) * (1 - F.col("s")) * (1 - F.col("s")) - F.col("s") * F.col("s"))).first()[0] or 0.0
    return float((gram(p) * gram(q)).sum() + liked_part)


def score_user(p: DataFrame, q: DataFrame, userid) -> DataFrame:
    """(itemid, score) of all items for one user; a user without factors raises IndexError."""
    own = p.where(F.col("userid") == userid)
    if own.isEmpty():
        raise IndexError(f"no factors of user {userid}")
    return q.crossJoin(F.broadcast(own.select(F.col("vec").alias("_p")))).select("itemid", dot("_p", "vec").alias("score"))  # one user


def signal_loss(signal: Signal, p: DataFrame, q: DataFrame, gamma: float) -> float:
    """gamma times the squared errors over the cells of a signal: over all cells of profiles from one total a profile, corrected
    at each user's own cells and at those that are blocked."""
    size = len((q.first() or {"vec": []})["vec"])
    parts = signal.base.join(q, "itemid").select(F.col("profile").alias("row"), F.lit(1.0).alias("w"), F.col("s").alias("r"), "vec")
    sums = equation_sums(parts, size).withColumnRenamed("row", "profile")
    more = signal.base.groupBy("profile").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, s = vectors_of(batch.column(0)), vectors_of(batch.column(1))
                scale, ss = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                left = s[:, : size * size].reshape(-1, size, size)
                loss = scale * scale * ss - 2 * scale * (v * s[:, size * size :]).sum(axis=1) + np.einsum("ni,nij,nj->n", v, left, v)
                yield pa.RecordBatch.from_arrays([pa.array([loss.sum()])], names=["loss"])

    shared = signal.users.join(p, "userid").join(F.broadcast(sums), "profile").join(F.broadcast(more), "profile").select("vec", "s", "scale", "ss").mapInArrow(errors, "loss double")
    d = signal.corrections().join(p.withColumnRenamed("vec", "_p"), "userid").join(q.withColumnRenamed("vec", "_q"), "itemid").withColumn("x", dot("_p", "_q"))
    squared = lambda c: (F.col(c) - F.col("x")) * (F.col(c) - F.col("x"))
    rest = d.agg(F.sum(F.coalesce(squared("own"), F.lit(0.0)) - F.coalesce(squared("shared"), F.lit(0.0)))).first()[0] or 0.0
    return gamma * float((shared.agg(F.sum("loss")).first()[0] or 0.0) + rest)


def _by_length(items: DataFrame, blocks: int) -> DataFrame:
    """(itemid, vec, b): blocks b by falling length, written. Items between two quantiles of the lengths that are more than a block,
    as equal lengths can be, are dealt to several blocks by hash."""
    measured = items.withColumn("length", F.sqrt(dot("vec", "vec")))
    cuts = measured.agg(F.percentile_approx("length", [i / blocks for i in range(1, blocks)], 10_000)).first()[0]
    bounds = np.unique(cuts)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = len(bounds) - np.searchsorted(bounds, b.column(2).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(r.astype(np.int32))], names=["itemid", "vec", "r"])

    ranged = written(measured.select("itemid", "vec", "length").mapInArrow(longer, "itemid long, vec array<double>, r int"), "lengths")
    counts, first, starts, parts = dict(ranged.groupBy("r").count().collect()), 0, [], []  # a row a block
    for r in range(max(counts) + 1):
        parts.append(max(1, -(-counts.get(r, 0) // ITEM_BLOCK)))
        starts.append(first)
        first += parts[-1]
    part = F.pmod(F.xxhash64("itemid"), F.get(F.array(*map(F.lit, parts)), F.col("r")))
    return ranged.select("itemid", "vec", (F.get(F.array(*map(F.lit, starts)), F.col("r")) + part).cast("int").alias("b"))


def products(u: np.ndarray, i: np.ndarray) -> np.ndarray:
    return u @ i.T


def same(reach: np.ndarray) -> np.ndarray:
    return reach


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In single precision, in which large ones are equal."""
    return (1 / (1 + np.exp(-x))).astype(np.float32)


def sigmoids(u: np.ndarray, i: np.ndarray) -> np.ndarray:
    return sigmoid(u @ i.T)


class Best:
    """The k best items so far of users whose factors are rows, by score; kept are (user, item, score), user being a row's number, in
    the order of users, falling scores and ids. score and limit are those of top_scored()."""

    def __init__(self, rows: np.ndarray, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: Callable[[np.ndarray], np.ndarray] | None = None):
        self.rows, self.k, self.score, self.limit = rows, k, score, limit
        self.lengths = np.sqrt((rows * rows).sum(axis=1))
        self.kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def _firsts(self, user: np.ndarray, item: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((item, -score, user))
        user, item, score = user[order], item[order], score[order]
        return [x[self._places(user) < self.k] for x in (user, item, score)]

    @staticmethod
    def _places(user: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(np.diff(user, prepend=-1))
        return np.arange(len(user)) - np.repeat(start, np.diff(start, append=len(user)))

    def open(self, longest: float) -> tuple[np.ndarray, np.ndarray]:
        """The users whose best an item of this length can still be among, and the k-th score of each user so far."""
        left, kth = np.arange(len(self.rows)), np.full(len(self.rows), -np.inf)
        n_kept = np.bincount(self.kept[0], minlength=len(self.rows))
        full = np.flatnonzero(n_kept == self.k)
        kth[full] = self.kept[2][np.cumsum(n_kept)[full] - 1]
        if self.limit is not None:
            left = np.flatnonzero(kth <= self.limit(longest * self.lengths * (1 + 1e-9) + 1e-12))  # an equal score may have a smaller id
        return left, kth

    def add(self, ids: np.ndarray, v: np.ndarray, gone_user: np.ndarray, gone_item: np.ndarray) -> bool:
        """Takes a block of items, ids in order, without the pairs that are gone (places among users and ids); whether any was scored."""
        left, kth = self.open(np.sqrt((v * v).sum(axis=1).max()))
        if not len(left):
            return False
        some = max(1, (1 << 22) // len(ids))
        number = np.full(len(self.rows), -1)
        number[left] = np.arange(len(left))
        gone_user, gone_item = number[gone_user], gone_item[number[gone_user] >= 0]
        gone_user = gone_user[gone_user >= 0]
        more = []
        for at in range(0, len(left), some):
            scores = self.score(self.rows[left[at : at + some]], v).astype(np.float64, copy=False)
            here = (gone_user >= at) & (gone_user < at + some)
            scores[gone_user[here] - at, gone_item[here]] = -np.inf
            cut = kth[left[at : at + some]]
            # where more than k pass the k-th score so far, those of this block are cut first
            many = np.flatnonzero(np.count_nonzero(scores >= cut[:, None], axis=1) > self.k)
            if len(many):
                cut[many] = np.maximum(cut[many], np.partition(scores[many], -self.k, axis=1)[:, -self.k])
            u, i = np.divmod(np.flatnonzero(scores >= cut[:, None]), len(ids))
            gone = scores[u, i] == -np.inf
            more.append(self._firsts(left[u[~gone] + at], ids[i[~gone]], scores[u[~gone], i[~gone]]))
        self.kept = self._firsts(*(np.concatenate(x) for x in zip(self.kept, *more, strict=True)))
        return True

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(user, item, score, rank), ranks from 1."""
        return *self.kept, self._places(self.kept[0]) + 1


def top_factors(p: DataFrame, q: DataFrame, seen: DataFrame, k: int, blocks_scored: Accumulator | None = None) -> DataFrame:
    """(userid, itemid, score, rank): each user's k best unseen items by inner product, ties to smaller ids."""
    return top_scored(p, q, seen, k, products, same, blocks_scored)


def top_scored(p: DataFrame, q: DataFrame, seen: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: Callable[[np.ndarray], np.ndarray] | None = None, blocks_scored: Accumulator | None = None) -> DataFrame:
    """(userid, itemid, score, rank): each user's k best unseen items by score(rows of users, rows of items), which gives a matrix;
    ties to smaller ids.

    Users are dealt to groups of about USER_BLOCK, fewer where k is large, items to blocks of about ITEM_BLOCK. Every group reads
    the users, then block by block what they have seen there and the items, all in order from one shuffle, and holds the k best so
    far: memory is bounded by the two blocks, and nothing goes through the driver but counts and quantiles. The items are copied
    once a group, so there are no more groups than these sizes ask for and than run at once.

    limit gives the most that a score can be from the product of the two rows' lengths, and must not fall where that grows. With it
    items come by falling length, so that a user whose k-th score beats the limit of a block needs no block from there on, and a
    group none once that holds for all its users. blocks_scored counts blocks that a group did score.
    """
    spark = p.sparkSession
    n_users, n_items = p.count(), q.count()
    groups = max(1, -(-n_users // max(1, min(USER_BLOCK, KEPT // k))), min(spark.sparkContext.defaultParallelism, n_users))
    blocks = max(1, -(-n_items // ITEM_BLOCK))
    group = F.pmod(F.xxhash64("userid"), F.lit(groups)).cast("int").alias("g")
    placed = q.select(F.col("itemid").cast("long").alias("itemid"), "vec")
    own = seen.join(p.select("userid"), "userid", "left_semi").select("userid", F.col("itemid").cast("long").alias("itemid"))
    if limit is None or blocks == 1:
        block = F.pmod(F.xxhash64("itemid"), F.lit(blocks)).cast("int").alias("b")
        placed, own = placed.select("itemid", "vec", block), own.select("userid", "itemid", block)
    else:
        placed = _by_length(placed, blocks)
        own = own.join(placed.select("itemid", "b"), "itemid").select("userid", "itemid", "b")
    none = F.array().cast("array<double>").alias("vec")
    users = p.select(group, F.lit(-1).alias("b"), F.lit(0).alias("kind"), F.col("userid").cast("long").alias("userid"), F.lit(0).cast("long").alias("itemid"), "vec")
    hidden = own.select(group, "b", F.lit(1).alias("kind"), F.col("userid").cast("long").alias("userid"), "itemid", none)
    items = placed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "b", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("userid"), "itemid", "vec")
    rows = users.unionByName(hidden).unionByName(items).repartition(groups, "g").sortWithinPartitions("g", "b", "kind", "userid", "itemid")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = np.zeros(0, np.int64), None
        held: dict[int, list] = {0: [], 1: [], 2: []}

        def joined(kind: int) -> tuple[np.ndarray, np.ndarray, list]:
            got = held[kind]
            return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), [x[2] for x in got]

        def block_done() -> None:
            nonlocal own, found
            if held[0]:
                own, _, v = joined(0)
                found = Best(np.concatenate(v), k, score, limit)
            if held[2] and found is not None:
                _, ids, v = joined(2)
                gone_user, gone_item = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if held[1]:
                    asked, item, _ = joined(1)
                    at = np.minimum(np.searchsorted(ids, item), len(ids) - 1)
                    known = ids[at] == item  # what is seen but has no factors is no candidate
                    gone_user, gone_item = np.searchsorted(own, asked[known]), at[known]
                if found.add(ids, np.concatenate(v), gone_user, gone_item) and blocks_scored is not None:
                    blocks_scored.add(1)
            for rows_ in held.values():
                rows_.clear()

        def group_done() -> pa.RecordBatch:
            nonlocal own, found
            block_done()
            user, item, score_, rank = found.ranked() if found is not None else (np.zeros(0, np.int64),) * 4
            out = pa.RecordBatch.from_arrays([pa.array(own[user]), pa.array(item), pa.array(score_, pa.float64()), pa.array(rank.astype(np.int32))], names=["userid", "itemid", "score", "rank"])
            own, found = np.zeros(0, np.int64), None
            return out

        now = None
        for batch in batches:
            g, b, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = np.flatnonzero((np.diff(g, prepend=g[:1]) != 0) | (np.diff(b, prepend=b[:1]) != 0) | (np.diff(kind, prepend=kind[:1]) != 0))
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(g)], strict=True):
                if lo == hi:
                    continue
                if now is not None and now != (g[lo], b[lo]):
                    if now[0] != g[lo]:
                        yield group_done()
                    else:
                        block_done()
                now = (g[lo], b[lo])
                part = batch.slice(lo, hi - lo)
                held[int(kind[lo])].append((part.column(3).to_numpy(), part.column(4).to_numpy(), vectors_of(part.column(5)) if kind[lo] != 1 else None))
        if now is not None:
            yield group_done()

    return rows.mapInArrow(best, "userid long, itemid long, score double, rank int")
