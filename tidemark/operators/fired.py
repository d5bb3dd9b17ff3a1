"""A signal whose cells are made user by user in tasks, used there and never kept.

The rules of each liked item are packed once: sorted items by their gaps, confidences by their place among the distinct ones, some
3 bytes a rule. Users of one profile are dealt to groups, which read the base of their profile, then user by user what is seen and
the packed rules of what is liked. What leaves a task is a row a user or the k best items. Lists are made for a share of the liked
items at a time, and groups take theirs in waves, so that what is shuffled at a time is a part of the whole.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import left_to_caller, passing, written
from .cooccurrence import pair_count
from .rules import KINDS, NORMALISERS

#: Rules in a piece at most; rules that a task adds up at a time; users of a group at most and at least.
PIECE, TOGETHER, GROUP, LEAST = 1 << 14, 1 << 21, 1 << 16, 1 << 10
#: Pairs of items, in both directions, that lists are made of at a time; bytes of lists that a wave of groups takes; shares and waves at most.
SHARE, SHIPPED, WAVES = 1 << 22, 1 << 27, 16
_HEAD = struct.Struct("<qIIBB")
_ROWS = "g long, stage int, userid long, kind int, itemid long, part binary"
BASE, HEAD, OWN = range(3)
USER, SEEN, RULES, GOAL = range(4)
_SIZES = {t().itemsize: t for t in (np.uint8, np.uint16, np.uint32, np.uint64)}


def pack(items: np.ndarray, values: np.ndarray) -> bytes:
    """Rising items with a value each."""
    gaps = np.diff(items).view(np.uint64)
    known, code = np.unique(values, return_inverse=True)
    kind, code_kind = (next(t for t in _SIZES.values() if most <= np.iinfo(t).max) for most in (int(gaps.max(initial=0)), len(known) - 1))
    return _HEAD.pack(int(items[0]), len(items), len(known), np.dtype(kind).itemsize, np.dtype(code_kind).itemsize) + known.tobytes() + gaps.astype(kind).tobytes() + code.astype(code_kind).tobytes()


def unpack(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, n, n_known, gap, code = _HEAD.unpack_from(part)
    at = _HEAD.size + 8 * n_known
    items = np.empty(n, np.int64)
    items[0] = first
    items[1:] = np.frombuffer(part, _SIZES[gap], n - 1, at)
    known = np.frombuffer(part, np.float64, n_known, _HEAD.size)
    return np.cumsum(items), known[np.frombuffer(part, _SIZES[code], n, at + gap * (n - 1))]


def packed(rows: DataFrame) -> DataFrame:
    """(key, part) of rows (key, itemid, value): pieces of each key's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, item, value = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.diff(key, prepend=key[0]) != 0)
            cuts = np.union1d(np.append(starts, 0), np.arange(0, len(key), PIECE))
            parts = [pack(item[lo:hi], value[lo:hi]) for lo, hi in zip(cuts, np.append(cuts[1:], len(key)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key[cuts]), pa.array(parts, pa.binary())], names=["key", "part"])

    key, item, value = rows.columns
    typed = rows.select(F.col(key).cast("long").alias("key"), F.col(item).cast("long").alias("itemid"), F.col(value).cast("double").alias("value"))
    return typed.repartition("key").sortWithinPartitions("key", "itemid").mapInArrow(run, "key long, part binary")


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero; values are not negative."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


@dataclass(frozen=True)
class Fired:
    """rules.signal(t, found, observed, kinds) for ids that are numbers (see positions.codes()), with rules.Signal's results.

    t (userid, kind, token), found (kind, token, itemid, confidence), observed (userid, itemid). A task holds the base of one profile,
    at most the catalogue, and the rules of some users; of one user at most its distinct items beside TOGETHER rules. item_rules makes
    found's rules of liked items for one share of these, as rules.item_rules() does; without it they are looked up in found.
    """

    t: DataFrame
    found: DataFrame
    observed: DataFrame
    kinds: tuple[str, ...] = KINDS
    how: str | None = None
    item_rules: Callable[[int, int], DataFrame] | None = None

    def normalised(self, how: str = "row_max") -> Fired:
        """Over each user's highest value, after log1p for log_row_max."""
        if how not in NORMALISERS:
            raise ValueError(how)
        return replace(self, how=how)

    def digest(self) -> DataFrame:
        """(userid, n, total, top, last_item) of each user with a signal."""
        users = self.t.where(F.col("kind").isin(*self.kinds)).select("userid").distinct()
        return self._made(users, None, None, _Task(self.how), "userid long, n long, total double, top double, last_item long")

    def top(self, users: DataFrame, items: DataFrame, k: int, digits: int = 9, goal: DataFrame | None = None) -> DataFrame:
        """(userid, itemid, score, rank): the k best by rounded value, then items without one in order. With goal (userid, itemid)
        of these only those in goal, with the rank that they have among all."""
        ids = users.select("userid").distinct()
        longest = self.observed.join(ids, "userid", "left_semi").groupBy("userid").count().agg(F.max("count")).first()[0] or 0
        head = items.select(F.col("itemid").cast("long").alias("itemid")).distinct().orderBy("itemid").limit(longest + 2 * k)
        return self._made(ids, head, goal, _Task(self.how, k, digits, goal is not None), "userid long, itemid long, score double, rank int")

    def _lists(self) -> tuple[DataFrame, int]:
        """(key, part) of the rules of each liked item, and the waves in which groups take them. Few rules are not written."""
        likes = self._likes(self.t)
        share = self.item_rules or (lambda n, of: self.found.where("kind = 'item'").where(F.pmod(F.xxhash64("token"), F.lit(of)) == n).select("token", "itemid", "confidence"))
        shares = min(WAVES, -(-2 * pair_count(likes.withColumnRenamed("key", "itemid")) // SHARE))
        if shares <= 1:
            return packed(share(0, 1)), 1
        lists = functools.reduce(DataFrame.unionByName, [written(packed(share(n, shares)), "lists") for n in range(shares)])
        sizes = lists.groupBy("key").agg(F.sum(F.length("part")).alias("bytes"))
        return lists, max(1, min(WAVES, -(-(likes.join(sizes, "key").agg(F.sum("bytes")).first()[0] or 0) // SHIPPED)))

    @staticmethod
    def _likes(t: DataFrame) -> DataFrame:
        return t.where("kind = 'item'").select("userid", F.col("token").cast("long").alias("key"))

    def _made(self, users: DataFrame, head: DataFrame | None, goal: DataFrame | None, task: _Task, schema: str) -> DataFrame:
        kept, found = [], []
        with passing(users.sparkSession) as made:
            lists, waves = self._lists() if "item" in self.kinds else (None, 1)
            wave = self._dealt(users, head, goal, lists, waves)
            if waves == 1:  # a later job reads these tables
                found.append(wave(0).mapInArrow(task.run, schema))
                kept += made
                made.clear()
            else:
                for n in range(waves):
                    found.append(written(wave(n).mapInArrow(task.run, schema), "found"))
                    kept.append(made.pop())
        left_to_caller(kept)
        return functools.reduce(DataFrame.unionByName, found)

    def _dealt(self, users: DataFrame, head: DataFrame | None, goal: DataFrame | None, lists: DataFrame | None, waves: int) -> Callable[[int], DataFrame]:
        """The rows of the n-th wave of groups for their tasks."""
        spark = users.sparkSession
        shared = [k for k in self.kinds if k != "item"]
        t = self.t.join(users, "userid", "left_semi") if head is not None else self.t
        observed = self.observed.join(users, "userid", "left_semi") if head is not None else self.observed
        key = F.array_sort(F.collect_set(F.concat_ws(":", "kind", "token"))).alias("key")
        own = t.where(F.col("kind").isin(shared)).groupBy("userid").agg(key).withColumn("profile", F.xxhash64("key"))
        profiles = written(users.join(own, "userid", "left").select("userid", F.coalesce("profile", F.lit(0)).alias("profile"), "key"), "profiles")
        n, parallel = profiles.count(), spark.sparkContext.defaultParallelism
        size = max(LEAST, min(GROUP, -(-n // (3 * parallel * waves))))
        # groups are numbered profile by profile: a row for each set of clusters
        parts = profiles.groupBy("profile").agg(F.first("key", ignorenulls=True).alias("key"), F.ceil(F.count("*") / size).alias("parts"))
        first = F.coalesce(F.sum("parts").over(Window.orderBy("profile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = written(parts.withColumn("first", first), "groups")
        groups = parts.agg(F.sum("parts")).first()[0] or 1
        place = profiles.drop("key").join(F.broadcast(parts), "profile").select("userid", (F.col("first") + F.pmod(F.xxhash64("userid"), F.col("parts"))).cast("long").alias("g"))
        every = written(place, "places")

        def row(df: DataFrame, stage: int, kind: int, **c: Column) -> DataFrame:
            return df.select("g", F.lit(stage).alias("stage"), c.get("userid", F.lit(0)).cast("long").alias("userid"), F.lit(kind).alias("kind"), c.get("itemid", F.lit(None)).cast("long").alias("itemid"), c.get("part", F.lit(None)).cast("binary").alias("part"))

        if shared:
            keys = parts.select("profile", F.explode("key").alias("key"))
            fired = self.found.where(F.col("kind").isin(shared)).withColumn("key", F.concat_ws(":", "kind", "token")).join(F.broadcast(keys), "key")
            base = packed(fired.groupBy("profile", "itemid").agg(F.sum("confidence").alias("s"))).withColumnRenamed("key", "profile")
            base = written(base, "base") if waves > 1 else base

        def wave(n: int) -> DataFrame:
            mine = lambda df: df.where(F.pmod("g", F.lit(waves)) == n)
            place = mine(every)
            rows = row(place, OWN, USER, userid=F.col("userid")).unionByName(row(observed.join(place, "userid"), OWN, SEEN, userid=F.col("userid"), itemid=F.col("itemid")))
            each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("g")
            if shared:
                rows = rows.unionByName(row(mine(base.join(F.broadcast(parts.select("profile", "first", "parts")), "profile").select(each, "part")), BASE, RULES, part=F.col("part")))
            if head is not None:
                rows = rows.unionByName(row(mine(parts.select(each)).crossJoin(head), HEAD, SEEN, itemid=F.col("itemid")))  # longest history and 2 k rows a group
            if goal is not None:
                rows = rows.unionByName(row(goal.join(place, "userid"), OWN, GOAL, userid=F.col("userid"), itemid=F.col("itemid")))
            if lists is not None:
                rows = rows.unionByName(row(self._likes(t).join(place, "userid").join(lists, "key"), OWN, RULES, userid=F.col("userid"), part=F.col("part")))
            some = -(-groups // waves)
            tasks = min(some, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * parallel, -(-some // 4)))
            own = rows.withColumn("owner", F.pmod(F.floor(F.col("g") / waves), F.lit(tasks)).cast("int")).repartitionById(tasks, "owner").select(*(c.split()[0] for c in _ROWS.split(", ")))
            return own.sortWithinPartitions("g", "stage", "userid", "kind", "itemid")

        return wave


def _places(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values stand among sorted ones, and whether they do."""
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return at, among[at] == values if len(among) else np.zeros(len(values), bool)


class _Base:
    """The base of a profile: sorted items with their values, by a table where items are dense."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray]], task: _Task):
        items, s = (np.concatenate([p[i] for p in pieces]) if pieces else np.zeros(0, np.int64 if i == 0 else np.float64) for i in range(2))
        order = np.argsort(items, kind="stable")
        self.items, self.raw = items[order], s[order]
        self.value = task.value(self.raw)
        shown = self.value if task.k is None else rounded(self.value, task.digits)
        self.by_value = np.lexsort((self.items, -shown))
        self.total = self.value.sum()
        self.table = None
        if len(items) and int(self.items[-1]) - int(self.items[0]) < 4 * len(items) + 1024:
            self.table = np.full(int(self.items[-1] - self.items[0]) + 1, -1, np.int32)
            self.table[self.items - self.items[0]] = np.arange(len(items))

    def places(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            return _places(items, self.items)
        at = items - self.items[0]
        inside = (at >= 0) & (at < len(self.table))
        got = self.table[np.where(inside, at, 0)]
        has = inside & (got >= 0)
        return np.where(has, got, 0), has


@dataclass(frozen=True)
class _Task:
    """Rows as in _ROWS in, digests or (with k) the k best items out, with goals only those that are one."""

    how: str | None
    k: int | None = None
    digits: int = 9
    goals: bool = False

    def value(self, s: np.ndarray) -> np.ndarray:
        return np.log1p(s) if self.how == "log_row_max" else s

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = base = None
        pieces, heads = [], []
        state = _State()
        for batch in batches:
            if not batch.num_rows:
                continue
            g, stage, user, kind, item = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in range(5))
            edges = np.flatnonzero((np.diff(g, prepend=g[:1]) != 0) | (np.diff(stage, prepend=stage[:1]) != 0)).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(g)], strict=True):
                if now != g[lo]:
                    if now is not None:
                        yield self.out(state.all(), base or _Base(pieces, self), heads)
                    now, base, pieces, heads, state = g[lo], None, [], [], _State()
                if stage[lo] == BASE:
                    pieces.extend(unpack(p) for p in batch.column(5).slice(lo, hi - lo).to_pylist())
                elif stage[lo] == HEAD:
                    heads.append(item[lo:hi])
                else:
                    base = base or _Base(pieces, self)
                    state.users.append(user[lo:hi][kind[lo:hi] == USER])
                    own = kind[lo:hi] == SEEN
                    state.seen.append((user[lo:hi][own], item[lo:hi][own]))
                    own = kind[lo:hi] == GOAL
                    state.goals.append((user[lo:hi][own], item[lo:hi][own]))
                    for at in (lo + np.flatnonzero(kind[lo:hi] == RULES)).tolist():
                        items, s = unpack(batch.column(5)[at].as_py())
                        state.rules.append((np.full(len(items), user[at]), items, s))
                        state.n += len(items)
                        if state.n > TOGETHER:
                            # rows come user by user: all but this one are complete
                            done, state = state.parted(user[at])
                            if len(done[0]):
                                yield self.out(done, base, heads)
        if now is not None:
            yield self.out(state.all(), base or _Base(pieces, self), heads)

    def out(self, some: tuple, base: _Base, heads: list[np.ndarray]) -> pa.RecordBatch:
        users, (seen_user, seen_item), (user, item, own), goals = some
        who, seen_who = np.searchsorted(users, user), np.searchsorted(users, seen_user)
        coded = _coder(len(users), item, seen_item, base.items, *heads)
        seen_key = np.sort(coded(seen_who, seen_item))
        left = ~_places(coded(who, item), seen_key)[1]
        who, item, own = who[left], item[left], own[left]
        at, shared = base.places(item)
        value = own.copy()
        value[shared] += base.raw[at[shared]]
        value = self.value(value)
        if self.k is None:
            return self.digest(users, seen_who, seen_item, seen_key, coded, who, item, value, at, shared, base)
        found = self.best(users, np.bincount(seen_who, minlength=len(users)), seen_key, coded, who, item, value, base, heads)
        return found.filter(pa.array(_among(found, *goals))) if self.goals else found

    def digest(self, users, seen_who, seen_item, seen_key, coded, who, item, value, at, shared, base) -> pa.RecordBatch:
        n_users = len(users)
        count = lambda x, w=None: np.bincount(x, w, n_users)
        gone_at, gone = base.places(seen_item)
        n = len(base.items) - count(seen_who[gone]) + count(who[~shared])
        total = base.total - count(seen_who[gone], base.value[gone_at[gone]]) + count(who, value) - count(who[shared], base.value[at[shared]])
        top, last = np.full(n_users, -np.inf), np.full(n_users, np.iinfo(np.int64).min)
        np.maximum.at(top, who, value)
        np.maximum.at(last, who, item)
        for order, into, what in ((base.by_value, top, base.value), (np.arange(len(base.items))[::-1], last, base.items)):
            # the first of the order that is not seen: most users need one look
            left, place = np.arange(n_users), 0
            while len(left) and place < len(order):
                known = _places(coded(left, np.full(len(left), base.items[order[place]])), seen_key)[1]
                into[left[~known]] = np.maximum(into[left[~known]], what[order[place]])
                left, place = left[known], place + 1
        some = np.flatnonzero(n > 0)
        if self.how is not None:
            total, top = total[some] / top[some], np.ones(len(some))
        else:
            total, top = total[some], top[some]
        return pa.RecordBatch.from_arrays([pa.array(users[some]), pa.array(n[some].astype(np.int64)), pa.array(total), pa.array(top), pa.array(last[some])], names=["userid", "n", "total", "top", "last_item"])

    def best(self, users, n_seen, seen_key, coded, who, item, value, base, heads) -> pa.RecordBatch:
        n_users, k = len(users), self.k
        if self.how is not None:
            value, scale = self.scaled(n_users, seen_key, coded, who, value, base)
        else:
            scale = np.ones(n_users)
        value = rounded(value, self.digits)
        head = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        found = []
        own = _firsts(who, item, value, k)
        step = max(1, TOGETHER // (k + int(n_seen.max(initial=0)) + 1))
        for lo in range(0, n_users, step):
            hi = min(n_users, lo + step)
            a, b = np.searchsorted(own[0], (lo, hi))
            mine = [x[a:b] for x in own]
            # as many of the base as could be seen and k more
            far = np.minimum(k + n_seen[lo:hi], len(base.items))
            u, place = _ranges(lo, far)
            some = base.by_value[place]
            both = [mine, self.unseen(u, base.items[some], rounded(scale[u] * base.value[some], self.digits), seen_key, coded)]
            kept = _distinct(*(np.concatenate(x) for x in zip(*both, strict=True)), coded)
            kept = _firsts(*kept, k)
            short = np.flatnonzero(np.bincount(kept[0] - lo, minlength=hi - lo) < k) + lo
            if len(short):
                far = np.minimum(2 * k + n_seen[short], len(head))
                u, place = _ranges(0, far)
                u = short[u]
                fill = self.unseen(u, head[place], np.zeros(len(u)), seen_key, coded)
                kept = _firsts(*_distinct(*(np.concatenate(x) for x in zip(kept, fill, strict=True)), coded), k)
            found.append(kept)
        u, item, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64 if i < 2 else np.float64) for i in range(3))
        start = np.flatnonzero(np.diff(u, prepend=-1))
        rank = np.arange(len(u)) - np.repeat(start, np.diff(start, append=len(u))) + 1
        return pa.RecordBatch.from_arrays([pa.array(users[u]), pa.array(item), pa.array(score), pa.array(rank.astype(np.int32))], names=["userid", "itemid", "score", "rank"])

    def scaled(self, n_users, seen_key, coded, who, value, base) -> tuple[np.ndarray, np.ndarray]:
        top = np.full(n_users, -np.inf)
        np.maximum.at(top, who, value)
        left, place = np.arange(n_users), 0
        order = np.lexsort((base.items, -base.value))
        while len(left) and place < len(order):
            known = _places(coded(left, np.full(len(left), base.items[order[place]])), seen_key)[1]
            top[left[~known]] = np.maximum(top[left[~known]], base.value[order[place]])
            left, place = left[known], place + 1
        scale = np.where(np.isfinite(top), 1 / np.where(np.isfinite(top), top, 1), 1.0)
        return value / np.where(np.isfinite(top), top, 1)[who], scale

    @staticmethod
    def unseen(u, item, score, seen_key, coded) -> list[np.ndarray]:
        left = ~_places(coded(u, item), seen_key)[1]
        return [u[left], item[left], score[left]]


def _among(found: pa.RecordBatch, user: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which rows (userid, itemid, ...) are among these pairs."""
    users, items = (found.column(c).to_numpy() for c in ("userid", "itemid"))
    known = np.unique(np.concatenate([users, user]))
    coded = _coder(len(known), items, item)
    return np.isin(coded(np.searchsorted(known, users), items), coded(np.searchsorted(known, user), item))


def _ranges(first: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows first, first + 1, ... with 0 .. length - 1 each."""
    return np.repeat(np.arange(first, first + len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _distinct(u, item, score, coded) -> list[np.ndarray]:
    """One row for each user and item, with the highest score."""
    order = np.lexsort((-score, coded(u, item)))
    key = coded(u, item)[order]
    first = order[np.diff(key, prepend=key[:1] - 1) != 0]
    return [u[first], item[first], score[first]]


def _firsts(u, item, score, k: int) -> list[np.ndarray]:
    """Each user's k best, ties to smaller items."""
    order = np.lexsort((item, -score, u))
    u, item, score = u[order], item[order], score[order]
    start = np.flatnonzero(np.diff(u, prepend=-1))
    kept = np.arange(len(u)) - np.repeat(start, np.diff(start, append=len(u))) < k
    return [u[kept], item[kept], score[kept]]


def _coder(n_users: int, *items: np.ndarray):
    """A number for (row of user, item) that rises with both."""
    some = [x for x in items if len(x)]
    low, high = (min(int(x.min()) for x in some), max(int(x.max()) for x in some)) if some else (0, 0)
    span = high - low + 1
    if n_users * span < 1 << 62:
        return lambda u, x: u * span + (x - low)
    known = np.unique(np.concatenate(some))
    return lambda u, x: u * len(known) + np.searchsorted(known, x)


class _State:
    """What a task has of users whose rows are not all read."""

    def __init__(self):
        self.users, self.seen, self.rules, self.goals, self.n = [], [], [], [], 0

    def all(self) -> tuple:
        none = np.zeros(0, np.int64)
        users = np.unique(np.concatenate([none, *self.users]))
        seen, goals = ([np.concatenate([none, *(x[i] for x in pairs)]) for i in range(2)] for pairs in (self.seen, self.goals))
        user, item, s = (np.concatenate([none.astype(k), *(x[i] for x in self.rules)]) for i, k in enumerate((np.int64, np.int64, np.float64)))
        if len(user):
            key = _coder(len(users), item)(np.searchsorted(users, user), item)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1) != 0)
            user, item, s = user[order[first]], item[order[first]], np.add.reduceat(s[order], first)
        self.users, self.seen, self.rules, self.goals = [users], [tuple(seen)], [(user, item, s)], [tuple(goals)]
        return users, tuple(seen), (user, item, s), tuple(goals)

    def parted(self, last: int) -> tuple[tuple, _State]:
        """The users before the last, and a state with the last alone."""
        users, (seen_user, seen_item), (user, item, s), (goal_user, goal_item) = self.all()
        rest = _State()
        a, b, c, d = users < last, seen_user < last, user < last, goal_user < last
        rest.users, rest.seen, rest.rules, rest.goals = [users[~a]], [(seen_user[~b], seen_item[~b])], [(user[~c], item[~c], s[~c])], [(goal_user[~d], goal_item[~d])]
        # a user with more distinct items than that is added up once for each further TOGETHER rules
        return (users[a], (seen_user[b], seen_item[b]), (user[c], item[c], s[c]), (goal_user[d], goal_item[d])), rest
