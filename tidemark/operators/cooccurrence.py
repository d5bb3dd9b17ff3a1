"""Items liked by the same users, and their shifted positive pointwise mutual information."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: A history longer than this is cut into blocks of about this length, whose pairs are rows and tasks of their own.
BLOCK = 2048
#: Pairs that a task is given to count at a time; pairs that meet the values of their items in one part.
PAIRS_A_TASK, PAIRS_A_PART = 1 << 20, 1 << 22


def met(left: DataFrame, right: DataFrame, block: int | None = None, tasks: int | None = None) -> DataFrame:
    """left and right joined by userid, a user's pairs being dealt by blocks of both sides, so that no task has to make all pairs
    of a heavy user. Of a user with b blocks a row is copied b times; others are copied nowhere. The join goes to so many tasks."""
    block = block or BLOCK
    heavy = right.groupBy("userid").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select("userid", F.ceil(F.col("_n") / block).cast("int").alias("_parts"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        rest = [c for c in side.columns if c != "userid"]
        parts = F.coalesce("_parts", F.lit(1))
        numbered = side.join(heavy, "userid", "left").select(*side.columns, F.pmod(F.xxhash64(*rest), parts).cast("int").alias(own), parts.alias("_parts"))
        return numbered.select(*side.columns, own, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias(other))

    sides = dealt(left, "_l", "_r"), dealt(right, "_r", "_l")
    if tasks is not None:
        sides = tuple(x.repartition(tasks, "userid", "_l", "_r") for x in sides)
    return sides[0].join(sides[1], ["userid", "_l", "_r"]).drop("_l", "_r")


def pair_count(likes: DataFrame) -> int:
    """How many pairs i < j there are to make."""
    n = F.col("count")
    return int(likes.groupBy("userid").count().agg(F.sum(n * (n - 1) / 2)).first()[0] or 0)


def _pairs(likes: DataFrame) -> tuple[int, int]:
    """How many pairs there are to make, and tasks to make them."""
    pairs = pair_count(likes)
    return pairs, max(likes.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_A_TASK))


def half_counts(likes: DataFrame, *known: str) -> DataFrame:
    """(i, j, n, and each known column of i as NAME_i and of j as NAME_j) for i < j: users who like both.

    known are columns of likes that depend on the item alone, which spares joins of the pairs. Tasks get PAIRS_A_TASK pairs
    each, so that their number grows with the pairs and what one holds does not."""
    _, tasks = _pairs(likes)
    left, right = (likes.select("userid", F.col("itemid").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in known)) for k in "ij")
    own = [f"{c}_{k}" for k in "ij" for c in known]
    return met(left, right, tasks=tasks).where("i < j").groupBy("i", "j", *own).agg(F.count("*").alias("n"))


def directed_counts(left: DataFrame, right: DataFrame, tasks: int, *known: str) -> DataFrame:
    """(i, j, n, and each known column of left): users who like both, for the items i of left (userid, itemid, known) and j of right."""
    own = left.select("userid", F.col("itemid").alias("i"), *known)
    return met(own, right.select("userid", F.col("itemid").alias("j")), tasks=tasks).where("i <> j").groupBy("i", "j", *known).agg(F.count("*").alias("n"))


def counts(likes: DataFrame) -> DataFrame:
    """(i, j, n): users who like both, in both directions; no item with itself."""
    return _both(half_counts(likes), "n")


def _both(half: DataFrame, value: str) -> DataFrame:
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return half.select(F.explode(both).alias("p"), value).select("p.i", "p.j", value)


@dataclass(frozen=True)
class Parts:
    """Pairs (part, i, j, n) for i < j that are dealt by blocks of both items, so that one shuffle counts them and brings them to the
    values of their items: of these every part gets its two blocks, not a copy a pair."""

    pairs: DataFrame
    blocks: int

    @staticmethod
    def of(likes: DataFrame) -> Parts:
        n, tasks = _pairs(likes)
        blocks = math.ceil(math.sqrt(max(likes.sparkSession.sparkContext.defaultParallelism, n / PAIRS_A_PART)))
        left, right = (likes.select("userid", F.col("itemid").alias(k)) for k in "ij")
        made = Parts(met(left, right, tasks=tasks).where("i < j").select("i", "j"), blocks)
        return Parts(made.dealt(made.pairs).groupBy("part", "i", "j").agg(F.count("*").alias("n")), blocks)

    def _block(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")

    def dealt(self, pairs: DataFrame) -> DataFrame:
        part = self._block("i") * self.blocks + self._block("j")
        return pairs.withColumn("part", part).repartition(self.blocks**2, "part")

    def meet(self, pairs: DataFrame, items: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """work(pairs of a part, values of its items) for each part. The first column of items is the item."""
        every, own = F.sequence(F.lit(0), F.lit(self.blocks - 1)), self._block(items.columns[0])
        parts = F.array_union(F.transform(every, lambda x: own * self.blocks + x), F.transform(every, lambda x: x * self.blocks + own))
        copied = items.select("*", F.explode(parts).alias("part")).repartition(self.blocks**2, "part")
        return pairs.groupBy("part").cogroup(copied.groupBy("part")).applyInArrow(work, schema)


def frequencies(likes: DataFrame) -> tuple[DataFrame, int]:
    """(itemid, f: pairs of other likes that the item is met by), written, and the sum of f."""
    f = likes.groupBy("userid").count().select("userid", (F.col("count") - 1).alias("others"))
    f = written(likes.join(f, "userid").groupBy("itemid").agg(F.sum("others").alias("f")), "frequencies")
    return f, f.agg(F.sum("f")).first()[0] or 0


def sppmi_of(likes: DataFrame, negatives: float = 1.0) -> DataFrame:
    """sppmi(counts(likes), negatives) of distinct likes, with pairs made once: f of an item adds up what else its users like."""
    f, total = frequencies(likes)
    half = half_counts(likes.join(f, "itemid"), "f")
    return _both(half.select("i", "j", _pmi("n", "f_i", "f_j", total, negatives).alias("value")).where("value > 0"), "value")


def _pmi(n: str, f: str, g: str, total: float, negatives: float) -> Column:
    return F.log(F.col(n) * F.lit(float(total)) / (F.col(f).cast("double") * F.col(g))) - F.lit(math.log(negatives) if negatives > 1 else 0.0)


def sppmi(c: DataFrame, negatives: float = 1.0) -> DataFrame:
    """(i, j, value) with ln(n N / (f_i f_j)) - ln(negatives) over 0."""
    f = c.groupBy("i").agg(F.sum("n").alias("f"))
    total = c.agg(F.sum("n")).first()[0] or 0
    out = c.join(f, "i").join(f.select(F.col("i").alias("j"), F.col("f").alias("g")), "j")
    return out.select("i", "j", _pmi("n", "f", "g", total, negatives).alias("value")).where("value > 0")
