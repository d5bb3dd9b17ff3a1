"""Places in an order over all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written


def before(df: DataFrame, key: str, weight: str | None = None, into: str = "before") -> DataFrame:
    """df with the sum of weight (1 without) over all rows with a smaller key; keys are unique numbers or times.

    Quantiles cut the keys into ranges, at most one a shuffle partition; the driver gets the sum of each. The running sum within
    a range is a window over that range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    w = F.col(weight) if weight else F.lit(1)
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<int>")
    ranged = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(key))) if cuts else F.lit(0))
    sums = dict(ranged.groupBy("_range").agg(F.sum(w)).collect())
    total, bases = 0, []
    for i in range(max(sums, default=0) + 1):
        bases.append(total)
        total += sums.get(i) or 0
    base = F.get(F.array(*(F.lit(x).cast("long") for x in bases)), F.col("_range"))
    within = F.coalesce(F.sum(w).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(into, (base + within).cast("long")).drop("_range")


def codes(df: DataFrame, key: str, into: str = "idx") -> DataFrame:
    """(key, idx): dense numbers of the distinct keys in ascending order.

    Text keys are dealt by ranges, sorted and written once: a key's number is the number of keys in the ranges before its own
    and its place in that.
    """
    keys = df.select(key).distinct()
    if dict(keys.dtypes)[key] != "string":
        return before(keys, key, into=into)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(keys.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()), "codes")
    ranged = placed.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id") - F.shiftleft("_range", 33))
    sums = ranged.groupBy("_range").agg(F.count("*").alias("_sum"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    return ranged.join(F.broadcast(base), "_range").select(key, (F.col("_base") + F.col("_at")).cast("long").alias(into))


def numbered(df: DataFrame, by: list[str], order: list[Column], into: str = "at") -> DataFrame:
    """df with each row's place, from 1, among those with the same by in an order without ties.

    Rows are dealt by ranges of by and order, sorted and written once; a row's place is what earlier ranges hold of its by and
    its place within its range. What is added up has a row for each range and each by.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    placed = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "places").withColumn("_range", F.shiftright("_id", 33))
    parts = placed.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("_range", *by, (F.coalesce(earlier, F.lit(0)) + 1 - F.col("_first")).alias("_base"))
    return placed.join(base, ["_range", *by]).select(*df.columns, (F.col("_base") + F.col("_id")).alias(into))
