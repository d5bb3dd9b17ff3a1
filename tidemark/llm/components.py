"""Connected components of a graph whose edges are a table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def connected(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) of the nodes of edges (u, v), component being the least node reachable; and the table's path.

    Each round hangs every node's larger neighbours, then its smaller ones, under the least of them; edges only ever shrink
    towards the least node, so that a logarithm of rounds suffices in practice. Nothing goes to the driver but two sums.
    """
    spark = edges.sparkSession

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now, path = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionAll(now.select("v", "u"))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = large.join(least(large), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        following, at = written(small, "edges")
        got = following.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop(spark, path)
        now, path = following, at
        if tuple(got) == state:
            break
        state = tuple(got)
    out, at = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v")).distinct(), "components")
    drop(spark, path)
    return out, at
