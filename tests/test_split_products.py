"""Pairs of heavy users are dealt to many tasks."""

from pyspark.sql import functions as F

from tidemark.operators import cooccurrence, rules


def heavy(spark, n=1200):
    rows = [(0, i) for i in range(n)] + [(u, (u * 7 + k) % 50) for u in range(1, 40) for k in range(4)]
    return spark.createDataFrame(rows, "userid long, itemid long")


def test_one_heavy_user_spreads_over_tasks(spark, monkeypatch):
    likes = heavy(spark)
    left, right = likes.withColumnRenamed("itemid", "i"), likes.withColumnRenamed("itemid", "j")
    for setting, value in (("spark.sql.shuffle.partitions", "16"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(setting, value)
    try:
        sizes = {}
        for block in (100, 1 << 20):
            each = cooccurrence.met(left, right, block).groupBy(F.spark_partition_id().alias("task")).count().collect()
            sizes[block] = sorted(r["count"] for r in each)
    finally:
        for setting in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(setting)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total = 1200 * 1200 + 39 * 16
    assert sum(sizes[100]) == sum(sizes[1 << 20]) == total
    assert sizes[1 << 20][-1] > 0.99 * total and sizes[100][-1] < 0.2 * total


def test_counts_and_rules_are_the_same(spark, monkeypatch):
    likes = heavy(spark, 60)
    y = likes.withColumn("y", F.lit(5.0))
    t = rules.tokens(y)
    found = []
    for block in (2048, 7):
        monkeypatch.setattr(cooccurrence, "BLOCK", block)
        found.append((sorted(map(tuple, cooccurrence.counts(likes).collect())), sorted(map(tuple, rules.pairs(t).collect()))))
    assert found[0] == found[1] and len(found[0][0]) >= 60 * 59


def test_rare_tokens_are_dropped_before_they_are_paired(spark):
    y = heavy(spark, 60).withColumn("y", F.lit(5.0))
    t = rules.tokens(y)
    users = y.select("userid").distinct().count()
    kept = rules.frequent(t, rules.token_counts(t), users, 0.1)
    assert 0 < kept.count() < t.count()
    every = [tuple(r) for r in rules.rules(y, t).collect() if r.support >= 0.1]
    assert sorted(map(tuple, rules.rules(y, t, 0.1).collect())) == sorted(every) and every
