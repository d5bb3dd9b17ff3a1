"""A ranking copies the items once a group: groups follow the users and what runs at once, not the session's shuffle partitions."""

import numpy as np
import pytest

from tidemark.operators import factors


@pytest.mark.parametrize(("block", "kept", "groups"), [(1 << 16, 1 << 20, 4), (8, 1 << 20, 5), (1 << 16, 30, 7)])
def test_items_are_copied_for_few_groups(spark, monkeypatch, block, kept, groups):
    monkeypatch.setattr(factors, "USER_BLOCK", block)
    monkeypatch.setattr(factors, "KEPT", kept)
    rng = np.random.default_rng(4)
    # several blocks, many equal scores, some better ones late: more than k pass a user's k-th score in one block
    monkeypatch.setattr(factors, "ITEM_BLOCK", 20)
    u, i = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (130, 3)).astype(float)
    p = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "userid long, vec array<double>")
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(i)], "itemid long, vec array<double>")
    seen = {(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 200), rng.integers(0, 130, 200), strict=True)}
    own = spark.createDataFrame(sorted(seen), "userid long, itemid long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for limit in (None, factors.same):
            top = factors.top_scored(p, q, own, 5, factors.products, limit)
            assert top.rdd.getNumPartitions() == groups
            got = sorted((r.userid, r["rank"], r.itemid, r.score) for r in top.collect())
            want = [(a, n + 1, x, s[x]) for a, s in enumerate(u @ i.T) for n, x in enumerate(sorted((x for x in range(130) if (a, x) not in seen), key=lambda x: (-s[x], x))[:5])]
            assert got == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
