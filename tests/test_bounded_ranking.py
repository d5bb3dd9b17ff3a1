"""Rankings by inner product that stop at bounds against plain ones."""

import numpy as np
import pytest

from tidemark.operators import factors


@pytest.mark.parametrize("kind", ["falling", "equal", "zero"])
def test_bounds_spare_blocks_and_no_row(spark, monkeypatch, kind):
    monkeypatch.setattr(factors, "USER_BLOCK", 8)
    monkeypatch.setattr(factors, "ITEM_BLOCK", 10)
    rng = np.random.default_rng(2)
    u, i = rng.normal(size=(30, 4)), rng.normal(size=(200, 4))
    i *= {"falling": 0.97 ** np.arange(200), "equal": 1 / np.sqrt((i * i).sum(axis=1)), "zero": (np.arange(200) < 3).astype(float)}[kind][:, None]
    i[7] = i[9]
    u[3] = 0
    seen = {(int(a), int(b)) for a, b in zip(rng.integers(0, 30, 300), rng.integers(0, 220, 300), strict=True)}
    p = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "userid long, vec array<double>")
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(i)], "itemid long, vec array<double>")
    s = spark.createDataFrame(sorted(seen), "userid long, itemid long")
    count = spark.sparkContext.accumulator(0)
    got = sorted((r.userid, r["rank"], r.itemid, round(r.score, 9)) for r in factors.top_factors(p, q, s, 5, count).collect())
    want = []
    for k, scores in enumerate(u @ i.T):
        best = sorted((x for x in range(200) if (k, x) not in seen), key=lambda x: (-scores[x], x))[:5]
        want += [(k, n + 1, x, round(scores[x], 9)) for n, x in enumerate(best)]
    assert [x[3] for x in got] == [x[3] for x in sorted(want)] and [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    if kind == "falling":
        assert [x[2] for x in got] == [x[2] for x in sorted(want)]
        groups = 4  # shuffle partitions of the tests; 30 users in groups of 8
        with_zero = 20  # one group holds the user whose scores are all equal: nothing is spared there
        assert 0 < count.value <= with_zero + (groups - 1) * 12
    none = factors.top_scored(p, q, s, 5, factors.products)
    assert sorted((r.userid, r["rank"], round(r.score, 9)) for r in none.collect()) == [(x[0], x[1], x[3]) for x in got]
