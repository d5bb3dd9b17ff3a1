"""Lists from a short head of a common order."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking


@pytest.mark.parametrize("profile", [None, "profile"])
def test_users_and_head_are_not_sorted(spark, monkeypatch, profile):
    score = {(p, i): float((i * 7 + p) % 5) for p in (0, 1) for i in range(30)}
    seen = {(u, (u * 3 + n * n) % 30) for u in range(11) for n in range(u)}
    scores = spark.createDataFrame([(p, i, s) for (p, i), s in score.items()], "profile long, itemid long, score double")
    users = spark.createDataFrame([(u, u % 2 if profile else 0) for u in range(11)], "userid long, profile long")
    if not profile:
        scores, users = scores.where("profile = 0").drop("profile"), users.select("userid")
    observed = spark.createDataFrame(sorted(seen), "userid long, itemid long")
    top = ranking.top_popular(scores, users, observed, 4, profile)
    assert "Window" not in top._jdf.queryExecution().executedPlan().toString()
    want = {}
    for u in range(11):
        p = u % 2 if profile else 0
        want[u] = sorted((-score[p, i], i) for i in range(30) if (u, i) not in seen)[:4]
    got = {u: [(-r.score, r.itemid) for r in sorted(top.where(F.col("userid") == u).collect(), key=lambda r: r["rank"])] for u in range(11)}
    assert got == want
    monkeypatch.setattr(ranking, "HEAD", 0)  # by ranges
    long = ranking.top_popular(scores, users, observed, 4, profile)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, top.collect()))
