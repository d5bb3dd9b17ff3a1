"""Pairs of items are made once, by as many tasks as there are pairs for."""

from tidemark.operators import cooccurrence, rules


def likes(spark):
    return spark.createDataFrame([(u, i) for u in range(12) for i in range(9) if (u * i + u) % 4 < 2], "userid long, itemid long")


def rows(df):
    return sorted((*(r[:2]), round(r[2], 12)) for r in df.select("i", "j", "value").collect())


def test_frequencies_come_without_pairs(spark):
    own = likes(spark)
    for negatives in (1.0, 1.1):
        want = rows(cooccurrence.sppmi(cooccurrence.counts(own), negatives))
        assert want and rows(cooccurrence.sppmi_of(own, negatives)) == want
    assert cooccurrence.sppmi_of(own.where("false")).count() == 0


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    own = likes(spark)
    want = sorted(map(tuple, cooccurrence.counts(own).collect()))
    monkeypatch.setattr(cooccurrence, "PAIRS_A_TASK", 10)
    got = cooccurrence.half_counts(own)
    assert "hashpartitioning" in (plan := got._jdf.queryExecution().executedPlan().toString())
    n = sum(k * (k - 1) // 2 for k in (r["count"] for r in own.groupBy("userid").count().collect()))
    assert f", {-(-n // 10)})" in plan.replace(", REPARTITION_BY_NUM", "")
    assert sorted(map(tuple, cooccurrence.counts(own).collect())) == want


def test_rules_join_no_pairs(spark):
    y = likes(spark).selectExpr("userid", "itemid", "5.0D AS y")
    t = rules.tokens(y)
    joined = rules.pairs(t).join(rules.token_counts(t).withColumnRenamed("n", "n_token"), ["kind", "token"])
    want = sorted((r.kind, r.token, r.itemid, r.n, r.n / r.n_token) for r in joined.collect())
    assert sorted((r.kind, r.token, r.itemid, r.n, r.confidence) for r in rules.rules(y, t).collect()) == want
