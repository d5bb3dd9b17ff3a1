"""Groups that overlap, users without a history, named groups."""

import pytest

from tidemark.operators import feedback, ranking, split

CELLS = "userid long, itemid long, y double"


def four(spark):
    y = spark.createDataFrame([(u, i, float(i + 1)) for u in range(1, 4) for i in range(u)], CELLS)
    target = spark.createDataFrame([(u, 5, 5.0) for u in range(4)], CELLS)
    users = spark.range(4).withColumnRenamed("id", "userid")
    return y, target, users


def test_users_without_a_history_have_a_group(spark):
    y, target, users = four(spark)
    members = feedback.activity_members(y, "seen", users)
    assert {r.userid: r.grp for r in members.collect()} == {0: "interaction_0", 1: "interaction_1", 2: "interaction_2", 3: "interaction_3_plus"}
    assert {r.userid for r in feedback.activity_members(y, "seen").collect()} == {1, 2, 3}
    assert {r.userid: r.grp for r in feedback.activity_members(y, "liked", users).collect()} == dict.fromkeys(range(4), "interaction_0")
    with pytest.raises(ValueError):
        feedback.activity_members(y, "rated")
    every, goal = ranking.eligible(y, target, members=members)
    items = spark.range(6).withColumnRenamed("id", "itemid")
    top = ranking.top_popular(items.selectExpr("itemid", "itemid AS score"), every.select("userid").distinct(), feedback.seen(y), 1)
    groups = (feedback.ZERO, *feedback.GROUPS)
    got = {r.grp: (r.ndcg, r.n_users) for r in ranking.ndcg(top, every, goal, ranking.list_sizes(users, items, feedback.seen(y)), (1,), groups).collect()}
    assert got == {"all": (1.0, 4)} | dict.fromkeys(groups, (1.0, 1))


def test_a_user_in_two_groups_counts_in_both_and_once_in_all(spark):
    y, target, users = four(spark)
    members = feedback.named_members(users, {"a": users.where("userid < 3"), "b": users.where("userid > 1").union(users), "c": users.where("userid > 9")})
    every, goal = ranking.eligible(y, target, members=members)
    top = spark.createDataFrame([(u, 5 if u != 2 else 4, 1.0, 1) for u in range(4)], "userid long, itemid long, score double, rank int")
    sizes = users.selectExpr("userid", "6L AS n_ranked")
    got = {r.grp: (round(r.ndcg, 6), r.n_users) for r in ranking.ndcg(top, every, goal, sizes, (1,), ("a", "b", "c")).collect()}
    assert got == {"all": (0.75, 4), "a": (round(2 / 3, 6), 3), "b": (0.75, 4), "c": (0.0, 0)}
    for bad in ({}, {"all": users}, {"x": users.selectExpr("userid + 1 AS userid")}):
        with pytest.raises(ValueError):
            feedback.named_members(users, bad)


def test_padded_users_stay_and_unknown_items_go(spark):
    fit = spark.createDataFrame([(1, 10, 4.0), (2, 11, 5.0)], "userid long, itemid long, rating double")
    ahead = spark.createDataFrame([(1, 11, 5.0), (3, 10, 5.0), (4, 10, 4.0), (3, 99, 5.0)], "userid long, itemid long, rating double")
    y, target = split.fit_and_eval(fit, ahead, cold_start="pad")
    assert sorted((r.userid, r.itemid) for r in target.collect()) == [(1, 11), (3, 10), (4, 10)]
    members = feedback.activity_members(y, "seen", y.select("userid").union(target.select("userid")))
    users, goal = ranking.eligible(y, target, members=members)
    assert {r.userid: r.grp for r in users.collect()} == {1: "interaction_1", 3: "interaction_0", 4: "interaction_0"} and goal.count() == 3
