"""Small literal cases of what is easy to get wrong."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cooccurrence, factors, feedback, graph, lightgcn, ranking, rules, sampling, split
from tidemark.operators.positions import before, codes, numbered
from tidemark.sources import interactions as log


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def events(spark, rows):
    return spark.createDataFrame([(u, i, day(t), float(r)) for u, i, t, r in rows], "userid long, itemid long, ts timestamp_ntz, rating double")


def test_read_reviews(spark, tmp_path):
    path = tmp_path / "dump.json"
    path.write_text('{"reviewerID": "u", "asin": "i", "unixReviewTime": 86400, "overall": 5.0, "x": 1}\n\n{"reviewerID": "u", "asin": "i", "unixReviewTime": 0, "overall": "?"}\n{"asin": "j", "unixReviewTime": "soon"}\n')
    raw = log.read_reviews(spark, str(path))
    assert raw.count() == 3
    assert log.complete(raw).collect() == [("u", "i", datetime.datetime(1970, 1, 2), 5.0)]
    assert log.audit(raw).first()[:3] == (3, 2, 0)
    (tmp_path / "none.json").write_text("\n")
    with pytest.raises(ValueError):
        log.read_reviews(spark, str(tmp_path / "none.json"))
    log.write_log(log.complete(raw), str(tmp_path / "log"))
    assert log.read_log(spark, str(tmp_path / "log")).collect() == log.complete(raw).collect()


def test_earliest_then_higher(spark):
    rows = events(spark, [(1, 1, 2, 5), (1, 1, 1, 2), (1, 1, 1, 4), (2, 1, 0, 3)])
    assert sorted((r.userid, r.rating) for r in log.earliest(rows).collect()) == [(1, 4.0), (2, 3.0)]


def test_cells(spark):
    assert log.from_cells(spark, [(1, 1, 2.0), (1, 1, 3.0), (1, 2, 0.0)]).collect() == [(1, 1, 5.0)]
    with pytest.raises(ValueError):
        log.from_cells(spark, [(1, 1, -1.0)])


def test_cuts_snap_to_changes_and_earlier_ties(spark):
    # times 0,0,0,0,1,1,2,3,3,3: changes at 4, 6, 7; targets 7 and floor(10 * 0.7999...) = 7
    rows = events(spark, [(n, n, t, 4) for n, t in enumerate([0, 0, 0, 0, 1, 1, 2, 3, 3, 3])])
    cut = split.cuts(rows).first()
    assert (cut.train_end, cut.val_end) == (6, 7) and cut.train_cut == day(2)
    with pytest.raises(ValueError):
        split.cuts(events(spark, [(1, 1, 0, 4), (1, 2, 1, 4)]))


def test_positions(spark):
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "k long, w long")
    got = {r.k: r.before for r in before(df, "k", "w").collect()}
    total = 0
    for k, w in sorted((k * 7 % 101, k) for k in range(101)):
        assert got[k] == total
        total += w
    text = spark.createDataFrame([("10",), ("9",), ("9",)], "k string")
    assert sorted(codes(text, "k").collect()) == [("10", 0), ("9", 1)]


def test_drops_are_disjoint_and_pad_keeps_users(spark):
    fit = events(spark, [(1, 1, 0, 5), (2, 2, 0, 3)])
    ahead = events(spark, [(1, 2, 1, 5), (1, 9, 1, 5), (8, 9, 1, 4), (8, 1, 1, 2)])
    assert split.drop_stats(fit, ahead).first() == (2, 1, 1, 1)
    assert split.known_events(fit, ahead).count() == 1 and split.known_events(fit, ahead, "pad").count() == 2


def test_ndcg_by_hand(spark):
    y = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (2, 1, 5.0), (2, 3, 4.0), (3, 2, 2.0)], "userid long, itemid long, y double")
    target = spark.createDataFrame([(1, 3, 5.0), (1, 1, 5.0), (2, 2, 4.0), (3, 1, 5.0)], "userid long, itemid long, y double")
    users, goal = ranking.eligible(y, target)
    seen = feedback.seen(y)
    top = ranking.top_popular(feedback.popularity(y), users.select("userid"), seen, 2)
    assert sorted((r.userid, r.itemid, r["rank"]) for r in top.collect()) == [(1, 3, 1), (2, 2, 1)]
    got = {(r.grp, r.cutoff): r for r in ranking.ndcg(top, users, goal, ranking.list_sizes(users.select("userid"), y, seen), (1, 2)).collect()}
    # user 1 has two targets, one seen, but a list of one; user 3 likes nothing
    assert got["all", 2].ndcg == 1.0 and got["all", 2].n_users == 2
    assert got["interaction_1", 1].n_users == 1 and got["interaction_3_plus", 1].ndcg == 0.0


def test_a_long_head_is_numbered_by_ranges(spark, monkeypatch):
    """The same lists from a window and from ranges, with ties, for all users and profile by profile; no window over all rows."""
    scores = spark.range(300).selectExpr("id % 3 AS profile", "id AS itemid", "cast(id % 7 AS double) AS score").repartition(3)
    users = spark.range(9).selectExpr("id AS userid", "id % 3 AS profile")
    seen = spark.range(300).selectExpr("id % 2 AS userid", "id AS itemid").where("userid = 0 or itemid % 5 = 0")
    rows = lambda by: sorted(map(tuple, ranking.top_popular(scores, users, seen, 4, by).collect()))
    want = [rows(None), rows("profile")]
    monkeypatch.setattr(ranking, "HEAD", 0)
    assert [rows(None), rows("profile")] == want
    places = numbered(scores, ["profile"], [F.desc("score"), F.asc("itemid")])
    assert "SinglePartition" not in places._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["at"] for r in places.where("profile = 1").collect()) == list(range(1, 101))


def test_sparse_scores_fall_back_to_item_order(spark):
    items = spark.createDataFrame([(i,) for i in range(10, 20)], "itemid long")
    users = spark.createDataFrame([(1,), (2,)], "userid long")
    seen = spark.createDataFrame([(1, 10), (1, 11)], "userid long, itemid long")
    scores = spark.createDataFrame([(1, 15, 0.5), (1, 14, 0.5), (1, 11, 9.0)], "userid long, itemid long, score double")
    top = ranking.top_sparse(scores, users, items, seen, 4).orderBy("userid", "rank").collect()
    assert [r.itemid for r in top] == [14, 15, 12, 13, 10, 11, 12, 13]


def test_rules_count_observed_users_only(spark):
    y = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 5.0), (2, 3, 5.0), (3, 1, 5.0), (3, 2, 5.0), (4, 3, 1.0)], "userid long, itemid long, y double")
    found = {(r.kind, r.token, r.itemid): r for r in rules.rules(y, rules.tokens(y)).collect()}
    r = found["item", 1, 2]
    assert (r.n, r.support, r.confidence, r.lift) == (2, 2 / 4, 2 / 3, 2 * 4 / (3 * 2))
    assert found["ucl", 0, 1].confidence == 3 / 4 and found["icl", 0, 1].confidence == 1.0
    s = {(r.userid, r.itemid): r.s for r in rules.signal(rules.tokens(y), rules.rules(y, rules.tokens(y)), feedback.seen(y)).collect()}
    assert s[4, 1] == pytest.approx(0.75) and (4, 3) not in s


def test_sppmi_by_hand(spark):
    likes = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 3)], "userid long, itemid long")
    c = cooccurrence.counts(likes)
    assert sorted(c.collect()) == [(1, 2, 2), (1, 3, 1), (2, 1, 2), (3, 1, 1)]
    value = {(r.i, r.j): r.value for r in cooccurrence.sppmi(c).collect()}
    assert value[1, 2] == pytest.approx(np.log(2 * 6 / (3 * 2)))


def test_graph_by_hand(spark):
    likes = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "userid long, itemid long")
    w = {(r.src, r.dst): r.w for r in graph.adjacency(graph.edges(likes)).collect()}
    assert w["u1", "i1"] == pytest.approx(1 / np.sqrt(2)) and w["i2", "u1"] == pytest.approx(0.5) and len(w) == 8


def test_half_step_solves_the_normal_equations(spark):
    fixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "itemid long, vec array<double>")
    cells = spark.createDataFrame([(7, 1)], "userid long, itemid long")
    got = factors.fold_in(cells, fixed, 2, 0.5, 3.0).first()
    assert got.userid == 7 and np.allclose(got.vec, [4 / 4.5, 0])


def test_loss_equals_the_dense_sum(spark):
    rng = np.random.default_rng(0)
    p, q, alpha = rng.normal(size=(3, 2)), rng.normal(size=(4, 2)), 2.5
    liked = [(0, 1), (1, 0), (2, 3), (2, 1)]
    table = lambda m, key: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{key} long, vec array<double>")
    got = factors.wmf_loss(spark.createDataFrame(liked, "userid long, itemid long"), table(p, "userid"), table(q, "itemid"), alpha)
    x, s = np.zeros((3, 4)), p @ q.T
    x[tuple(zip(*liked, strict=True))] = 1
    assert got == pytest.approx((np.where(x > 0, 1 + alpha, 1) * (x - s) ** 2).sum())


def test_fitting_lowers_the_loss_and_top_masks_seen(spark, monkeypatch):
    monkeypatch.setattr(factors, "ITEM_BLOCK", 3)
    rng = np.random.default_rng(1)
    cells = [(u, i, 5.0) for u in range(12) for i in range(8) if (u % 2 == i % 2) and rng.random() < 0.8]
    y = spark.createDataFrame(cells, "userid long, itemid long, y double")
    losses = [factors.wmf_loss(feedback.liked(y), *factors.fit_wmf(y, size=2, sweeps=n), 10.0) for n in (1, 3)]
    assert losses[1] < losses[0] < 11 * len(cells)
    p, q = factors.fit_cofactor(y, size=2, sweeps=1)
    top = factors.top_factors(p, q, feedback.seen(y), 3).collect()
    seen = {(u, i) for u, i, _ in cells}
    assert top and not any((r.userid, r.itemid) in seen for r in top)


def test_samples_stay_outside_what_is_liked(spark):
    likes = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (3, 1), (3, 2), (3, 3)], "userid long, itemid long")
    items = spark.createDataFrame([(1,), (2,), (3,)], "itemid long")
    own = {1: {1, 3}, 2: {2}}
    got = sampling.negatives(likes, items, 5).collect()
    assert sum(r.label for r in got) == 3 and len(got) == 18 and {r.userid for r in got} == {1, 2}
    assert all((r.itemid in own[r.userid]) == bool(r.label) for r in got)
    drawn = sampling.triples(likes, items, 1).collect()
    assert drawn and all(r.liked in own[r.userid] and r.other not in own[r.userid] for r in drawn)
    assert sorted(drawn) == sorted(sampling.triples(likes.repartition(3), items, 1).collect())


def test_smoothing_equals_matrices(spark):
    likes = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "userid long, itemid long")
    a = graph.adjacency(graph.edges(likes))
    names = ["u1", "u2", "i1", "i2", "i3"]
    m, e = np.zeros((5, 5)), np.random.default_rng(4).normal(size=(5, 2))
    for r in a.collect():
        m[names.index(r.src), names.index(r.dst)] = r.w
    got = {r.node: r.vec for r in lightgcn.smoothed(a, spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, e, strict=True)], "node string, vec array<double>"), 2, 2).collect()}
    want = (e + m @ e + m @ m @ e) / 3
    assert all(np.allclose(got[n], want[k]) for k, n in enumerate(names))


def test_graph_training_moves_liked_items_up(spark):
    y = spark.createDataFrame([(u, i, 5.0) for u in range(6) for i in range(6) if u % 2 == i % 2], "userid long, itemid long, y double")

    def margin(epochs):
        p, q = lightgcn.factors_of(lightgcn.fit(y, size=4, layers=1, rate=0.05, epochs=epochs))
        p, q = (np.stack([r.vec for r in sorted(x.collect())]) for x in (p, q))
        s, good = p @ q.T, np.add.outer(np.arange(6), np.arange(6)) % 2 == 0
        return s[good].mean() - s[~good].mean()

    assert margin(4) > margin(0)


def test_samples_are_reproducible_and_pinned():
    from tidemark.plans import search

    a, b = search.samples(5, 42), search.samples(3, 42)
    assert a[:3] == b and a != search.samples(5, 43)
    assert a[0]["lightgcn"]["latent"] == 64 and a[0]["neumf"]["hidden_layers"] == (64, 32, 16, 8)
    assert all(x["signal_wmf"]["latent"] == x["wmf"]["latent"] and x["cofactor"]["gamma"] > 0 for x in a)
    rng = __import__("random").Random(42)
    assert a[0]["wmf"]["latent"] == rng.choice(search.SHARED["latent"])
