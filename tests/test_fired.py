"""Signals made user by user in tasks against the dense one."""

import numpy as np
import pytest

from tidemark.operators import feedback, fired, rules

MORE = [(u, i, float(1 + (u * 7 + i * 5) % 5)) for u in range(1, 9) for i in range(1, 11) if (u * i) % 3 != 1] + [(20, 3, 1.0), (21, 4, 5.0), (21, 2**61, 5.0)]


@pytest.mark.parametrize(("how", "kinds"), [(None, rules.KINDS), ("row_max", rules.KINDS), ("log_row_max", rules.KINDS), (None, ("item", "icl")), (None, ("ucl",)), (None, ("item",))])
def test_results_are_those_of_the_dense_signal(spark, monkeypatch, how, kinds):
    monkeypatch.setattr(fired, "TOGETHER", 7)
    monkeypatch.setattr(fired, "LEAST", 2)
    monkeypatch.setattr(fired, "PIECE", 3)
    monkeypatch.setattr(rules, "written", lambda df, name: pytest.fail("a table of cells"))
    y = spark.createDataFrame(MORE, "userid long, itemid long, y double").cache()
    users = spark.createDataFrame([(u, u % 2) for u in range(22)], "userid long, cluster int")
    items = spark.createDataFrame([(i, i % 2) for i in [*range(1, 11), 2**61]], "itemid long, cluster int")
    t = rules.tokens(y, users, items).cache()
    found = rules.rules(y, t).cache()
    dense = rules.signal(t, found, feedback.seen(y), kinds)
    want = {(r.userid, r.itemid): r.s for r in (rules.normalised(dense, how) if how else dense).collect()}
    s = fired.Fired(t, found, feedback.seen(y), kinds)
    s = s.normalised(how) if how else s
    digest = {r.userid: r for r in s.digest().collect()}
    assert digest.keys() == {u for u, _ in want}
    for u, r in digest.items():
        own = {i: v for (v_, i), v in want.items() if v_ == u}
        assert (r.n, r.last_item) == (len(own), max(own)) and (r.total, r.top) == pytest.approx((sum(own.values()), max(own.values())))
    some = [u for u, _, _ in MORE if u != 3]
    top = s.top(spark.createDataFrame([(u,) for u in some], "userid long"), y, 4).collect()
    seen, every = {(u, i) for u, i, _ in MORE}, {i for _, i, _ in MORE}
    for u in set(some):
        rest = sorted((-round(want.get((u, i), 0.0), 9), i) for i in every if (u, i) not in seen)[:4]
        assert [(r["rank"], r.itemid, round(-r.score, 9)) for r in sorted(top, key=lambda r: r["rank"]) if r.userid == u] == [(n + 1, i, x) for n, (x, i) in enumerate(rest)]


def test_packed_rules_are_small_and_the_same():
    rng = np.random.default_rng(1)
    items = np.unique(rng.integers(-(2**62), 2**62, 50))
    for own in (items, items[:1], np.unique(rng.integers(0, 60000, 130))):
        values = rng.integers(1, 4, len(own)) / 7
        part = fired.pack(own, values)
        assert all((a == b).all() for a, b in zip(fired.unpack(part), (own, values), strict=True))
    assert len(part) <= 3 * len(own) + 60
