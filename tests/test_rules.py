"""All families of rules, and clusters."""

import inspect
from collections import defaultdict

import numpy as np
import pytest

from tidemark.operators import factors, feedback, positions, ranking, rules
from tidemark.plans import catalogue

CELLS = [(1, 1, 5.0), (1, 2, 5.0), (2, 1, 5.0), (2, 3, 5.0), (3, 1, 5.0), (3, 2, 5.0), (4, 3, 1.0)]


def matrix(spark, cells):
    return spark.createDataFrame(cells, "userid long, itemid long, y double")


def test_full_signal_has_all_families(spark, monkeypatch):
    own = {u: {i for v, i, y in CELLS if v == u and y > 3} for u in (1, 2, 3, 4)}
    share = lambda tokened, i: sum(i in own[u] for u in tokened) / len(tokened)
    fans = [u for u in own if own[u]]
    want = defaultdict(dict)
    for u in own:
        for i in {1, 2, 3} - {i for v, i, _ in CELLS if v == u}:
            want[u][i] = share(list(own), i) + (share(fans, i) if own[u] else 0) + sum(share([v for v in own if j in own[v]], i) for j in own[u])
    got = {(r.userid, r.itemid): r.s for r in rules.full_signal(matrix(spark, CELLS)).collect()}
    assert got == pytest.approx({(u, i): s / max(row.values()) for u, row in want.items() for i, s in row.items() if s})
    # and it is what the query fits on: user 4 likes nothing, so only the clusters of users give it a signal
    seen = {}
    monkeypatch.setattr(catalogue, "_fitted", lambda spark, sf_dir, fit: fit(matrix(spark, CELLS)))
    monkeypatch.setattr(catalogue.factors, "fit_wmf", lambda y, *a, signal=None, **b: seen.update(s=signal.collect()))
    inspect.unwrap(catalogue.signal_wmf_fit_scores)(spark, "")
    assert {r.userid for r in seen["s"]} == {1, 2, 3, 4}


def test_clusters_part_users_and_items(spark):
    y = matrix(spark, [(u, i, 5.0) for u in range(8) for i in range(8) if u % 2 == i % 2] + [(9, 0, 1.0)])
    for of in ("userid", "itemid"):
        found = {r[of]: r.cluster for r in rules.clusters(y, of, 2).collect()}
        assert len({found[k] for k in (0, 2, 4, 6)}) == 1 == len({found[k] for k in (1, 3, 5, 7)}) and found[0] != found[1]
    assert 9 in {r.userid for r in rules.clusters(y, "userid", 2).collect()}
    assert rules.clusters(y, "userid", 1) is None


MORE = [(u, i, float(1 + (u * 7 + i * 5) % 5)) for u in range(1, 9) for i in range(1, 11) if (u * i) % 3 != 1]


def clustered(spark, y, how="row_max"):
    """A signal with two clusters on both sides, and the same as a dict."""
    users = spark.createDataFrame([(u, u % 2) for u in range(9)], "userid long, cluster int")
    items = spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "itemid long, cluster int")
    t = rules.tokens(y, users, items)
    found = rules.rules(y, t)
    plain = rules.normalised(rules.signal(t, found, feedback.seen(y)), how)
    return rules.factored(t, found, feedback.seen(y)).normalised(how), {(r.userid, r.itemid): r.s for r in plain.collect()}


@pytest.mark.parametrize("how", ["row_max", "log_row_max"])
def test_factored_signal_is_the_dense_one(spark, how):
    y = matrix(spark, MORE)
    s, want = clustered(spark, y, how)
    assert {(r.userid, r.itemid): r.s for r in s.rows().collect()} == pytest.approx(want)
    digest = {r.userid: r for r in s.digest().collect()}
    for u in {u for u, _ in want}:
        own = {i: v for (v_, i), v in want.items() if v_ == u}
        r = digest[u]
        assert (r.n, r.last_item) == (len(own), max(own)) and (r.total, r.top) == pytest.approx((sum(own.values()), max(own.values())))
    assert len(digest) == len({u for u, _ in want})
    top = s.top(y.select("userid").distinct(), y, 4)
    seen = {(u, i) for u, i, _ in MORE}
    for u in range(1, 9):
        rest = sorted((-round(want.get((u, i), 0.0), 9), i) for i in range(1, 11) if (u, i) not in seen and any(j == i for _, j, _ in MORE))
        assert [r.itemid for r in top.where(f"userid = {u}").orderBy("rank").collect()] == [i for _, i in rest][:4]
    assert max(r.s for r in s.quantised().collect()) == 1.0


def test_signal_wmf_is_the_dense_one(spark):
    y = matrix(spark, MORE)
    s, cells = clustered(spark, y)
    size, rate, alpha, gamma, seed = 3, 0.3, 5.0, 0.7, 42
    users, items = sorted({u for u, _, _ in MORE}), sorted({i for _, i, _ in MORE})
    liked, value, has = (np.zeros((len(users), len(items))) for _ in range(3))
    for u, i, r in MORE:
        liked[users.index(u), items.index(i)] = r > 3
    for (u, i), v in cells.items():
        value[users.index(u), items.index(i)], has[users.index(u), items.index(i)] = v, 1
    draw = lambda keys, more: np.stack([np.random.default_rng([seed + more, k]).normal(0, 0.01, size) for k in keys])

    def half(own, sig, sig_has, fixed):
        out = []
        for x, v, h in zip(own, sig, sig_has, strict=True):
            left = fixed.T @ fixed + rate * np.eye(size) + (fixed.T * (alpha * x + gamma * h)) @ fixed
            out.append(np.linalg.solve(left, fixed.T @ ((1 + alpha) * x + gamma * v)))
        return np.stack(out)

    keep = np.array([u != 3 for u in users])
    for who in (None, keep):
        some = np.ones(len(users), bool) if who is None else who
        q = draw(items, factors.ITEM_STREAM)
        for _ in range(2):
            p = half(liked[some], value[some], has[some], q)
            q = half(liked[some].T, value[some].T, has[some].T, p)
        fit_loss = gamma * (has[some] * (value[some] - p @ q.T) ** 2).sum()
        if who is not None:
            whole = np.zeros((len(users), size))
            whole[some], whole[~some] = p, half(liked[~some], value[~some], has[~some], q)
            p = whole
        reports = []
        fit_users = None if who is None else spark.createDataFrame([(u,) for u in users if u != 3], "userid long")
        got_p, got_q = factors.fit_wmf(y, size, rate, alpha, 2, seed, signal=s, gamma=gamma, fit_users=fit_users, report_every=2, report=reports.append)
        assert np.allclose(np.stack([r.vec for r in sorted(got_p.collect())]), p)
        assert np.allclose(np.stack([r.vec for r in sorted(got_q.collect())]), q)
        assert [r["sweep"] for r in reports] == [1, 2] and reports[1]["signal"] == pytest.approx(fit_loss)
    with pytest.raises(ValueError):
        factors.fit_wmf(y, fit_users=spark.createDataFrame([(99,)], "userid long"))
    with pytest.raises(ValueError):
        factors.fit_wmf(y, sweeps=0)


@pytest.mark.parametrize("change", [{"k_user": 0}, {"k_item": True}, {"min_support": 1.5}, {"min_confidence": -0.1}, {"min_lift": float("inf")}, {"how": "max"}])
def test_settings_of_a_signal_are_checked(change):
    good = {"k_user": 1, "k_item": 1, "min_support": 0.0, "min_confidence": 0.0, "min_lift": 0.0, "how": "row_max"}
    rules.checked(**good)
    with pytest.raises(ValueError):
        rules.checked(**good | change)


def test_top_factors_are_the_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(factors, "ITEM_BLOCK", 7)
    monkeypatch.setattr(factors, "USER_BLOCK", 4)
    rng = np.random.default_rng(5)
    p, q = rng.integers(-2, 3, (13, 2)).astype(float), rng.integers(-2, 3, (40, 2)).astype(float)
    seen = {(int(u), int(i)) for u, i in zip(rng.integers(0, 13, 60), rng.integers(0, 45, 60), strict=True)}
    table = lambda m, key: spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(m)], f"{key} long, vec array<double>")
    got = factors.top_factors(table(p, "userid"), table(q, "itemid"), spark.createDataFrame(sorted(seen), "userid long, itemid long"), 5).collect()
    for u in range(13):
        want = sorted((-float(p[u] @ q[i]), i) for i in range(40) if (u, i) not in seen)[:5]
        assert [(-r.score, r.itemid) for r in sorted((r for r in got if r.userid == u), key=lambda r: r.rank)] == want


def test_text_ids_go_from_a_dump_to_rules(spark, tmp_path):
    from tidemark.sources import interactions as log

    path = tmp_path / "dump.json"
    rows = [(f"U{u}", f"B{i:03d}", 1000 + 10 * u + i, 5.0) for u in range(4) for i in range(5) if (u + i) % 3]
    path.write_text("\n".join(f'{{"reviewerID": "{u}", "asin": "{i}", "unixReviewTime": {t}, "overall": {r}}}' for u, i, t, r in rows))
    y = feedback.matrix(log.earliest(log.complete(log.read_reviews(spark, str(path)))))
    numbers = {r.itemid: r.idx for r in positions.codes(y, "itemid").collect()}
    assert numbers == {i: n for n, i in enumerate(sorted({i for _, i, _, _ in rows}))}
    found = rules.rules(y, rules.tokens(y))
    assert found.where("kind = 'item' and token = 'B000'").count() > 0
    p, q = factors.fit_coded(y, lambda coded: factors.fit_wmf(coded, size=2, sweeps=1))
    assert {r.userid for r in p.collect()} == {f"U{u}" for u in range(4)} and {r.itemid for r in q.collect()} == set(numbers)
    top = ranking.top_popular(feedback.popularity(y), y.select("userid").distinct(), feedback.seen(y), 2)
    assert top.count() > 0
