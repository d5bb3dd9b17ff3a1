"""Plain fits over the same cells are one job that shuffles them once and ranks in its tasks; a search leaves no tables behind."""

import os

import numpy as np
import pytest

from tidemark import storage
from tidemark.operators import als, factors, feedback, ranking
from tidemark.plans import models, search

SETTINGS = [als.Setting(3, 0.2, 7.0, 3, 5), als.Setting(2, 0.1, 5.0, 2, 6), als.Setting(4, 0.05, 10.0, 1, 7)]


@pytest.fixture(scope="module")
def y(spark):
    rng = np.random.default_rng(8)
    cells = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 500), rng.integers(-5, 60, 500), strict=True)})
    rows = [(u, i, float(rng.integers(1, 6))) for u, i in cells] + [(100, 3, 1.0), (-4, 2, 4.0), (100, 200, 1.0)]
    return spark.createDataFrame(rows, "userid long, itemid long, y double").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(9)
    users = spark.createDataFrame([(u, "interaction_1") for u in [*range(30), 100, -4, 999]], "userid long, grp string")
    goal = spark.createDataFrame(sorted({(int(u), int(i)) for u, i in zip(rng.integers(-4, 40, 300), rng.integers(-5, 70, 300), strict=True)} | {(100, 200), (999, 3)}), "userid long, itemid long")
    return users, goal


@pytest.mark.parametrize(("tasks", "block"), [(1, 1 << 12), (1, 7), (3, 7), (3, 1 << 12)])
def test_targets_are_those_of_single_fits(y, asked, monkeypatch, tasks, block):
    users, goal = asked
    monkeypatch.setattr(als, "ITEM_BLOCK", block)
    monkeypatch.setattr(als, "TOGETHER", 3)
    got = {tuple(r) for r in als.targets_found(y, users, goal, SETTINGS, 5, tasks=tasks).collect()}
    want = set()
    for n, s in enumerate(SETTINGS):
        p, q = als.fit(y, s.size, s.rate, s.alpha, s.sweeps, s.seed)
        top = factors.top_factors(p.join(users.select("userid"), "userid", "left_semi"), q, feedback.seen(y), 5)
        want |= {(n, *r) for r in top.join(goal, ["userid", "itemid"], "left_semi").select("userid", "itemid", "rank").collect()}
    assert got == want and {r[0] for r in got} == {0, 1, 2}


@pytest.mark.parametrize("goal", ["userid < -100", "itemid > 1000"])
def test_no_targets(y, asked, goal):
    users, every = asked
    assert als.targets_found(y, users, every.where(goal), SETTINGS[:2], 5, tasks=3).isEmpty()


def test_ndcg_of_runs_is_that_of_each(y, asked):
    users, goal = asked
    found = als.targets_found(y, users, goal, SETTINGS, 5, tasks=1)
    sizes = ranking.list_sizes(users.select("userid"), y, feedback.seen(y))
    runs = ranking.ndcg(found, users, goal, sizes, (2, 5), runs=4)  # the last finds nothing
    for n in range(4):
        one = ranking.ndcg(found.where(f"run = {n}").drop("run"), users, goal, sizes, (2, 5))
        assert sorted(runs.where(f"run = {n}").drop("run").collect()) == sorted(one.collect())
    assert runs.count() == 4 * one.count()


def test_a_search_fits_plain_rounds_at_once_and_leaves_no_tables(spark, y, asked, monkeypatch, tmp_path):
    users, goal = asked
    monkeypatch.setattr(search, "samples", lambda rounds, seed: [{"wmf": {"latent": s.size, "lambda_rate": s.rate, "alpha": s.alpha, "n_sweeps": s.sweeps, "random_state": s.seed}, "mostpop": {}} for s in SETTINGS])
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    jobs = []
    monkeypatch.setattr(als, "fit", None)  # no fit of its own
    monkeypatch.setattr(als, "targets_found", lambda *a, run=als.targets_found: jobs.append(len(a[3])) or run(*a))
    windows = models.Windows(y, users, goal, ranking.list_sizes(users.select("userid"), y, feedback.seen(y)))
    rows = search.random_search(spark, "a", models.SearchScores(windows), ("wmf", "mostpop"), rounds=3).collect()
    assert [(r.model, r.round) for r in rows] == [(m, n) for n in range(3) for m in ("wmf", "mostpop")] and jobs == [3]
    assert all(0 < r.score <= 1 for r in rows) and len({r.score for r in rows if r.model == "mostpop"}) == 1
    assert os.listdir(tmp_path) == []
