"""Clusters over kd-trees against plain Python, and what the trees spare."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, label int"


def plain(rows, k, rounds, scale, size, salt="2"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    centers = [list(v) for _, v in first]
    if not centers:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        own = [[] for _ in centers]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centers = [[sum(x) // len(x) for x in zip(*some, strict=True)] if some else c for some, c in zip(own, centers, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {c: sum(d for _, n, d in found if n == c) for _, c, _ in found}
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def report(spark, rows, monkeypatch=None, **settings):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    return sorted(map(tuple, clusters.cluster_report(df, **settings).collect()), key=repr)


def some_rows(n, size, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, size)) * 3
    rows = [(i, (middles[i % 5] + rng.normal(size=size) * 0.2).tolist()) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(n // 2)]  # a third of all rows are copies


@pytest.mark.parametrize("size", [1, 3])
def test_against_plain_python(spark, monkeypatch, size):
    monkeypatch.setattr(clusters, "LEAF_ROWS", 3)
    monkeypatch.setattr(clusters, "PAIRS", 7)
    settings = {"k": 7, "rounds": 4, "scale": 256, "size": size}
    rows = some_rows(120, size)
    assert report(spark, rows, **settings) == plain(rows, **settings)


def test_odd_rows(spark):
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [9.0, 1.0]), (None, [0.25, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, float("-inf")]), (8, [1.0, 2.0, 3.0]), (9, [-1e-9, 1e5]), (10, [0.5, -0.5])]
    settings = {"k": 4, "rounds": 3, "scale": 256, "size": 2}
    assert report(spark, rows, **settings) == plain(rows, **settings)
    assert report(spark, rows + [(11, [1e300, 0.0]), (12, [262144.0, 0.0])], **settings) == plain(rows, **settings)
    assert report(spark, [(None, [1.0, 1.0])], **settings) == [] == report(spark, [], **settings)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 1, 1, 1, 0, 2])]
    for k in (2, 3, 7):
        settings = {"k": k, "rounds": 2, "scale": 1, "size": 2}
        assert report(spark, rows, **settings) == plain(rows, **settings)


def test_trees_assign_whole_nodes_and_agree_with_a_full_comparison():
    rng = np.random.default_rng(5)
    middles = rng.integers(-4000, 4000, (20, 8))
    rows = (middles[rng.integers(0, 20, 6000)] + rng.integers(-40, 40, (6000, 8))).astype(np.int64)
    centers = np.concatenate([middles, middles[:2]]).astype(np.int64)
    far = ((rows[:, None, :] - centers[None]) ** 2).sum(axis=2)
    tree, compared = clusters.build(rows), [0]
    whole, _, leaves, _ = clusters.settle(tree, centers, compared)
    cluster, distance = clusters.assigned(tree, centers)
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    count, total = clusters.sums(tree, centers)
    for c in range(len(centers)):
        assert count[c] == (cluster == c).sum() and (total[c] == rows[cluster == c].sum(axis=0)).all()
    in_leaves = (tree.stop[leaves] - tree.start[leaves]).sum()
    assert len(whole) and in_leaves < len(rows) / 5 and compared[0] < len(rows) * len(centers) / 20


def test_largest_components_stay_exact():
    big = clusters.LIMIT - 1
    rows = np.array([[big] * 64, [-big] * 64, [big] * 63 + [big - 1], [0] * 64], np.int64)
    centers = np.array([[-big] * 64, [big] * 64, [1] * 64], np.int64)
    cluster, distance = clusters.assigned(clusters.build(rows, 1), centers)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)), n) for n, c in enumerate(centers.tolist())) for r in rows.tolist()]
    assert list(zip(distance.tolist(), cluster.tolist(), strict=True)) == want


def test_equal_rows_are_one_leaf():
    tree = clusters.build(np.zeros((10_000, 4), np.int64))
    assert len(tree.start) == 1
