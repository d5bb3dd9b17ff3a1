"""Least squares in barrier tasks against the same fits by joins and shuffles."""

import numpy as np
import pytest

from tidemark.operators import als, factors, rules


@pytest.fixture(scope="module")
def y(spark):
    rows = [(u, i, 5.0) for u in range(9) for i in range(11) if (u * i + u) % 3 == 0 or i == 2] + [(1, 5, 2.0), (100, 3, 1.0), (101, 50, 5.0), (-4, 2, 4.0)]
    return spark.createDataFrame(rows, "userid long, itemid long, y double").cache()


def table(pair):
    return [{r[0]: r.vec for r in f.collect()} for f in pair]


def same(got, want):
    for a, b in zip(table(got), table(want), strict=True):
        assert a.keys() == b.keys() and a
        assert np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(b)], rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("tasks", [1, 3])
def test_plain(y, monkeypatch, tasks):
    monkeypatch.setattr(als, "ROWS", 4)
    monkeypatch.setattr(als, "TOGETHER", 3)  # the cells of popular items are dealt to several tasks
    same(als.fit(y, 3, 0.2, 7.0, 3, 5, tasks=tasks), factors.fit_wmf(y, 3, 0.2, 7.0, 3, 5))


@pytest.mark.parametrize("tasks", [1, 3])
def test_cofactor(y, tasks):
    same(als.fit(y, 3, 0.2, 7.0, 3, 5, gamma=1.5, negatives=1.0, tasks=tasks), factors.fit_cofactor(y, 3, 0.2, 7.0, 1.5, None, 1.0, 3, 5))


@pytest.mark.parametrize("tasks", [1, 2])
def test_signal(spark, y, tasks):
    t = rules.tokens(y, spark.createDataFrame([(u, int(u) % 2) for u in [*range(9), 100, 101, -4]], "userid long, cluster int"))
    signal = rules.factored(t, rules.rules(y, t), rules.seen(y)).normalised()
    same(als.fit(y, 3, 0.2, 7.0, 2, 5, signal=signal, gamma=0.7, tasks=tasks), factors.fit_wmf(y, 3, 0.2, 7.0, 2, 5, signal=signal, gamma=0.7))
