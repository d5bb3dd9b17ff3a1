"""What a small step of a model in tasks costs: routes agreed for many steps, Adam by touched rows, dense graphs as matrices."""

import numpy as np

from tidemark.operators import lightgcn
from tidemark.operators.peers import Peers, Routes


def test_adam_by_touched_rows_is_adam(monkeypatch):
    monkeypatch.setattr(lightgcn, "CELLS", 20)
    rng = np.random.default_rng(1)
    start = [rng.normal(size=(30, 6)), rng.normal(size=(30, 6)), rng.random((30, 6))]
    rows, g = np.array([2, 5, 29]), rng.normal(size=(3, 6))
    every = np.zeros((30, 6))
    every[rows] = g
    a, b, c = ([x.copy() for x in start] for _ in range(3))
    lightgcn.adam(*a, every, 0.01, 7)
    lightgcn.adam(*b, g, 0.01, 7, rows)
    m, v = 0.9 * c[1] + (1 - 0.9) * every, 0.999 * c[2] + (1 - 0.999) * every * every
    want = c[0] - 0.01 / (1 - 0.9**7) * m / (np.sqrt(v / (1 - 0.999**7)) + 1e-8)
    for x, y in zip(a, b, strict=True):
        assert (x == y).all()
    assert np.allclose(a[0], want, rtol=1e-13, atol=0)
    none = np.zeros((0, 6))
    lightgcn.adam(none, none, none, none, 0.01, 7)
    lightgcn.adam(*c, none, 0.01, 7, np.zeros(0, np.int64))  # a task without rows of the batch
    assert np.allclose(c[1], 0.9 * start[1])


def test_routes_of_many_steps_are_those_of_each():
    own, rows = np.arange(0, 40, 2), np.random.default_rng(2).normal(size=(20, 3))
    wanted = [np.array([4, 8, 30]), np.zeros(0, np.int64), np.array([38, 0])]
    many = Routes.each(Peers(), wanted, [np.zeros(len(w), np.int64) for w in wanted], own)
    for w, r in zip(wanted, many, strict=True):
        one = Routes(Peers(), w, np.zeros(len(w), np.int64), own)
        assert (r.fetch(rows) == one.fetch(rows)).all()
        a, b, back = np.zeros((20, 3)), np.zeros((20, 3)), np.ones((len(w), 3)) * 2
        one.push(back, a)
        assert (r.push_total(back, b, np.array([1.0, 2.0])) == [1, 2]).all() and (a == b).all()


def test_a_dense_graph_is_multiplied_as_a_matrix(monkeypatch):
    rng = np.random.default_rng(3)
    src, dst = np.nonzero(rng.random((12, 9)) < 0.4)
    w, users, items = rng.random(len(src)), rng.normal(size=(12, 5)), rng.normal(size=(9, 5))
    got = []
    for cells in (16, 0):
        monkeypatch.setattr(lightgcn, "CELLS_AN_EDGE", cells)
        run = lightgcn.Training(5, 2, 0.1, 0.0, 1, 0, 1, False)
        got.append(run._smoother(Peers(), np.arange(12), np.arange(9), src, dst, np.zeros(len(src), np.int64), w)(users, items))
    for a, b in zip(*got, strict=True):
        assert np.allclose(a, b, rtol=1e-12, atol=1e-14)
