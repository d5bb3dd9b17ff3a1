"""Steps of training."""

import numpy as np

from tidemark.operators import graph, lightgcn, sampling
from tidemark.operators.feedback import liked


def test_one_adam_step_for_every_batch(spark, monkeypatch):
    y = spark.createDataFrame([(u, i, 5.0) for u in range(4) for i in range(6) if (u + i) % 2], "userid long, itemid long, y double")
    sizes, step = [], lightgcn._step
    monkeypatch.setattr(lightgcn, "_step", lambda a, some, n, *b: sizes.append((some.count(), n, b[-1])) or step(a, some, n, *b))
    lightgcn.fit(y, size=2, layers=1, epochs=2, batch_size=5)
    assert sizes == [(5, 5, 1), (5, 5, 2), (2, 2, 3), (5, 5, 4), (5, 5, 5), (2, 2, 6)]


def test_two_steps_equal_plain_adam(spark):
    y = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 2, 5.0), (2, 3, 5.0)], "userid long, itemid long, y double")
    likes, rate, weight, seed = liked(y), 0.01, 1e-2, 7
    names = ["u1", "u2", "i1", "i2", "i3"]
    m = np.zeros((5, 5))
    for r in graph.adjacency(graph.edges(likes)).collect():
        m[names.index(r.src), names.index(r.dst)] = r.w
    smooth = (np.eye(5) + m) / 2
    e = np.stack([np.random.default_rng([seed, *x.encode()]).normal(0, 0.1, 2) for x in names])
    first, second = np.zeros_like(e), np.zeros_like(e)
    drawn = sorted(sampling.draws(likes, y.select("itemid"), seed + 1).collect())
    for number, batch in enumerate((drawn[:3], drawn[3:]), 1):
        out, g, decay = smooth @ e, np.zeros_like(e), np.zeros((5, 1))
        for r in batch:
            u, p, q = (names.index(x) for x in (f"u{r.userid}", f"i{r.liked}", f"i{r.other}"))
            c = -1 / (1 + np.exp(out[u] @ (out[p] - out[q]))) / len(batch)
            g[u] += c * (out[p] - out[q])
            g[p] += c * out[u]
            g[q] -= c * out[u]
            decay[[u, p, q]] += weight / len(batch)
        g = smooth @ g + decay * e
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        e = e - rate * first / (1 - 0.9**number) / (np.sqrt(second / (1 - 0.999**number)) + 1e-8)
    got = {r.node: r.vec for r in lightgcn.fit(y, 2, 1, rate, weight, 1, seed, batch_size=3).collect()}
    assert np.allclose(np.stack([got[x] for x in names]), smooth @ e)
