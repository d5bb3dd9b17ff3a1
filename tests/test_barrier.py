"""Models that are trained in barrier tasks against plain loops, whatever the number of tasks."""

import numpy as np
import pytest
from pyspark import BarrierTaskContext

from tidemark.operators import factors, feedback, graph, lightgcn, neumf, sampling
from tidemark.operators.feedback import liked
from tidemark.operators.peers import Peers, Routes


def cells(spark, users=7, items=9):
    rows = [(u, i, 5.0) for u in range(users) for i in range(items) if (u * i + u) % 3 == 0 or i == 0] + [(1, 5, 2.0), (100, 3, 1.0)]
    return spark.createDataFrame(rows, "userid long, itemid long, y double")


def test_tasks_fetch_and_push_rows_of_each_other(spark):
    def run(batches):
        list(batches)
        import pyarrow as pa

        peers = Peers(BarrierTaskContext.get())
        own = np.arange(peers.me, 30, peers.n)
        wanted = np.arange(peers.me, 30, 2)
        routes = Routes(peers, wanted, wanted % peers.n, own)
        rows = np.stack([own, own * own], axis=1).astype(float)
        assert (routes.fetch(rows) == np.stack([wanted, wanted * wanted], axis=1)).all()
        into = np.zeros((len(own), 1))
        routes.push(np.ones((len(wanted), 1)), into)
        count = [sum(t <= x and (x - t) % 2 == 0 for t in range(peers.n)) for x in own]
        assert into[:, 0].tolist() == count
        assert peers.total(np.array([1.0]))[0] == peers.n
        big = peers.swap([np.full(1 << 20, float(peers.me))] * peers.n)
        assert [x[0] for x in big] == list(range(peers.n))
        peers.close()
        yield pa.RecordBatch.from_arrays([pa.array([peers.me])], names=["me"])

    got = spark.range(8).repartition(4).mapInArrow(run, "me long", barrier=True).collect()
    assert sorted(r.me for r in got) == [0, 1, 2, 3]


def test_steps_in_tasks_equal_a_job_a_step(spark):
    y = cells(spark)
    losses: list[float] = []
    want = {r.node: r.vec for r in lightgcn.fit(y, 3, 2, 0.05, 1e-2, 3, 5, batch_size=8).collect()}
    for tasks in (1, 3):
        losses.clear()
        got = {r.node: r.vec for r in lightgcn.fit_in_tasks(y, 3, 2, 0.05, 1e-2, 3, 5, batch_size=8, losses=losses, tasks=tasks).collect()}
        assert got.keys() == want.keys() and len(losses) == 3
        assert np.allclose([got[n] for n in sorted(got)], [want[n] for n in sorted(got)])


def test_graph_losses_equal_a_plain_loop(spark, monkeypatch):
    y, size, layers, rate, weight, seed = cells(spark), 3, 2, 0.05, 1e-2, 5
    names = sorted({f"u{r.userid}" for r in y.collect()} | {f"i{r.itemid}" for r in y.collect()})
    m = np.zeros((len(names),) * 2)
    for r in graph.adjacency(graph.edges(liked(y))).collect():
        m[names.index(r.src), names.index(r.dst)] = r.w
    smooth = sum(np.linalg.matrix_power(m, k) for k in range(layers + 1)) / (layers + 1)
    e = np.stack([np.random.default_rng([seed, *x.encode()]).normal(0, 0.1, size) for x in names])
    first, second, number, want = np.zeros_like(e), np.zeros_like(e), 0, []
    for epoch in range(4):
        drawn, losses = sorted(sampling.draws(liked(y), y.select("itemid"), seed + epoch + 1).collect()), []
        n = liked(y).count()
        for lo in range(0, n, 8):
            batch = [r for r in drawn if lo <= r.id < lo + 8]
            number += 1
            out, g, decay = smooth @ e, np.zeros_like(e), np.zeros((len(names), 1))
            for r in batch:
                u, p, q = (names.index(x) for x in (f"u{r.userid}", f"i{r.liked}", f"i{r.other}"))
                gap = out[u] @ (out[p] - out[q])
                losses.append(np.logaddexp(0, -gap) / len(batch))
                c = -1 / (1 + np.exp(gap)) / len(batch)
                g[u] += c * (out[p] - out[q])
                g[p] += c * out[u]
                g[q] -= c * out[u]
                decay[[u, p, q]] += weight / len(batch)
            g = smooth @ g + decay * e
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            e = e - rate * first / (1 - 0.9**number) / (np.sqrt(second / (1 - 0.999**number)) + 1e-8)
        want.append(sum(losses) / -(-n // 8))
    monkeypatch.setattr(lightgcn, "EPOCHS_A_JOB", 3)
    monkeypatch.setattr(lightgcn, "EDGES", 4)
    got: list[float] = []
    rows = lightgcn.fit_in_tasks(y, size, layers, rate, weight, 4, seed, batch_size=8, losses=got, tasks=2).collect()
    assert np.allclose(got, want)
    assert np.allclose([r.vec for r in sorted(rows, key=lambda r: r.node)], smooth @ e)


def test_no_like_leaves_the_graph_as_it_is(spark):
    y = spark.createDataFrame([(1, 1, 1.0)], "userid long, itemid long, y double")
    assert lightgcn.fit_in_tasks(y, size=2, layers=1, epochs=1).count() == 2


def test_network_losses_equal_a_plain_loop(spark, monkeypatch):
    y, shape, seed, per = cells(spark), neumf.Shape(2, (4, 3)), 11, 2
    regs, reg = (0.01, 0.02), 0.03
    users, items = sorted({r.userid for r in y.collect()}), sorted({r.itemid for r in y.collect()})
    draw = lambda c, ids: np.stack([np.random.default_rng([seed, *f"{c}{k}".encode()]).normal(0, 0.01, shape.row) for k in ids])
    u, i, net, number, want = draw("u", users), draw("i", items), shape.initial(seed), 0, []
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (u, i, net)]
    squares = np.concatenate([np.repeat([2 * r, 0.0], [a * b, b]) for r, (a, b) in zip((regs[1], 0.0), shape.sizes(), strict=True)])
    decay = np.repeat([2 * reg, 2 * regs[0]], [2, 2])
    from pyspark.sql import functions as F

    n_batches = None
    for epoch in range(3):
        rows = sampling.negatives(liked(y), y.select("itemid"), per, seed + epoch + 1)
        n_batches = n_batches or -(-rows.count() // 16)
        rows = rows.withColumn("batch", F.pmod(F.xxhash64("userid", "itemid", F.lit(seed + epoch + 1)), F.lit(n_batches))).collect()
        total = 0.0
        for b in range(n_batches):
            some = [r for r in rows if r.batch == b]
            if not some:
                number += 1
                continue
            number += 1
            at_u, at_i = [users.index(r.userid) for r in some], [items.index(r.itemid) for r in some]
            loss, du, di, dn = shape.gradients(u[at_u], i[at_i], np.array([r.label for r in some], float), net)
            total += loss
            gu, gi = np.zeros_like(u), np.zeros_like(i)
            np.add.at(gu, at_u, du)
            np.add.at(gi, at_i, di)
            n = len(some)
            for x, g, mv in ((u, gu / n + decay * u, moments[0]), (i, gi / n + decay * i, moments[1]), (net, dn / n + squares * net, moments[2])):
                mv[0], mv[1] = 0.9 * mv[0] + 0.1 * g, 0.999 * mv[1] + 0.001 * g * g
                x -= 0.02 * mv[0] / (1 - 0.9**number) / (np.sqrt(mv[1] / (1 - 0.999**number)) + 1e-8)
        want.append(total / len(rows))
    monkeypatch.setattr(neumf, "EPOCHS_A_JOB", 2)
    for tasks in (1, 3):
        got: list[float] = []
        model = neumf.fit(y, 2, (4, 3), 0.02, reg, regs, per, 3, 16, seed=seed, losses=got, tasks=tasks)
        assert np.allclose(got, want) and np.allclose(model.net, net)
        assert np.allclose([r.vec for r in sorted(model.vectors.where("node like 'u%'").collect(), key=lambda r: int(r.node[1:]))], u)


@pytest.mark.parametrize("hidden", [(6, 4, 2), (4, 3), (4,)])
def test_neural_ranking_equals_a_pass_over_all_pairs(spark, monkeypatch, hidden):
    y = cells(spark, 12, 15)
    shape, rng = neumf.Shape(2, hidden), np.random.default_rng(3)
    users, items = sorted({r.userid for r in y.collect()}), sorted({r.itemid for r in y.collect()})
    u, i = rng.normal(size=(len(users), shape.row)), rng.normal(size=(len(items), shape.row))
    i[4] = i[2]  # equal scores go to the smaller id
    net = shape.initial(1) + rng.normal(0, 0.3, len(shape.initial(1)))
    rows = [(f"u{k}", v.tolist()) for k, v in zip(users, u, strict=True)] + [(f"i{k}", v.tolist()) for k, v in zip(items, i, strict=True)]
    model = neumf.Model(shape, spark.createDataFrame(rows, "node string, vec array<double>"), net)
    seen = {(r.userid, r.itemid) for r in feedback.seen(y).collect()}
    want = []
    for a, v in zip(users[:10], u, strict=False):
        logits, _ = shape.forward(np.repeat(v[None], len(items), axis=0), i, net)
        score = dict(zip(items, (1 / (1 + np.exp(-logits))).astype(np.float32).tolist(), strict=True))
        for rank, k in enumerate(sorted((k for k in items if (a, k) not in seen), key=lambda k: (-score[k], k))[:4], 1):
            want.append((a, k, rank, round(score[k], 5)))
    monkeypatch.setattr(factors, "USER_BLOCK", 4)
    monkeypatch.setattr(factors, "ITEM_BLOCK", 5)
    monkeypatch.setattr(neumf, "PAIRS", 7)
    got = model.top(spark.createDataFrame([(a,) for a in users[:10]], "userid long"), feedback.seen(y), 4).collect()
    assert sorted((r.userid, r.itemid, r["rank"], round(r.score, 5)) for r in got) == sorted(want)


def test_draws_are_uniform_outside_the_history():
    n, own = 10, [np.array([0, 3, 4, 9]), np.arange(10)[np.arange(10) != 6], np.array([5])]
    flat, ends = np.concatenate(own), np.cumsum([0, *map(len, own)])
    rows = np.repeat([0, 1, 2], 30_000)
    shares = sampling._scattered(1, 0, rows, np.arange(len(rows)))
    got = sampling.outside(flat, ends, rows, shares, n)
    for k, mine in enumerate(own):
        counts = np.bincount(got[rows == k], minlength=n)
        assert not counts[mine].any()
        left = np.setdiff1d(np.arange(n), mine)
        assert (abs(counts[left] - 30_000 / len(left)) < 5 * (30_000 / len(left)) ** 0.5 + 1).all()


def test_samples_do_not_depend_on_partitions(spark):
    y = cells(spark)
    likes, items = liked(y), y.select("itemid")
    for f in (sampling.negatives, sampling.triples):
        both = [sorted(map(tuple, f(likes.repartition(k), items.repartition(k)).collect())) for k in (1, 5)]
        assert both[0] == both[1] and both[0]
    almost = spark.createDataFrame([(1, i) for i in range(2000) if i != 777], "userid long, itemid long")
    every = spark.range(2000).withColumnRenamed("id", "itemid")
    got = sampling.negatives(almost, every, 1).where("label = 0")
    assert got.select("itemid").distinct().collect()[0].itemid == 777 and got.count() == 1999
