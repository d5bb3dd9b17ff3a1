import duckdb
import numpy as np
import pytest
from tidemark.llm import mtree as M
from tidemark.llm.queries import ORACLE, op2_mtree


def brute(rows, every=100, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in ok if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = sorted(map(tuple, op2_mtree(spark, sf_dir).collect()))
    assert got == sorted(con.execute(ORACLE["op2_mtree"]).fetchall()) and len(got) == 50


@pytest.mark.parametrize("block", [2, 100])
def test_ties_copies_and_odd_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(M, "QUERY_BLOCK", block)
    for name, value in (("LEAF", 4), ("FANOUT", 3), ("TREE_ROWS", 50)):
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(150)]
    rows += [(150 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(120)] + [(400, [1.0, 1.0, 1.0, 1.0]), (500, None), (600, [1.0, None, 0.0, 0.0]), (700, [float("nan")] * 4), (800, [float("inf"), 0.0, 0.0, 0.0]), (900, [0.1, 0.2]), (1000, []), (7, rows[7][1]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, rank int, id int").repartition(2)
    assert sorted(map(tuple, M.search_report(df).collect())) == brute(rows)
    assert M.search_report(df.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(0, [1e12, 1.0]), (1, [3e3, 1.5]), (2, [-1e12, 2.0]), (3, [1e-3, 0.0])]
    got = sorted(map(tuple, M.search_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert [g[:3] for g in got] == [b[:3] for b in brute(rows)] and got[-1][3] == -(2**63)


def test_bounds_spare_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 2000
    rows = np.floor(np.concatenate([c + rng.normal(size=(100, 8)) * 20 for c in centres]))
    tree = M.Tree.from_bytes(M.build(rows, np.arange(len(rows))).to_bytes())
    for q in rows[::500]:
        best, seen = [], [0]
        M.search(tree, q, -1, 10, best, seen)
        want = sorted(((int(s), -i) for i, s in enumerate(rows @ q)), reverse=True)[:10]
        assert sorted(best, reverse=True) == want and seen[0] < len(rows) / 2


def test_components_without_a_finite_floor(spark):
    """Beyond 1.75e305 the floor of 1024 x is no double: such vectors take no part; just below they do."""
    rows = [(0, [1.0, 1.0]), (100, [1e306, 0.0]), (1, [1e305, 0.0]), (2, [-1.79e308, 1.0]), (3, [0.5, 0.5])]
    got = M.search_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 3)] and got[0].score == 2**63 - 1


def test_clusters_spare_groups(spark, monkeypatch):
    """With the k-th score of its own cluster a query goes to few of the other groups, and finds the same rows."""
    for name, value in (("LEAF", 8), ("FANOUT", 4), ("TREE_ROWS", 100), ("PART_ROWS", 100)):
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (4 * centres[i % 30] + rng.normal(size=16) / 50).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index, passed, got = M.build_index(df).cache(), [], []
    kept = M.searched_groups
    monkeypatch.setattr(M, "searched_groups", lambda *a: passed.append(kept(*a)) or passed[-1])
    monkeypatch.setattr(M, "drop", lambda *a: None)
    got = sorted(map(tuple, M.top_k(index, df.where("vec_id % 100 = 0")).collect()))
    groups = index.select("pivot", "part", "number").distinct().count()
    assert got == brute(rows) and passed[0].count() < 30 * groups / 4


def test_one_hot_pivot(spark, monkeypatch):
    """Copies of one vector, and one pivot for all: rows still spread, ties go to smaller keys."""
    for name, value in (("TREE_ROWS", 20), ("PIVOTS", 1), ("PART_ROWS", 10)):
        monkeypatch.setattr(M, name, value)
    rows = [(i, [1.0, 2.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert M.build_index(df).select("part").distinct().count() > 1
    assert sorted(map(tuple, M.search_report(df).collect())) == brute(rows)
