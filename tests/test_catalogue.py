"""Every query against its SQL in DuckDB: rows, columns and values."""

import math
import os

import duckdb
import pytest

from tidemark.plans.catalogue import FIXTURE_SQL, FIXTURES, ORACLE, QUERIES, SLOW

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings"):
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


# Fixtures on which cold users or literals tell; the others run the code of their whole_ siblings.
COLD = ("best_config", "eda", "eval", "feedback", "hyperparam", "ndcg", "results", "split")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SLOW)) + sorted(n for n in FIXTURES if n.startswith(COLD)))
def test_query(spark, con, name):
    """Those over all their tables, and those over fixtures: order lines that leave users cold, literals."""
    got = (QUERIES | FIXTURES)[name](spark, SF)
    rows = got.collect()
    assert rows
    if sql := (ORACLE | FIXTURE_SQL).get(name):
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert cells(rows, got.columns) == cells(want.fetchall(), names)
