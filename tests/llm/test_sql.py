"""Every query of the subpackage that has SQL against DuckDB: columns and values, on the whole tables and on literal rows."""

import duckdb
import pytest
from tidemark.llm.queries import ORACLE, QUERIES

TABLES = ("documents", "benchmark", "embeddings", "labels")
OF_VECTORS = {"op2_mtree", "op11_kdtree"}


def both(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        if t == "embeddings" or name not in OF_VECTORS:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if folder.startswith('/root/testdata') else '/*.parquet'}'")
    want, got = con.execute(ORACLE[name]), QUERIES[name](spark, folder)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = got.select(names).collect()
    assert rows
    assert sorted(map(tuple, rows), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_whole_tables(spark, sf_dir, name):
    both(spark, sf_dir, name)


def test_odd_rows(spark, odd, tmp_path):
    folder = str(tmp_path)
    odd.where("doc_id <> 6 and doc_id <> 7").dropDuplicates(["doc_id"]).write.parquet(f"{folder}/documents.parquet")
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(1, passage), (2, "ONE two"), (3, None), (None, "a b"), (4, " - "), (5, passage + " q"), (10, "one TWO")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(5, 1, None), (5, None, 1), (9, 0, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name in sorted(set(ORACLE) - OF_VECTORS):
        both(spark, folder, name)
