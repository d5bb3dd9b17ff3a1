"""Queries take the whole log."""

import os

from tidemark.plans.catalogue import FIXTURE_SQL, FIXTURES, ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_no_order_line_is_left_out(spark):
    pairs = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/orders.parquet").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select("o_custkey", "l_partkey").distinct().count()
    assert QUERIES["whole_event_log_sorted"](spark, SF).count() == pairs
    assert FIXTURES["event_log_sorted"](spark, SF).count() < pairs / 5


def test_every_query_over_first_lines_has_a_whole_sibling(spark):
    assert all("l_linenumber = 1" not in sql for sql in ORACLE.values()) and set(ORACLE) <= set(QUERIES)
    assert all(f"whole_{name}" in QUERIES for name, sql in FIXTURE_SQL.items() if "l_linenumber = 1" in sql)
    # those without SQL: the likes of the samples are all that the whole fit matrix has, less users without an item left
    whole = QUERIES["whole_feedback_views_ybl"](spark, SF).where("l = 1")
    assert QUERIES["negative_samples"](spark, SF).where("label = 1").join(whole, ["userid", "itemid"], "left_semi").count() == whole.count()
