"""Registry, strict times, reports."""

import datetime

import pytest

from tidemark.operators import factors, rules
from tidemark.plans import reports
from tidemark.sources import interactions as log
from tidemark.sources import registry


def test_the_command_converts_dumps(spark, tmp_path):
    source, target = registry.DATASETS["music"]
    (tmp_path / source).write_text('{"reviewerID": "U1", "asin": "B1", "unixReviewTime": 86400, "overall": 4.0}\n{"reviewerID": "U1", "asin": "B1", "unixReviewTime": 90000, "overall": 5.0}\n')
    out = registry.main(["--dataset", "music", "--input-dir", str(tmp_path), "--output-dir", str(tmp_path / "out")], spark)
    assert out == [f"{tmp_path}/out/{target}"]
    assert [tuple(r) for r in log.read_log(spark, out[0]).collect()] == [("U1", "B1", datetime.datetime(1970, 1, 2), 4.0)]
    with pytest.raises(FileNotFoundError):
        registry.convert(spark, "pantry", str(tmp_path), str(tmp_path))


def test_times_are_read_or_refused(spark):
    rows = [("a", " 2020-01-02T03:04:05"), ("b", "0"), ("c", "not-a-time")]
    df = spark.createDataFrame(rows, "userid string, ts string")
    assert [r.ts for r in log.with_times(df, strict=False).orderBy("userid").collect()] == [datetime.datetime(2020, 1, 2, 3, 4, 5), datetime.datetime(1970, 1, 1), None]
    with pytest.raises(ValueError):
        log.with_times(df)
    assert log.with_times(df.where("userid <> 'c'")).count() == 2


def test_a_tested_row_and_its_report(spark, tmp_path):
    rows = [(u, i, datetime.datetime(2020, 1, 1 + i + u % 2), 5.0) for u in range(6) for i in range(8)]
    events = spark.createDataFrame(rows, "userid long, itemid long, ts timestamp_ntz, rating double").where("itemid < 6 or userid < 5")
    repeated = events.unionByName(events.selectExpr("userid", "pmod(itemid + 1, 4) AS itemid", "ts", "rating"))
    row = reports.tested_row(repeated, "d", "wmf", 42, lambda y: factors.fit_wmf(y, size=2, sweeps=1), (10,))
    assert row.columns == ["seed", "dataset_name", "model", "fit_minutes", "ndcg_all@10", "ndcg_user_interaction_1@10", "ndcg_user_interaction_2@10", "ndcg_user_interaction_3_plus@10"]
    got = row.first()
    assert got.fit_minutes > 0 and 0 <= got["ndcg_all@10"] <= 1
    eda = reports.eda_rows(repeated, "d")
    assert [r.split for r in eda.collect()] == ["raw", "val", "test"]
    at = reports.write_results({"results": row, "dataset_eda": eda}, str(tmp_path), datetime.datetime(2020, 1, 2, 3, 4, 5, tzinfo=datetime.UTC))
    assert at.endswith("final_results_20200102T030405Z") and spark.read.option("header", True).csv(f"{at}/dataset_eda").count() == 3


def test_scores_of_one_user_and_compact_labels(spark):
    p = spark.createDataFrame([(1, [1.0, 2.0])], "userid long, vec array<double>")
    q = spark.createDataFrame([(5, [3.0, 4.0])], "itemid long, vec array<double>")
    assert [tuple(r) for r in factors.score_user(p, q, 1).collect()] == [(5, 11.0)]
    with pytest.raises(IndexError):
        factors.score_user(p, q, 2)
    labels = spark.createDataFrame([(1, 7), (2, 3), (3, 7)], "userid long, cluster int")
    assert sorted(map(tuple, rules.compacted(labels).collect())) == [(1, 1), (2, 0), (3, 1)]
