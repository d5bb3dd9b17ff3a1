import zlib

import numpy as np
import pandas as pd

from tidemark.llm import langid as L
from tidemark.llm.queries import op3_langid


def test_held_out_accuracy(spark, sf_dir):
    got = op3_langid(spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").merge(got, on="doc_id")
    assert len(got) == len(docs)
    assert (docs.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id]).all()
    out = docs[docs.held_out & docs.lang.notna() & docs.lang_pred.ne("und")]
    assert (out.lang == out.lang_pred).mean() > 0.9
    assert docs.score.between(0, 1).all()


def test_scores_match_a_plain_loop(spark):
    rows = [("abc abd", "x"), ("xyz xyy", "y"), ("abz", "x")]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["x", "y"]

    def grams(t):
        return [g for g, _ in L.chunks([t])][0]

    counts = np.full((2, L.BUCKETS), L.SMOOTHING)
    for t, k in rows:
        for g in grams(t):
            counts[model.languages.index(k), g] += 1
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    want = np.array([logs[k][grams("abx")].sum() + np.log([2 / 3, 1 / 3][k]) for k in (0, 1)])
    want = np.exp(want - want.max()) / np.exp(want - want.max()).sum()
    assert np.allclose(L.score(["q", "abx", ""], model)[1], want, atol=1e-4)


def test_long_texts_are_whole(monkeypatch):
    whole = np.sort(np.concatenate([g for g, _ in L.chunks(["abcdefghij" * 50, "zz"])]))
    monkeypatch.setattr(L, "_CHUNK", 64)
    assert (np.sort(np.concatenate([g for g, _ in L.chunks(["abcdefghij" * 50, "zz"])])) == whole).all()


def test_odd_rows(spark, odd, nothing):
    got = {r.doc_id: r for r in L.language_report(odd).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 11}
    assert L.language_report(nothing).count() == 0
    unlabelled = odd.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.language_report(unlabelled).collect()} == {"und"}
    kept = L.known_languages(odd)
    assert kept.columns == odd.columns and kept.count() == 9
