"""A benchmark over one block is joined by fingerprints."""

import random

import numpy as np
import pytest
from test_decontaminate import brute, rows

from tidemark.llm import decontaminate as D
from tidemark.llm.queries import op7_decontaminate


@pytest.fixture
def joined(monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 1)


def test_whole_table(spark, sf_dir, monkeypatch):
    want = rows(op7_decontaminate(spark, sf_dir))
    monkeypatch.setattr(D, "BLOCK_BYTES", 1)
    assert rows(op7_decontaminate(spark, sf_dir)) == want


def test_a_passage_that_a_third_of_the_documents_and_many_items_hold(spark, joined):
    rng = random.Random(5)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = text(30)
    docs = [(i, f"{text(40)} {passage} {text(9)}" if i % 3 == 0 else text(50)) for i in range(300)] + [(None, passage), (301, None), (302, ""), (303, passage), (303, passage)]
    items = [(i, f"{text(5)} {passage}" if i % 2 else text(20)) for i in range(40)] + [(99, None), (100, " "), (101, "v1 v2 v3"), (101, passage)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = brute([t for _, t in docs], items)
    assert rows(D.leak_report(d, b)) == sorted((i is None, i or 0, *w) for (i, _), w in zip(docs, want, strict=True))
    assert sum(w[4] for w in want) == 103


def test_odd_rows(spark, joined, odd, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "cödé 漢字")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit) for r in D.leak_report(odd, bench).collect() if r.n_hit}
    assert got == {(4, 2), (5, 2), (10, 2)} and D.leak_report(odd, bench).count() == 13
    assert D.leak_report(nothing, bench).count() == 0


def test_the_filter_knows_every_hash(spark):
    hashes = np.array([0, 1, -1, -(1 << 63), (1 << 63) - 1, 32767, 32768, D.FILTER_BITS - 1], np.int64)
    bits = D._filter(spark.createDataFrame([(int(h),) for h in hashes], "hash long"))
    low = np.unique(hashes & (D.FILTER_BITS - 1))
    assert np.array_equal(np.flatnonzero(np.unpackbits(bits, bitorder="little")), low)
