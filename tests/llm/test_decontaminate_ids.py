"""Repeated ids of items."""

import pytest

from tidemark.llm import decontaminate

ONE, TWO = (" ".join(f"{c}{n}" for n in range(20)) for c in ("alpha", "beta"))


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_repeated_ids_count_once(spark, block_bytes):
    docs = spark.createDataFrame([(1, f"{ONE} {TWO}"), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ONE), (7, TWO)], "item_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontaminate.find_leaks(docs, bench, block_bytes=block_bytes).collect()}
    assert got == {1: [7], 3: []}


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_nameless_items_count_as_hits_if_asked(spark, block_bytes):
    docs = spark.createDataFrame([(1, f"x {ONE} y"), (2, f"{ONE} {TWO}"), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, ONE), (7, TWO), (None, None)], "item_id long, text string")
    got = {r.doc_id: ([(s.s, s.e) for s in sorted(r.spans)], list(r["items"])) for r in decontaminate.find_leaks(docs, bench, block_bytes=block_bytes, nameless=True).collect()}
    assert got == {1: ([(1, 21)], []), 2: ([(0, 20), (20, 40)], [7]), 3: ([], [])}
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.leak_report(docs, bench, nameless=True).collect()} == {1: (20, 0, True), 2: (40, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench, nameless=True).collect()] == [3]
