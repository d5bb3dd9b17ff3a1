import pandas as pd
from test_decontaminate import brute as leaks
from test_secrets import brute as spans
from test_similarity import brute as groups
from test_tokens import check_pieces

import corpus_pipeline as C
from tidemark.llm.queries import op3_langid


def masked(text):
    out, at = [], 0
    for s, e in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in filter(None, spans(text).split(","))):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_run_against_plain_python(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    named = op3_langid(spark, sf_dir).toPandas().set_index("doc_id").lang_pred
    docs = docs[(named[docs.doc_id] != "und").to_numpy()]
    docs = docs[docs.doc_id.isin([i for _, i, _, c in groups(list(zip(docs.doc_id, docs.text, strict=True))) if i == c])]
    bench = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    docs = docs[[not x[4] for x in leaks(docs.text, list(zip(bench.item_id, bench.text, strict=True)))]]
    docs = docs.assign(text=[masked(t) for t in docs.text])
    got = C.run(spark, sf_dir).toPandas()
    assert set(got.doc_id) == set(docs.doc_id) and 0 < len(docs) < 1000
    check_pieces(got, docs)


def test_stages_keep_columns_and_survive_nothing(spark, sf_dir, odd, nothing):
    for docs in (odd, nothing):
        now = docs
        for _, stage in C.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == docs.columns
        kept = {r.doc_id: r for r in now.collect()}
        assert set(kept) == ({4, 6, 8, 10, 12} if docs is odd else set())
        out = C.STAGES[-1][1](spark, now, sf_dir)
        assert {r.doc_id for r in out.collect()} == set(kept)
        if docs is odd:
            assert "[secret]" in kept[10].text and kept[10].n_chars == len(kept[10].text) and kept[4].n_chars is None
