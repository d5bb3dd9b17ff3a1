import hashlib
import random

import pandas as pd
import pytest

from tidemark.llm import repeats as R
from tidemark.llm.queries import op10_repeats


def brute(rows):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if least[b[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i is None, i or 0, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in df.collect())


def test_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)))
    assert rows(op10_repeats(spark, sf_dir)) == want and sum(w[3] for w in want)


@pytest.mark.parametrize("small", [False, True])
def test_random_texts(spark, small, monkeypatch):
    if small:
        for name, value in (("_PIECE", 300), ("_GATHER", 50), ("_HOT", 3)):
            monkeypatch.setattr(R, name, value)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passages = [text(n) for n in (50, 51, 49, 70, 120, 200)]
    docs = [(rng.randrange(1000) * 2 - 500, text(rng.randrange(90)) + rng.choice(passages) + text(rng.randrange(40)) + rng.choice(passages)[rng.randrange(30) :] + text(rng.randrange(90))) for _ in range(150)]
    docs = list({i: (i, t) for i, t in docs}.values())
    docs += [(5001 + i, "ab" * 200) for i in range(3)] + [(6001, "x" * 500), (6003, "y" + "x" * 80), (6005, None), (6007, ""), (None, docs[0][1]), (None, None), (6009, passages[4] * 3)]
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, lo int, tag string").repartition(3)
    assert rows(R.repeat_report(df)) == brute(docs)


def test_repeated_ids(spark, odd, nothing):
    a, b = "first text " * 9, "another one, " * 9
    docs = [(1, a), (1, a), (1, b), (2, a + b), (2, a)]
    assert rows(R.repeat_report(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert R.repeat_report(odd).count() == 13
    assert R.repeat_report(nothing).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in R.remove_repeats(odd).collect()}
    assert kept[4] == b"one two" and kept[5] == b"one two" and len(kept[7]) == 0 or kept[7] == b" end"
