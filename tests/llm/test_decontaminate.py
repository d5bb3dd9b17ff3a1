import hashlib
import random
import re

import numpy as np
import pandas as pd

from tidemark.llm import decontaminate as D
from tidemark.llm.queries import op7_decontaminate


def words(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    where = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            where.setdefault(tuple(w[a : a + 13]), set()).add(i)
    sizes = {len(k) for k in where}
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in where:
                    hit.update(range(a, a + n))
                    ids |= where[k]
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in df.collect())


def test_whole_table(spark, sf_dir):
    docs, items = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(docs.text, list(zip(items.item_id, items.text, strict=True)))
    assert rows(op7_decontaminate(spark, sf_dir)) == sorted((False, i, *w) for i, w in zip(docs.doc_id, want, strict=True))
    assert any(w[4] for w in want)


def test_random_and_short_items_in_one_or_more_passes(spark):
    rng = random.Random(7)
    vocabulary = ["a", "b", "C", "é", "d9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 5, 12, 13, 14, 20, 40, 5])] + [(50, None), (51, " -- "), (None, text(4)), (52, "a " * 60)]
    docs = [(i, text(rng.randrange(0, 60)) + " " + (items[i % 8][1] if i % 3 else "") + " " + text(rng.randrange(0, 30))) for i in range(60)] + [(60, None), (61, ""), (62, "a " * 3000), (None, items[6][1]), (63, items[6][1]), (63, items[6][1])]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, n_words int, spans int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute([t for _, t in docs], [x for x in items if x[0] is not None])
    want = sorted((i is None, i or 0, *w) for (i, _), w in zip(docs, want, strict=True))
    assert rows(D.leak_report(d, b)) == want
    found = D.find_leaks(d, b, block_bytes=40)
    assert found.count() == len(docs)
    one = {(r.doc_id, r.n_hit, tuple(r.items)) for r in D.find_leaks(d, b).withColumn("n_hit", D.covered("spans")).collect()}
    assert {(r.doc_id, r.n_hit, tuple(r.items)) for r in found.withColumn("n_hit", D.covered("spans")).collect()} == one


def test_any_shared_window_shares_a_print():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shared = rng.integers(0, 3, D.WINDOW).astype(np.uint64)
        sides = [np.concatenate([rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64)]) for _ in range(2)]
        a, b = (set(D.winnowed(x, np.array([0, len(x)]), D.KGRAM, D.WINNOW)[0].tolist()) for x in sides)
        assert a & b


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert {r.n_hit for r in D.leak_report(odd, bench).collect()} == {0} and D.leak_report(odd, bench).count() == 13
    assert D.leak_report(nothing, bench).count() == 0
    assert D.leak_report(odd, nothing.selectExpr("doc_id item_id", "text")).count() == 13
