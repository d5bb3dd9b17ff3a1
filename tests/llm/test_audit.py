"""The audit of filters against plain Python, with copies on both sides of range bounds."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit


def fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])
        yield i, s or "", "".join(f for f, x in zip("ABCDE", tests, strict=True) if x)


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    each = list(fails(rows))
    out = []
    for part in {p for _, p, _ in each}:
        mine = [(i, f) for i, p, f in each if p == part]
        share, lines = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for n, x in enumerate(order):
                gone = [bool(set(f) & set(order[:n])) for _, f in mine]
                here = [i for (i, f), g in zip(mine, gone, strict=True) if x in f and not g]
                share[x] += len(here)
                lines.append((x, (part, order, n + 1, sum(not g and x not in f for (_, f), g in zip(mine, gone, strict=True)), len(here), sum(x in f and g for (_, f), g in zip(mine, gone, strict=True)), sum(f == x for _, f in mine), sum(i is not None and i in good for i in here), sum(i is not None and i in toxic for i in here))))
        out += [(*line, share[x]) for x, line in lines]
    return sorted(out)


def report(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in rows], "doc_id long, text string, source string, mask int, fp int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, audit.audit_report(docs.repartition(3), marks).collect()))


LONG = " ".join(f"w{i}" for i in range(220))
ROWS = [(1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (3, LONG, "a"), (4, LONG + " #", "a"), (5, "x " * 300, "a"), (6, "ABC" * 9, None), (7, "ABC" * 9, ""), (8, None, None), (9, "", "b"), (10, " \n ", "b"), (None, LONG, "a"), (None, "", None), (11, "ÉÉ " + LONG, "c"), (12, "tab\tone\x0bTWO" * 100, "c"), (12, "new", "c"), (13, "A" + "a" * 49, "a"), (14, "A" + "a" * 48, "a")]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (5, None, 1), (5, 1, None), (9, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_against_plain_python(spark):
    assert report(spark, ROWS, LABELS) == plain(ROWS, LABELS)


def test_odd_documents(spark, odd, nothing):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert sorted(map(tuple, audit.audit_report(odd, labels).collect())) == plain(rows, LABELS)
    assert len(audit.audit_report(odd, labels.where("false")).collect()) == 600
    assert audit.audit_report(nothing, labels).collect() == []


@pytest.mark.parametrize("kinds", [1, 2, 3, 1000])
def test_copies_over_range_bounds(spark, kinds):
    """Fingerprints that collide, a group of copies over many ranges, ids that repeat: each mask is right."""
    rows = [(i // 2 if i % 5 else None, f"text {i % 7 if i % 3 else 0}", f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = audit.failure_masks(docs, fingerprint=lambda t: F.pmod(F.xxhash64(t), F.lit(kinds))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = lambda m: "".join(f for b, f in enumerate("ABCDE") if m >> b & 1)
    assert Counter((r.id, r.part, names(r.mask)) for r in got) == Counter(fails(rows))


def test_a_long_text(spark):
    long = " ".join(f"word{i % 9000}" for i in range(160_000))
    rows = [(1, long, "a"), (2, long, "a"), (3, long + "|", "b")]
    assert len(long) > 1 << 20
    assert report(spark, rows, LABELS) == plain(rows, LABELS)
