"""Lines dropped against plain Python."""

import hashlib
import re

import pytest

from tidemark.llm import lines

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(FOLD)


def plain(rows, least=10):
    where = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(i)
    gone = {k for k, ids in where.items() if k and len(ids) >= least}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [line for line in every if key(line) not in gone]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def report(spark, rows, least=10):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, digest string")
    return sorted(map(tuple, lines.line_report(df, least).collect()), key=repr)


def test_every_kind_of_line(spark):
    rows = [(i, f"shared header\r\nown {i}\n\n \t\nSHARED   footer É") for i in range(9)]
    rows += [(9, "\tShared Header\x0b\nelse\n"), (10, "shared   footer É"), (11, "SHARED   FOOTER É\nshared   footer é"), (12, None), (13, ""), (14, "\n\n"), (15, "shared header\nshared header"), (15, "shared header\nshared header"), (15, "else"), (None, "Shared header\nelse"), (None, None)]
    assert report(spark, rows) == plain(rows)
    for least in (1, 2, 11):
        assert report(spark, rows, least) == plain(rows, least)


def test_a_line_is_counted_once_a_document(spark):
    rows = [(1, "again\n" * 20), (1, "again"), (2, "again")]
    assert report(spark, rows, 3) == plain(rows, 3) and report(spark, rows, 2) == plain(rows, 2)
    assert {r[2] for r in report(spark, rows, 3)} == {0}


def test_odd_documents(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for least in (1, 2):
        assert sorted(map(tuple, lines.line_report(odd, least).collect()), key=repr) == plain(rows, least)
    assert lines.line_report(nothing).collect() == []


def test_a_long_text_and_a_hot_group(spark):
    long = "\n".join(f"line {i % 5000} of a long text" for i in range(60_000))
    rows = [(0, long), (1, long + "\nx"), *((i, "the same text\nand its line") for i in range(2, 400)), *((i, f"own {i}") for i in range(400, 800))]
    assert len(long) > 1 << 20
    assert report(spark, rows) == plain(rows) and report(spark, rows, 2) == plain(rows, 2)


def test_other_columns_pass(spark, odd):
    got = lines.dedup_lines(odd.withColumn("row", odd.doc_id), 2)
    assert got.columns == [*odd.columns, "row", "n_lines", "n_dropped"]
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] is None and texts[4] == "" and texts[12] == "é" * 300
    with pytest.raises(ValueError):
        lines.dedup_lines(odd.withColumn("N_lines", odd.doc_id))
