import re

import pandas as pd
import pytest

from tidemark.llm import licenses as L
from tidemark.llm.queries import op6_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words, places, labels = WORD.findall(low), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def agree(got, texts):
    for (i, t), r in zip(texts, got, strict=True):
        assert i == r.doc_id
        want = brute(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, want[4].split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    agree(sorted(op6_licenses(spark, sf_dir).collect(), key=lambda r: r.doc_id), list(zip(docs.doc_id, docs.text, strict=True)))


def test_odd_rows(spark, odd, nothing):
    rows = sorted(odd.select("doc_id", "text").collect())
    agree(sorted(L.license_report(odd).collect(), key=lambda r: r.doc_id), [tuple(r) for r in rows])
    assert L.license_report(nothing).count() == 0


def test_phrases_and_errors(spark):
    texts = ["The MIT\n\tLicense, mit-license; submit license, mit licenses", "Aapache licenseé apache  LICENSE", "GNU General Public License general public license", "Relesed undr the MIT Licence ok", "x" * 500 + "Licensed under CC BY-NC 4.0." + "y" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(L.license_report(df).collect(), key=lambda r: r.doc_id)
    agree(got, list(enumerate(texts)))
    assert L.fuzzy("released undr the mit licence ok")[0][2:] == ("mit", 2)
    assert "cc-by-nc" in got[4].labels
    found = L.scan_licenses(df).where("doc_id = 4").first().found
    assert texts[4][found[0].start : found[0].end].lower() == "licensed under cc by-nc 4.0"


def test_notices_of_ones_own(spark):
    """Any notices can be searched: hundreds at once, with errors, in either case; none find nothing, an empty one is an error."""
    mine = {f"This File belongs to project number {i:04d} of the archive": f"own-{i}" for i in range(300)} | {"short": "s"}
    df = spark.createDataFrame([(1, "x THIS FILE belongs to projct number 0123 of the archive y"), (2, "released under the mit license"), (3, None), (4, "a SHORT one, a shrt one")], "doc_id long, text string")
    got = {r.doc_id: [x.label for x in r.found] for r in L.scan_licenses(df, notices=mine).collect()}
    assert "own-123" in got[1] and got[2] == got[3] == [] and got[4] == ["s"]
    assert [r.labels for r in L.license_report(df, {}).orderBy("doc_id").collect()] == ["", "mit", "", ""]
    with pytest.raises(ValueError):
        L.scan_licenses(df, notices={"": "none"})
