"""Long texts, clashing names, many languages, huge numbers, and plain versions of verdicts and notices."""

import random
import time

import numpy as np
import pytest

from tidemark.llm import langid, licenses, mtree, secrets, urls

from test_mtree import brute as best_ten
from test_urls import brute_ratio, parts, rule


def test_clashing_names_pass(spark):
    df = spark.createDataFrame([(1, 'password = "abcdef12"', "en", "s", 21, "a", "b", "c", "d"), (2, None, "en", "s", 0, "a", "b", "c", "d")], "doc_id long, text string, lang string, source string, n_chars long, before string, _before string, language string, best string")
    for got in (secrets.redact_documents(df), langid.known_languages(df)):
        assert got.columns == df.columns
        assert {tuple(r)[5:] for r in got.collect()} == {("a", "b", "c", "d")}


def test_a_long_hexadecimal_text():
    began = time.time()
    assert secrets.find("0123456789abcdef" * 125_000) == [(0, 2_000_000, "hex")]
    assert time.time() - began < 20


def test_every_language_can_be_predicted(spark, monkeypatch):
    rng = random.Random(1)
    words = {f"l{n:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(6)] for n in range(60)}
    rows = [(lang, " ".join(rng.choice(w) for _ in range(30))) for lang, w in words.items() for _ in range(1 + (lang < "l050"))]
    df = spark.createDataFrame(rows, "lang string, text string")
    whole = {r.text: r.language for r in langid.identify(df, langid.fit(df)).collect()}
    monkeypatch.setattr(langid, "LANGUAGE_BLOCK", 7)
    got = langid.identify(df, langid.fit_blocks(df)).collect()
    for r in got:
        assert r.language.lang == r.lang == whole[r.text].lang and r.language.score == pytest.approx(whole[r.text].score)
    with pytest.raises(ValueError):
        langid.fit(df)


@pytest.mark.parametrize("scale", [1e200, 3.1e12, 2.0**43])
def test_huge_components_go_through_the_tree(spark, monkeypatch, scale):
    for name, value in (("LEAF", 4), ("FANOUT", 3), ("TREE_ROWS", 40)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=3) * (scale if i % 3 else 1.0)).tolist()) for i in range(120)]
    want = []
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in range(0, 120, 100):
        scores = sorted((-cut(sum(a * b for a, b in zip(ints[q], ints[i], strict=True))), i) for i, _ in rows if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, mtree.search_report(df).collect())) == want


def test_rows_far_apart_in_size_need_no_deep_stack():
    rows = np.floor(2.0 ** (np.arange(4000) / 90))[:, None]
    tree, best = mtree.build(rows, np.arange(4000)), []
    mtree.search(tree, np.array([3.0]), -1, 5, best)
    want = sorted(((int(3 * r), -i) for i, r in enumerate(rows[:, 0].astype(int).tolist())), reverse=True)[:5]
    assert sorted(best, reverse=True) == want
    assert best_ten([(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 2 * 1024 * 1024)]


def ends_within(notice, text, most):
    """End places of substrings that differ from the notice by so many edits at most, with the fewest edits."""
    row, out = list(range(len(notice) + 1)), {}
    for at, c in enumerate(text, 1):
        new = [0]
        for j, d in enumerate(notice, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
        if row[-1] <= most:
            out[at] = row[-1]
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = _next(row, i, c, b)
    return row[-1]


def _next(row, i, c, b):
    new = [i]
    for j, d in enumerate(b, 1):
        new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
    return new


def test_notices_against_a_plain_scan():
    rng = random.Random(5)
    names = sorted(licenses.NOTICES)
    for _ in range(60):
        pieces = []
        for _ in range(rng.randrange(1, 5)):
            notice = list(rng.choice(names))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "q"])
            pieces.append("".join(notice))
        text = rng.choice(["", " ", " and also ", "\n"]).join(pieces)
        found = licenses.fuzzy(text)
        for notice, label in licenses.NOTICES.items():
            most = len(notice) // licenses.PER_ERROR
            own = [(s, e, n) for s, e, la, n in found if la == label and distance(text[s:e], notice) == n <= most]
            for end in ends_within(notice, text, most):
                assert any(s < end and e > end - len(notice) - most for s, e, _ in own), (notice, text)
        for s, e, label, n in found:
            assert min(distance(text[s:e], x) for x, la in licenses.NOTICES.items() if la == label) <= n


def test_many_notices_in_one_text():
    text = "released under the mit licence " * 4000
    began = time.time()
    assert len(licenses.fuzzy(text)) == 4000 and time.time() - began < 60


def test_verdicts_against_a_plain_model(spark):
    rng = random.Random(2)
    pages = [f"http://{rng.choice(['a', 'bb', 'shop'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['', 'es/', 'fr/'])}{rng.choice(['x', 'casino', 'about'])}{n % 7}" for n in range(160)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    texts = {u: u.split("://", 1)[1] for u in pages}
    asides = {r.t: r.h == 0 for r in spark.createDataFrame([(t,) for t in sorted(set(texts.values()))], "t string").selectExpr("t", f"pmod(xxhash64(t), {urls.CALIBRATION}) AS h").collect()}
    rows, ruled = [], {}
    for u in pages:
        verdict = rule(*parts(u))[0]
        ruled[u] = verdict
        allowed = None if verdict is None else verdict == "allow"
        rows.append((texts[u], None if allowed and asides[texts[u]] else allowed))
    ratios = {}

    def score(text):
        padded = "\u0002" * urls.ORDER + text + "\u0003"
        grams = [padded[i : i + urls.ORDER + 1] for i in range(len(padded) - urls.ORDER)]
        for g in grams:
            if g not in ratios:
                ratios[g] = brute_ratio(rows, g)
        return sum(ratios[g] for g in grams) / len(grams)

    held = sorted(score(texts[u]) for u in pages if ruled[u] == "allow" and asides[texts[u]])
    assert held
    got = {r.page_id: r for r in urls.judge(df).collect()}
    threshold = held[max(0, int(np.ceil(urls.LOSS * len(held))) - 1)]
    for n, u in enumerate(pages):
        assert got[n].score == pytest.approx(score(texts[u]))
        want = ruled[u] or ("block" if score(texts[u]) < threshold - 1e-9 else "allow")
        assert got[n].verdict == want or abs(score(texts[u]) - threshold) < 1e-9


def test_a_url_of_many_characters(spark):
    df = spark.createDataFrame([(1, "http://a.com/" + "ab" * 150_000), (2, "x://" + "é" * 50_000), (3, "http://b.net/fr/")], "page_id long, url string")
    began = time.time()
    assert urls.judge(df).count() == 3 and time.time() - began < 60
