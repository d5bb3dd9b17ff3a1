import math
import re
from collections import Counter

import pandas as pd
import pytest

from tidemark.llm import urls as U
from tidemark.llm.queries import op4_urls


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    return re.sub("[A-Z]", lambda x: x[0].lower(), host), path


def rule(host, path):
    fits = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=(None, "", ""))


def test_whole_table(spark, sf_dir):
    got = op4_urls(spark, sf_dir).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    assert len(got) == len(pages)
    for i, u in zip(pages.page_id, pages.url, strict=True):
        host, path = parts(u)
        assert (got.host[i], got.path[i]) == (host, path)
        verdict, *text = rule(host, path)
        assert got.rule[i] == ("".join(text) or None)
        assert got.verdict[i] == verdict or verdict is None and got.verdict[i] in ("allow", "block")
    assert set(got.verdict) == {"allow", "block"}


def brute_ratio(rows, gram):
    p = {}
    for flag in (True, False):
        n = Counter()
        for text, accepted in rows:
            if accepted == flag:
                padded = "\u0002" * U.ORDER + text + "\u0003"
                for i in range(U.ORDER, len(padded)):
                    for k in range(U.ORDER + 1):
                        n["g", padded[i - k : i + 1]] += 1
                        n["c", padded[i - k : i]] += 1
        q = U.FLOOR
        for k in range(U.ORDER + 1):
            q = (n["g", gram[U.ORDER - k :]] + U.BACKOFF * q) / (n["c", gram[U.ORDER - k : U.ORDER]] + U.BACKOFF)
        p[flag] = q
    return math.log(p[True]) - math.log(p[False])


@pytest.mark.parametrize("small", [True, False])
def test_model_and_score(spark, small, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_ROWS", 100_000 if small else 0)
    rows = [("a.com/x", True), ("a.com/yy", True), ("b.net/x", False), ("", False), ("c.com/", None)]
    df = spark.createDataFrame(rows, "text string, accepted boolean")
    model = U.fit(df)
    ratios = {r.gram: r.ratio for r in model.collect()}
    for gram in ratios:
        assert ratios[gram] == pytest.approx(brute_ratio(rows, gram))
    scores = {r.text: r.score for r in U.score(df, model).collect()}
    padded = "\u0002" * 3 + "c.com/" + "\u0003"
    want = [ratios[padded[i : i + 4]] for i in range(len(padded) - 3)]
    assert scores["c.com/"] == pytest.approx(sum(want) / len(want)) and len(scores) == 5


def test_odd_rows(spark):
    urls = [None, "", "nothing", "://", "HTTP://Example.COM", "http://Example.com/en/", "http://www.EXAMPLE.com/en/?q#f", "x://a.net/fr/", "x://anet/fr/", "x://a.net?/fr/", "x://y://z.com/", "x://é.com/é\n#", "u" * 5000, None]
    df = spark.createDataFrame([(None if i == 3 else i, u, "h", "p", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, score int")
    got = {r.page_id: r for r in U.judge(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        r = got[None if i == 3 else i]
        assert (r.host, r.path) == parts(u)
        assert r.rule == ("".join(rule(*parts(u))[1:]) or None) and r.verdict in ("allow", "block")
    assert U.judge(df.limit(0)).count() == 0
