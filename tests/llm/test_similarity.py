import random
import re

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import similarity as S
from tidemark.llm.components import connected
from tidemark.llm.queries import op8_jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    where, root = {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        seen = {}
        for g in s:
            for j in where.get(g, ()):
                seen[j] = seen.get(j, 0) + 1
            where.setdefault(g, []).append(i)
        for j, o in seen.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k is None, k or 0, len(sets[i]), -1 if k is None else least[find(i)]) for i, (k, _) in enumerate(rows))


def rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)))
    assert rows(op8_jaccard(spark, sf_dir)) == want and any(w[1] != w[3] for w in want)


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_and_chains(spark, small, monkeypatch):
    if small:
        for name, value in (("TREE_SETS", 12), ("_GATHER", 500), ("_COMMON", 3), ("_BROADCAST", 0), ("_PIECE", 2000)):
            monkeypatch.setattr(S, name, value)
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno") + str(rng.randrange(30))
    passage = [word() for _ in range(60)]
    docs = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([6, 20, 60, 150]))]
        if base % 3 == 0:
            text += passage
        for _ in range(rng.choice([1, 3, 25])):
            docs.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = word()
    docs += ["a b", "A  b", "a\tB", "a", "", None, "a b c d e", "é b c d e", " ".join(passage)] + ["x y " * 40, "y x " * 41, "x y " * 40]
    rng.shuffle(docs)
    data = [(None if i == 5 else i * 3 - 100, t) for i, t in enumerate(docs)]
    data += [data[0], data[1]]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "doc_id long, text string, id int, n int").repartition(3)
    assert rows(S.similar_groups(df)) == brute(data)


def test_bounds_hold():
    n = np.arange(1, 2000)
    least = np.array([-(-75 * int(x) // 100) for x in n])
    assert (S.least_common(n) == least).all()
    for more in (4, 10):
        fewest = np.array([min(min(-(-int(m) // more), int(le)) for m in range(int(le), int(x) + 1)) for x, le in zip(n[:300], least[:300], strict=True)])
        assert (S.needed(n[:300], more) <= np.maximum(fewest, 1)).all()
        assert (S.sent(n, more) - (n - least) >= np.minimum(S.needed(n, more), least)).all()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "u long, v long"))[0].collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(100):
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    assert all(root[x] == c for x, c in got.items()) and {x for u, v in pairs if u != v for x in (u, v)} == set(got)


def test_odd_rows(spark, odd, nothing):
    got = {r.doc_id: r.component_id for r in S.similar_groups(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 11, 12: 12}
    assert S.similar_groups(nothing).count() == 0
    kept = S.one_of_each_group(odd)
    assert kept.columns == odd.columns and kept.count() == 10
