"""Biases of co-occurrence from sums of parts against those from joined cells."""

import pytest

from tidemark.operators import cooccurrence, factors


def vectors(spark, by):
    return spark.createDataFrame([(i, [((i * by * (k + 1)) % 7) / 7 - 0.3 for k in range(3)]) for i in range(13)], "itemid long, vec array<double>")


@pytest.mark.parametrize("a_part", [1 << 22, 20])
def test_parts_give_the_biases_of_joined_cells(spark, monkeypatch, a_part):
    monkeypatch.setattr(cooccurrence, "PAIRS_A_PART", a_part)
    likes = spark.createDataFrame([(u, i) for u in range(20) for i in range(12) if (u * i + u + i) % 5 < 2], "userid long, itemid long")
    q, z = vectors(spark, 2), vectors(spark, 3)
    for negatives in (1.0, 1.1):
        cells = factors.residuals(cooccurrence.sppmi_of(likes, negatives), q, z)
        none = spark.createDataFrame([], "j long, bias double")
        b = factors.item_bias(cells, none, 0.1, "i", "j")
        d = factors.item_bias(cells, b, 0.1, "j", "i")
        got = factors.biases(likes, q, z, 0.1, negatives)
        for mine, want in ((got[0], b), (got[1], d), (factors.biases(likes, q, z, 0.1, negatives, contexts=False)[0], b)):
            mine, want = (sorted((r[0], round(r[1], 9)) for r in x.collect()) for x in (mine, want))
            assert mine == want and mine
        assert got[2] == pytest.approx(factors.global_bias(cells, b, d), abs=1e-9)
    assert factors.biases(likes.where("false"), q, z, 0.1)[0].count() == 0


def test_pairs_are_shuffled_once(spark):
    likes = spark.createDataFrame([(u, i) for u in range(9) for i in range(9) if (u + i) % 3], "userid long, itemid long")
    parts = cooccurrence.Parts.of(likes)
    work = lambda pairs, items: pairs.select(["i", "j", "n"])
    met = parts.meet(parts.pairs, likes.select("itemid").distinct(), work, "i long, j long, n long")
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, cooccurrence.half_counts(likes).collect()))
    plan = met._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    assert sum("Exchange hashpartitioning(part" in x for x in plan.splitlines()) == 2  # pairs, before they are counted, and items
