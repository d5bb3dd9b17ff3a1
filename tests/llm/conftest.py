import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, short, repeated and very long texts, and an extra column with a clashing name."""
    long = " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, long), (7, long + " end"), (8, f"a b c {passage} d e"), (9, f"x y {passage} z"), (10, "ünï cödé 漢字 \U0001f600 password = \"abcdef12\""), (10, "ünï cödé 漢字 \U0001f600 password = \"abcdef12\""), (11, "0123456789"), (12, "é" * 300)]
    return spark.createDataFrame([(i, t, "en", None, None, 0, 0) for i, t in rows], DOCS + ", found int, secrets int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
