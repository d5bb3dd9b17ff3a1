import hashlib
import re

import pandas as pd

from tidemark.llm import secrets as S
from tidemark.llm.queries import op1_secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{S.BASE_KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_whole_table(spark, sf_dir):
    got = op1_secrets(spark, sf_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        base = brute(t)
        assert got.base_sha256[i] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got.spans[i].split(","))
    assert got.n_assign.sum() and (got.spans != "").sum()


def test_hard_texts():
    hard = ["secretoken=abcdefg", "token=abc token: 'abcdef'", "TOKEN  =  ABCDEFGH", "ABCDabcdef0123456789abcdef01", "AKIAAKIA" + "A" * 12, "passwordpassword==xxxxxx", "api_key:secret=abcdef", "ſecret=abcdefg", "\U0001f600" * 3 + "apikey='0123456789abcdef0123456789'", "token=" * 5, "f" * 23, "f" * 24, "Token\x20" * 9 + "= zzzzzz", "a" * 30 + "G" + "b" * 30]
    for t in hard:
        base = [f"{k}:{s}:{e}" for s, e, k in S.find(t) if k in S.BASE_KINDS]
        assert ",".join(base) == brute(t), t


def test_checksums_and_odd_rows(spark, odd, nothing):
    body = "abcdefghijABCDEFGHIJ0123456789"
    good, bad = f"x ghp_{body}{S.checksum62(body)} y", f"x ghp_{body}000000 y"
    assert [k for *_, k in S.find(good)] == ["github"] and not S.find(bad)
    rows = {(r.doc_id, len(r.secrets)) for r in S.scan_secrets(odd).collect()}
    assert (1, 0) in rows and (2, 0) in rows and (10, 1) in rows
    assert S.secret_report(odd).count() == 13 and S.secret_report(nothing).count() == 0
    clean = {r.doc_id: r.text for r in S.redact_secrets(odd).collect()}
    assert clean[1] is None and clean[10].endswith("[secret]\"") and clean[4] == "one two"
