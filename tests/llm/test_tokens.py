import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bitpack as B
from tidemark.llm import packing as P
from tidemark.llm.queries import op5_packing, op9_bitpack, vocabulary
from tidemark.llm.tokens import Encoder

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


@lru_cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(path, texts, end):
    t = library(path)
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_apart_are_the_same_ids(path, monkeypatch):
    own = Encoder(path)
    texts = [None, "", " ", "  ", "a  b", " a b ", "a\n b", "a \n\n b\t", "it's 'tis I'll", "x  y", "e ́a", "  z", "don 't <|endoftext|> <|startoftext|>x", "ünï ΣΑΣ İstanbul", "9 99 9,9", "a\x1c b \x1cc", "\r\n x", "漢 字 \U0001f600 \U0001f600"]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=" \n\t'sta1.É́  漢", max_size=20), max_size=4))
    def same(more):
        ids, ends = own.encode(more)
        for i, want in enumerate(plain(path, more, 7)):
            assert ids[ends[i] : ends[i + 1]].tolist() == want[:-1].tolist(), more[i]

    same()
    assert own.cut is not None

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="".join(map(chr, range(32, 384))) + "\n  ", max_size=30), max_size=4))
    def same_latin(more):
        ids, ends = own.encode(more)
        for i, want in enumerate(plain(path, more, 7)):
            assert ids[ends[i] : ends[i + 1]].tolist() == want[:-1].tolist(), more[i]

    same_latin()
    monkeypatch.setattr(Encoder, "MOST_WORDS", 3)
    for part in (texts[:7], texts[7:], texts):
        ids, ends = own.encode(part)
        for i, want in enumerate(plain(path, part, 7)):
            assert ids[ends[i] : ends[i + 1]].tolist() == want[:-1].tolist(), part[i]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_bits_round_trip(bits, ids):
    ids = np.array(ids, np.uint64) % np.uint64(1 << bits)
    assert B.unpack(B.pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()
    assert len(B.pack(ids, bits)) == -(-len(ids) // 8) * bits


def test_random_access(monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 16)
    ids = np.arange(1000, dtype=np.uint32)
    file = B.Reader(B.to_file(ids, np.array([0, 5, 5, 700, 1000]), np.array([3, 4, 5, 0]), np.array([1, 1, 1, 0]), B.bits_for(1000), 2, 1))
    assert file.bits == 10 and file.document(2).tolist() == list(range(5, 700)) and file.document(1).tolist() == []
    assert file.read(31, 33).tolist() == [31, 32]


def check_files(got, docs):
    docs = docs.sort_values(["doc_id"], kind="stable")
    want = plain(BYTE, docs.text, 0)
    got = got.sort_values("start")
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.n_tokens.tolist() == [len(w) for w in want]
    assert got.start.tolist() == np.cumsum([0, *got.n_tokens])[:-1].tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(w.tobytes()) for w in want]


def test_files(spark, sf_dir, odd, nothing, monkeypatch):
    check_files(op9_bitpack(spark, sf_dir).toPandas(), pd.read_parquet(f"{sf_dir}/documents.parquet"))
    check_files(B.token_files(odd, BYTE).toPandas(), odd.toPandas())
    assert B.token_files(nothing, BYTE).count() == 0


def test_leftovers_of_other_attempts_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    folder = f"file://{tmp_path}/ids"
    manifest = B.write_ids(docs, folder, BYTE, 0)
    B.write_ids(docs.limit(7), folder, BYTE, 0)
    check_files(B.read_ids(spark, folder, manifest).toPandas(), docs.toPandas())


def check_pieces(got, docs, size=P.SEQUENCE):
    want = dict(zip(docs.doc_id, plain(WORD, docs.text, 1), strict=True))
    for r in got.itertuples():
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    copies = docs.doc_id.value_counts()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(w) * copies[i] for i, w in want.items()}
    ordered = got.sort_values(["sequence_id", "offset"])
    end = (ordered.sequence_id * size + ordered.offset).to_numpy()
    assert end.tolist() == np.cumsum([0, *ordered.length])[:-1].tolist()
    assert (ordered.offset + ordered.length).max() <= size


def test_packing(spark, sf_dir, odd, nothing):
    check_pieces(op5_packing(spark, sf_dir).toPandas(), pd.read_parquet(f"{sf_dir}/documents.parquet"))
    got = P.pack_documents(odd, WORD, 1)
    check_pieces(got.drop("ids").toPandas(), odd.toPandas())
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got.collect())
    assert P.packing_report(nothing, WORD).count() == 0


def test_curve_visits_neighbours():
    n, bits = 2, 4
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
    key = P.hilbert_key(grid, bits)
    assert sorted(key) == list(range(1 << bits * n))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()
