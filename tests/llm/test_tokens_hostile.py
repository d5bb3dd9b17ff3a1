"""Ids are the library's on texts with line breaks, doubled spaces, control characters and special tokens."""

import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm.queries import vocabulary
from tidemark.llm.tokens import Encoder


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_hostile_texts(name, monkeypatch):
    monkeypatch.setattr(Encoder, "MOST_WORDS", 3000)
    library, own, rng = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name)), random.Random(3)
    signs = ("\n\n \t ab1.,!<|>'\"\x00\x01\x02\x03\x1c\x85é́Σ漢İ  \r", "a \n.", "Ab é\n\n12 -", "\n x")
    texts = ["".join(rng.choice(signs[n % 4]) for _ in range(rng.randrange(14))) for n in range(20_000)] + ["x<|endoftext|>\ny <|endoftext|> z", "<|ENDOFTEXT|>", "one\n\ntwo\nthree\n", "\n\n", "a\n\n\nb", "word " * 50_000]
    for at in range(0, len(texts), 1500):
        some = texts[at : at + 1500]
        ids, ends = own.encode(some)
        for i, e in enumerate(library.encode_batch(some, add_special_tokens=False)):
            assert ids[ends[i] : ends[i + 1]].tolist() == e.ids, some[i][:80]
