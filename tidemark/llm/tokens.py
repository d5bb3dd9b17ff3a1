"""Token ids of whole texts by the tokenizers library, each distinct word of a worker being encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space of any kind, for a character class.
_SPACES = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: What opens a word behind a line break, the first word of a text, and what stands for two line breaks between words.
_BREAK, _FIRST, _BREAKS = "\x01", "\x02", "\x03"
#: Texts that vocabularies that keep white space get whole: spaces meet (but for two line breaks between words).
_MET = f"[{_SPACES}{_BREAKS}][{_SPACES}{_BREAKS}]|{_BREAKS}\\z"
#: Texts that vocabularies that drop white space get whole: separators that are no white space to them, special tokens.
_ODD = "[\\x1c-\\x1f]|<\\|"
#: Letters that every rule below treats alike: no normalisation changes them, and their lower case stays among them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
#: Words of these letters, digits and such signs as begin no contraction and no special token.
_PLAIN = f"^[{_LETTERS}0-9!#-&(-/:;=?@\\[-`{{-~]+$"
# How the two kinds of vocabulary cut such words, and the rule of the second as its own file has it.
_CUTS = {
    "kept": re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+"),
    "dropped": re.compile(f"[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+|\n"),
}
_DROPS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words that the library gets as one text.
_TOGETHER = 256


def _byte_letters() -> str:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from code point 256 on; _BREAK parts words."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    out = [chr(b) if b in kept else chr(256 + rest.index(b)) for b in range(256)]
    out[ord(_BREAK)] = " "
    return "".join(out)


class Encoder:
    """Texts to ids. No token reaches over the white space between words, so words are encoded apart and remembered.

    Arrow splits the texts and finds each batch's distinct words; those not met before go to the library, many in one text.
    Plain words are cut here and go to the library's model alone: their tokens show where each begins or ends. Others are
    parted by a character whose token nothing else gives. What is remembered is bounded by MOST_WORDS and MOST_CHARS; beyond
    these, words of one batch alone are forgotten (all, if still too many), with the same results.
    """

    MOST_WORDS, MOST_CHARS = 800_000, 1 << 24

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        #: What the vocabulary does with white space; None if its rules are others: then texts go whole.
        self.cut = self._rules(json.loads(self.tokenizer.to_str()))
        self.parting = "\n" if self.cut == "kept" else "\x00"
        mark = self.tokenizer.encode(self.parting, add_special_tokens=False).ids
        if len(mark) != 1:
            self.cut = None
        self.mark = mark[0]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.begins_word, self.ends_word = np.zeros((2, self.vocabulary), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins_word[i], self.ends_word[i] = token.startswith(self.space), token.endswith("</w>")
        self._keep(np.zeros(0, np.int64))

    @staticmethod
    def _rules(own: dict) -> str | None:
        pre, normal = own["pre_tokenizer"] or {}, own["normalizer"]
        first, *last = pre.get("pretokenizers", [pre])
        level = last[0] if last else first
        if own["model"]["type"] != "BPE" or level.get("type") != "ByteLevel" or level["add_prefix_space"] or len(last) > 1:
            return None
        if not last and normal is None and level["use_regex"]:
            return "kept"
        steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
        known = last and first.get("type") == "Split" and first["pattern"].get("Regex") == _DROPS
        if known and (first["behavior"], first["invert"], level["use_regex"]) == ("Removed", True, False) and steps == ["NFC", "Replace", "Lowercase"]:
            return "dropped"
        return None

    def _keep(self, some: np.ndarray) -> None:
        """Forgets all words but these."""
        old = self.begins[some] if len(some) else some
        lengths = self.lengths[some] if len(some) else some
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.ids = self.ids[np.repeat(old - at[:-1], lengths) + np.arange(at[-1])] if len(some) else np.zeros(0, np.uint32)
        self.known = self.known.take(pa.array(some)) if len(some) else pa.array([], pa.string())
        self.begins, self.lengths, self.batches = at[:-1], lengths, np.zeros(len(some), np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        """Each text by the library as it is."""
        return [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def _spelt(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def _learn(self, fresh: pa.Array) -> None:
        """Remembers the ids of these words, as numbers behind those known."""
        begins, lengths = np.zeros((2, len(fresh)), np.int64)
        got, size = [self.ids], len(self.ids)
        kept = self.cut == "kept"
        opens = pc.match_substring_regex(fresh, f"^[{_BREAK}{_FIRST}]").to_numpy(zero_copy_only=False) if kept else np.zeros(len(fresh), bool)
        words = pc.if_else(pa.array(opens), pc.utf8_slice_codeunits(fresh, 1), fresh) if kept else fresh
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        ascii = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        hard: list[int] = []

        def put(group: np.ndarray, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
            nonlocal size
            begins[group], lengths[group] = size + start, stop - start
            got.append(ids)
            size += len(ids)

        def groups(which: np.ndarray, between: str) -> tuple[list[np.ndarray], list[str]]:
            at = np.flatnonzero(which)
            own = [at[i : i + _TOGETHER] for i in range(0, len(at), _TOGETHER)]
            ends = np.minimum(np.arange(len(own) + 1) * _TOGETHER, len(at))
            return own, pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(at))), between).to_pylist()

        cut = _CUTS[self.cut].findall
        for simple in (True, False):
            own, texts = groups(plain & ~opens & (ascii == simple), " " if kept else "\n")
            if kept:
                texts = [_BREAK.join(cut(" " + t)) for t in texts]
                texts = [t.replace(" ", self.space).replace(_BREAK, " ") if simple else self._spelt(t) for t in texts]
                for g, e in zip(own, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, np.uint32)
                    start = np.flatnonzero(self.begins_word[ids])
                    put(g, ids, start, np.append(start[1:], len(ids))) if len(start) == len(g) else hard.extend(g)
            else:
                parts = [cut(t.lower() + "\n") for t in texts]
                ends = [np.flatnonzero(np.fromiter((p == "\n" for p in part), bool, len(part))) - np.arange(len(g)) for g, part in zip(own, parts, strict=True)]
                texts = [" ".join([p for p in part if p != "\n"]) if simple else self._spelt(_BREAK.join([p for p in part if p != "\n"])) for part in parts]
                for g, end, e in zip(own, ends, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, np.uint32)
                    stop = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
                    if len(stop) == end[-1] + 1:
                        put(g, ids, stop[np.append(0, end[:-1])], stop[end])
                    else:
                        hard.extend(g)
        # every other word has the parting character before it; those behind a line break keep it as their own
        spaced = pc.match_substring_regex(words, f"^$|[{_SPACES}\\x00]").to_numpy(zero_copy_only=False)
        before = "\n" if kept else f" {self.parting} "
        broken = (pc.starts_with(fresh, _BREAK).to_numpy(zero_copy_only=False) & kept).astype(np.int64)
        for which, lead in ((plain & opens, before), (~plain & opens & ~spaced, before), (~plain & ~opens & ~spaced, before + " " if kept else before)):
            own, texts = groups(which, lead)
            for g, e in zip(own, self.tokenizer.encode_batch_fast([lead + t for t in texts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                at = np.flatnonzero(ids == self.mark)
                put(g, ids, at + 1 - broken[g], np.append(at[1:], len(ids))) if len(at) == len(g) else hard.extend(g)
        hard.extend(np.flatnonzero(spaced & ~plain).tolist())
        texts = [w if o or not kept else " " + w for w, o in zip(words.take(pa.array(hard, pa.int64())).to_pylist(), opens[hard], strict=True)]
        for i, ids in zip(hard, self._library(texts), strict=True):
            put(np.array([i]), np.array([self.mark, *ids], np.uint32), np.array([1 - broken[i]]), np.array([1 + len(ids)]))
        self.ids = np.concatenate(got)
        self.begins, self.lengths = np.concatenate([self.begins, begins]), np.concatenate([self.lengths, lengths])
        self.batches = np.concatenate([self.batches, np.zeros(len(fresh), np.int32)])
        self.known = pa.concat_arrays([self.known, fresh])

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, and where those of each text begin."""
        if self.cut == "kept":
            texts = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts, "\n", f" {_BREAK}"), "")
            split = pc.split_pattern(texts, " ")
        else:
            split = pc.utf8_split_whitespace(pc.ascii_lower(texts))
        ends = split.offsets.to_numpy().astype(np.int64)
        distinct = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        found = pc.index_in(distinct.dictionary, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        number = found.fill_null(0).to_numpy().astype(np.int64)
        number[new] = len(self.known) + np.arange(new.sum())
        if new.any():
            self._learn(distinct.dictionary.filter(pa.array(new)))
        self.batches[number] += 1
        return number[distinct.indices.to_numpy()], ends - ends[0]

    def encode(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each begins (one entry more than texts). Null is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        full = lambda: len(self.known) > self.MOST_WORDS or self.known.nbytes > self.MOST_CHARS
        if full():
            self._keep(np.flatnonzero(self.batches > 1))
            if full():
                self._keep(np.zeros(0, np.int64))
        if self.cut is None:
            whole = np.ones(len(texts), bool)
        elif self.cut == "kept":
            whole = pc.match_substring_regex(texts, f"[{_BREAK}-{_BREAKS}]").to_numpy(zero_copy_only=False)
            whole = whole | pc.match_substring_regex(pc.replace_substring(texts, "\n\n", _BREAKS), _MET).to_numpy(zero_copy_only=False)
        else:
            whole = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(whole)
        alone = self._library(texts.take(pa.array(odd)).to_pylist()) if len(odd) else []
        number, ends = np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        if len(odd) < len(texts):
            number, ends = self._numbered(pc.if_else(pa.array(whole), "", texts) if len(odd) else texts)
        lengths = self.lengths[number]
        total = np.zeros(len(number) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        ids = self.ids[np.repeat(self.begins[number] - total[:-1], lengths) + np.arange(total[-1])]
        begins = total[ends]
        if len(odd):
            sizes = np.array(list(map(len, alone)))
            ids = np.insert(ids, np.repeat(begins[odd], sizes), np.concatenate([np.array(x, np.uint32) for x in alone]))
            more = np.zeros(len(texts) + 1, np.int64)
            more[odd + 1] = sizes
            begins = begins + np.cumsum(more)
        return ids, begins


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)


def with_end(ids: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id end behind each text."""
    return np.insert(ids, ends[1:], np.uint32(end)), ends + np.arange(len(ends))
