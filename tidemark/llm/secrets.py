"""Secret scans: an Aho-Corasick pass finds keywords, anchored regular expressions run only at its hits, checksums confirm."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, unused

# The kinds in their order, the keywords of assignments, and the prefixes of tokens with embedded checksums.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm")
KINDS = BASE_KINDS + CHECKED_KINDS
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_PREFIXES = ("npm_",)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
_SEED = 4


def checksum62(body: str) -> str:
    """The six base-62 digits that such tokens carry: crc32 of the random part."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Keywords in lower case, each with the kinds it may begin.

    A run of hexadecimal digits has no keyword; every four of its digits are one, so its first hit is its start.
    """
    kinds: dict[str, tuple[str, ...]] = {}
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", GITHUB_PREFIXES), ("npm", NPM_PREFIXES), ("hex", map("".join, itertools.product("0123456789abcdef", repeat=_SEED)))):
        for word in words:
            kinds[word] = (*kinds.get(word, ()), kind)
    out = ahocorasick.Automaton()
    for word, found in kinds.items():
        out.add_word(word, (len(word), found))
    out.make_automaton()
    return out


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in code points, ordered by start, then kind. Null and empty texts have none."""
    if not text:
        return []
    low = lowered(text)
    past = dict.fromkeys(KINDS, 0)
    out = []
    # no keyword of a kind lies in another of that kind, so the hits of a kind come in the order of their starts
    for start, kind in ((end - length + 1, kind) for end, (length, kinds) in automaton().iter(low) for kind in kinds):
        if start < past[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(low, start)
            good = match and len(match[2]) >= SHORTEST[kind]
        elif kind == "access":
            match = ACCESS.match(text, start)
            good = match and match.end() - start >= SHORTEST[kind]
        elif kind == "hex":
            match = HEX.match(text, start)
            good = match and match.end() - start >= SHORTEST[kind]
        else:
            match = CHECKED.match(text, start)
            good = match and checksum62(match[1]) == match[2]
        if match:
            past[kind] = match.end()
            if good:
                out.append((start, match.end(), kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with one more column: array<struct<start, end, kind, value>> of the secrets in each whole text.

    Map-only: no shuffle. A null or empty text has an empty array; repeated rows are judged alike; a column already named
    like the new one is replaced; other columns pass through untouched.
    """

    @F.pandas_udf("array<struct<start:int,end:int,kind:string,value:string>>")
    def secrets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"start": s, "end": e, "kind": k, "value": t[s:e]} for s, e, k in find(t)] for t in batch], dtype=object)

    return docs.withColumn(into, secrets(F.col(f"`{text}`")))


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every secret in the text replaced by mask; overlapping spans become one. Null stays null."""

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                parts, at = [], 0
                for start, end, _ in find(t):
                    if start >= at:
                        parts += [t[at:start], mask]
                    at = max(at, end)
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, redact(F.col(f"`{text}`")))


def redact_documents(docs: DataFrame) -> DataFrame:
    """redact_secrets() for documents with n_chars, which becomes the new length of texts that changed.

    Null and empty texts stay as they are, repeated rows are masked alike, no rows give none; all other columns pass, whatever
    their names.
    """
    names, before = docs.columns, unused(docs, "before")
    masked = redact_secrets(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(F.col(f"`{c}`") for c in names))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans; from scan_secrets()."""

    def digest(kinds: tuple[str, ...]):
        kept = F.filter("_found", lambda x: x["kind"].isin(*kinds))
        return F.concat_ws(",", F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    found = scan_secrets(docs.select("doc_id", "text"), into="_found")
    count = lambda kind: F.size(F.filter("_found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(digest(BASE_KINDS), 256).alias("base_sha256"), digest(KINDS).alias("spans"))
