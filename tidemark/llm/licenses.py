"""License scans: exact seeds of split notices locate candidates, bounded-error matching verifies them and reports spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, buffers, folded, lowered, pieces, word_bounds

# The phrases whose words must stand consecutively, and short notices with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under the apache license, version 2.0": "apache",
    "licensed under the gnu general public license, version 3": "gpl",
    "licensed under cc by-nc 4.0": "cc-by-nc",
    "licensed under cc by-sa 4.0": "cc-by-sa",
    "redistribution and use in source and binary forms, with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
}
#: A notice of n characters may differ by n // PER_ERROR insertions, deletions and substitutions.
PER_ERROR = 12
_OUT = "found array<struct<start:int,end:int,label:string,edits:int>>, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, similarity double"


def split_notice(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than errors allowed: at least one of them stands unharmed in any match."""
    n = len(notice) // PER_ERROR + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Prepared:
    """Notices with their labels, the seeds of all in one automaton, and an expression for each that bears its errors."""

    labels: dict[str, str]
    seeds: ahocorasick.Automaton
    verifiers: dict[str, regex.Pattern]


@lru_cache(maxsize=8)
def prepared(notices: tuple[tuple[str, str], ...] = tuple(NOTICES.items())) -> Prepared:
    """For (notice, label) pairs. A-Z is lowered as in the texts; of notices equal after that the last label counts."""
    labels = {lowered(notice): label for notice, label in notices}
    if "" in labels:
        raise ValueError("a notice must not be empty")
    at: dict[str, list[tuple[str, int]]] = {}
    for notice in labels:
        for start, piece in split_notice(notice):
            at.setdefault(piece, []).append((notice, start))
    seeds = ahocorasick.Automaton()
    for piece, places in at.items():
        seeds.add_word(piece, (len(piece), tuple(places)))
    if at:
        seeds.make_automaton()
    bearing = lambda n: regex.compile(f"(?b)(?:{regex.escape(n, special_only=False, literal_spaces=True)}){{e<={len(n) // PER_ERROR}}}")
    return Prepared(labels, seeds, {n: bearing(n) for n in labels})


def fuzzy(text: str, notices: Prepared | None = None) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of notices in a lower-cased text, in code points; no two of a notice overlap.

    Every seed asks for the best match in a window of its notice's own length, so the work is in proportion to the seeds. Of
    matches of a notice that overlap, those with fewer edits stay, then earlier ones. Seeds inside a match without any edit
    are part of it and ask nothing. Without notices of its own it finds those of NOTICES.
    """
    notices = notices or prepared()
    if not notices.labels:
        return []
    got: dict[str, set[tuple[int, int, int]]] = {}
    exact: dict[str, int] = {}
    asked: dict[str, tuple[int, int]] = {}
    for last, (length, places) in notices.seeds.iter(text):
        for notice, start in places:
            slack = len(notice) // PER_ERROR
            begin = last - length + 1
            low = max(0, begin - start - slack)
            window = (low, min(len(text), begin - start + len(notice) + 2 * slack))
            if begin < exact.get(notice, 0) or asked.get(notice) == window:
                continue
            asked[notice] = window
            if match := notices.verifiers[notice].search(text, *window):
                edits = sum(match.fuzzy_counts)
                got.setdefault(notice, set()).add((edits, match.start(), match.end()))
                if not edits:
                    exact[notice] = match.end()
    out = set()
    for notice, found in got.items():
        starts: list[int] = []
        ends: list[int] = []
        for edits, start, end in sorted(found):
            at = bisect_left(starts, start)
            if (at and ends[at - 1] > start) or (at < len(starts) and starts[at] < end):
                continue
            starts.insert(at, start)
            ends.insert(at, end)
            out.add((start, end, notices.labels[notice], edits))
    return sorted(out)


@lru_cache(maxsize=1)
def phrase_patterns() -> dict[str, re.Pattern]:
    word, gap = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
    return {p: re.compile(rb"(?<!" + word + rb")" + gap.join(map(str.encode, p.split())) + rb"(?!" + word + rb")") for p in PHRASES}


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema, notices: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    own_notices = prepared(notices)
    for batch in pieces(batches, "_text"):
        column = batch.column(batch.schema.get_field_index("_text"))
        data, ends = buffers(column)
        data = folded(data)
        starts, _, first = word_bounds(data, ends, WORD)
        raw = data.tobytes()
        rows: dict[str, list] = {n: [] for n in schema.names if n not in batch.schema.names}
        for i in range(batch.num_rows):
            own = raw[ends[i] : ends[i + 1]]
            places, labels = [], set()
            if b"license" in own:
                for phrase, pattern in phrase_patterns().items():
                    if at := [m.start() for m in pattern.finditer(own)]:
                        places += at
                        labels.add(PHRASES[phrase])
            found = fuzzy(own.decode("utf-8", "surrogatepass"), own_notices)
            where = np.searchsorted(starts, ends[i] + np.array([min(places), max(places)])) - first[i] if places else (None, None)
            rows["found"].append([dict(zip(("start", "end", "label", "edits"), x, strict=True)) for x in found])
            rows["n_words"].append(int(first[i + 1] - first[i]))
            rows["n_base"].append(len(places))
            rows["first_word"].append(where[0])
            rows["last_word"].append(where[1])
            rows["base_labels"].append(sorted(labels))
            rows["similarity"].append(max([float(bool(places)), *(1 - edits / (end - start) for start, end, _, edits in found)]))
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_text"]).columns, *(pa.array(rows[n], schema.field(n).type) for n in rows)], schema=schema)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """The key with what each whole text holds: fuzzy notices (spans in code points), phrase places, words, labels, similarity.

    notices maps what to look for, of any number, to its label; an empty text among them is a ValueError. Map-only. Null and empty texts have no words and no notices (similarity 0); first_word and last_word are null without
    a phrase; repeated rows are judged alike, null keys pass through; no other column is read, so none can clash.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    asked = tuple(notices.items())
    prepared(asked)  # a bad notice fails here, not in tasks
    out = StructType([StructField(key, docs.schema[key].dataType), *_parse_datatype_string(_OUT)])
    schema = to_arrow_schema(out)
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(lambda batches: _scan(batches, schema, asked), out)


def license_report(docs: DataFrame, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """doc_id, word and phrase counts, labels and the best similarity; from scan_licenses(), which says what odd rows, ties and
    empty tables give."""
    everything = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("found", lambda x: x["label"]))))
    return scan_licenses(docs, notices=notices).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", everything).alias("labels"), F.col("similarity").alias("score"))
