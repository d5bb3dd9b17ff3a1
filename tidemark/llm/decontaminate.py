"""Benchmark decontamination: winnowed fingerprints of benchmark and documents meet, hits are extended word by word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, buffers, folded, lists, pieces, spans_hash, word_bounds, written

#: Words of a window that counts as leaked, words hashed together, and positions among which the least hash is kept:
#: KGRAM + WINNOW - 1 = WINDOW, so any shared span of WINDOW words holds a kept k-gram.
WINDOW, KGRAM, WINNOW = 13, 5, 9
#: Bytes of benchmark text that are broadcast. A larger benchmark is joined by fingerprints.
BLOCK_BYTES = 32 << 20
#: Bytes of text hashed at a time; a task holds about 60 times as much.
_PIECE = 2 << 20
_HIT = "_key long, _same long, n_words long, spans array<struct<s:int,e:int>>, items array<long>"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a string column, and each row's first word."""
    data, ends = buffers(column)
    data = folded(data)
    starts, stops, first = word_bounds(data, ends, WORD)
    return spans_hash(data, starts, stops), first


def winnowed(words: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the k-grams that are the least of some window of consecutive ones within a row; the last of equal ones.

    Rows with fewer than k + window - 1 words keep none.
    """
    n = len(words) - k + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n)
    grams = spans_hash(words, at, at + k)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)[::-1]
    least = at[: n - window + 1] + window - 1 - view.argmin(axis=1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row[: n - window + 1] == row[k + window - 2 :]
    kept = np.unique(least[inside])
    return grams[kept], kept


@dataclass(frozen=True)
class Benchmark:
    """A block of items: kept fingerprints, and by length of window the (hash, item row) of all windows; both in order."""

    item_ids: np.ndarray
    prints: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray]]


def prepare(item_ids: list[int], texts: pa.Array) -> Benchmark:
    words, first = words_of(texts)
    lengths = np.diff(first)
    windows = {}
    for n in sorted({*np.minimum(lengths, WINDOW).tolist()} - {0}):
        rows = np.flatnonzero((lengths == n) | ((lengths > n) & (n == WINDOW)))
        row = np.repeat(rows, lengths[rows] - n + 1)
        at = np.concatenate([np.arange(first[r], first[r + 1] - n + 1) for r in rows])
        both = np.unique(np.rec.fromarrays([spans_hash(words, at, at + n), row], names="hash,row"))
        windows[n] = (both["hash"].copy(), both["row"].copy())
    return Benchmark(np.array(item_ids, np.int64), np.unique(winnowed(words, first, KGRAM, WINNOW)[0]), windows)


def known(a: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of a are in the ordered array."""
    if not len(ordered):
        return np.zeros(len(a), bool)
    return ordered[np.minimum(np.searchsorted(ordered, a), len(ordered) - 1)] == a


def leaks(words: np.ndarray, first: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words' leaked windows, and (row, item row) of each item that a row holds a window of.

    A kept fingerprint that the benchmark kept too is extended over the windows that hold it; items shorter than a window are
    looked up whole.
    """
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts, lengths, pairs = [], [], []
    for n, (hashes, items) in bench.windows.items():
        if n == WINDOW:
            prints, places = winnowed(words, first, KGRAM, WINNOW)
            hit = places[known(prints, bench.prints)]
            at = np.unique((hit[:, None] - np.arange(WINDOW - KGRAM + 1)).ravel())
            at = at[(at >= 0) & (at + n <= len(words))]
        else:
            at = np.arange(max(0, len(words) - n + 1))
        at = at[row[at] == row[at + n - 1]]
        found = spans_hash(words, at, at + n)
        ok = known(found, hashes)
        at, found = at[ok], found[ok]
        starts.append(at)
        lengths.append(np.full(len(at), n))
        each = np.unique(np.rec.fromarrays([row[at], found], names="row,hash"))
        low, high = np.searchsorted(hashes, each["hash"], "left"), np.searchsorted(hashes, each["hash"], "right")
        count = high - low
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs.append(np.stack([np.repeat(each["row"], count), items[np.repeat(low, count) + within]], axis=1))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    pair = np.unique(np.concatenate(pairs), axis=0)
    return np.concatenate(starts), np.concatenate(lengths), pair[:, 0], pair[:, 1]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans with overlapping ones joined; adjacent ones stay apart."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] >= end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(end)) - 1] if len(at) else end


def _scan(bench):
    span = pa.struct([("s", pa.int32()), ("e", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Benchmark = bench.value
        for batch in pieces(batches, "_text", _PIECE):
            words, first = words_of(batch.column(1))
            start, length, row, item = leaks(words, first, own)
            start, end = merged(start, start + length)
            base = first[np.searchsorted(first, start, "right") - 1]
            rows = np.arange(batch.num_rows + 1)
            spans = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], fields=list(span))
            row, ids = np.unique(np.stack([row, own.item_ids[item]], axis=1), axis=0).T  # an id of several items counts once
            out = [batch.column(0), batch.column(2), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first), pa.int32()), spans), lists(ids, np.searchsorted(row, rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["_key", "_same", "n_words", "spans", "items"])

    return scan


#: Stands for a null item id in blocks; no list of ids holds it.
NAMELESS = -(1 << 63)


#: Bits of the filter that tells a document's task which hashes the benchmark may hold, and the parts among which the rows of one
#: hash are dealt when it is joined.
FILTER_BITS, SALTS = 1 << 27, 16


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of items (item, _text): their kept fingerprints (n = 0), and all windows (n words, hash, item). A short item is its own print."""
    for batch in pieces(batches, "_text", _PIECE):
        own = prepare(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))
        prints = np.concatenate([own.prints, *(np.unique(h) for n, (h, _) in own.windows.items() if n < WINDOW)])
        parts = [(np.zeros(len(prints), np.int32), prints, np.full(len(prints), NAMELESS))]
        parts += [(np.full(len(h), n, np.int32), h, own.item_ids[row]) for n, (h, row) in own.windows.items()]
        n, hashes, items = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(hashes.view(np.int64)), pa.array(items)], names=["n", "hash", "item"])


def _filter(prints: DataFrame) -> np.ndarray:
    """One bit for each value of a hash's low bits, as bytes; Spark puts it together, 16 MB reach the driver at most."""
    at = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    rows = prints.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _candidates(shared, lengths: list[int]):
    """Per document: its words, and of each place whose print and window may be the benchmark's the print, 16 * place + length, and
    the window's hash."""
    kind = pa.struct([("p", pa.int64()), ("c", pa.int64()), ("h", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def maybe(h: np.ndarray) -> np.ndarray:
            low = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)

        for batch in pieces(batches, "_text", _PIECE):
            words, first = words_of(batch.column(1))
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for n in lengths:
                if n == WINDOW:
                    prints, places = winnowed(words, first, KGRAM, WINNOW)
                    ok = maybe(prints)
                    at = (places[ok][:, None] - np.arange(WINDOW - KGRAM + 1)).ravel()
                    prints = np.repeat(prints[ok], WINDOW - KGRAM + 1)
                    inside = (at >= 0) & (at + n <= len(words))
                    at, prints = at[inside], prints[inside]
                else:
                    at, prints = np.arange(max(0, len(words) - n + 1)), None
                same = row[at] == row[at + n - 1]
                at = at[same]
                h = spans_hash(words, at, at + n)
                ok = maybe(h)
                found.append((h[ok] if prints is None else prints[same][ok], at[ok], h[ok], np.full(ok.sum(), n)))
            p, at, h, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            p, at, h, n = p[order], at[order], h[order], n[order]
            code = (at - first[row[at]]) * 16 + n
            flat = pa.StructArray.from_arrays([pa.array(p.view(np.int64)), pa.array(code), pa.array(h.view(np.int64))], fields=list(kind))
            ends = pa.array(np.searchsorted(at, first), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first)), pa.ListArray.from_arrays(ends, flat)], names=["_key", "_same", "n_words", "found"])

    return scan


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a document's leaked windows as spans, overlapping ones joined."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    for batch in batches:
        spans = []
        for codes in batch.column(2):
            c = np.array(codes.as_py() or [], np.int64)
            start, end = merged(c // 16, c // 16 + c % 16)
            spans.append([{"s": int(s), "e": int(e)} for s, e in zip(start, end, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), batch.column(3)], names=["_key", "n_words", "spans", "items"])


def joined_leaks(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(_key, n_words, spans, items) of rows (_key, _text, _same) against items (i, t) of any number: fingerprints of both sides are
    joined, then the windows around those that met. Both joins deal the rows of one hash to SALTS parts; of the benchmark each task holds its
    share and a filter of fixed size.
    """
    spark = rows.sparkSession
    bench, _ = written(items.select(F.col("i").alias("item"), F.col("t").alias("_text")).mapInArrow(_prints, "n int, hash long, item long").distinct(), "leak-prints")
    lengths = sorted(r.n for r in bench.where("n > 0").select("n").distinct().collect())
    shared = spark.sparkContext.broadcast(_filter(bench))
    base, _ = written(rows.mapInArrow(_candidates(shared, lengths), "_key long, _same long, n_words long, found array<struct<p:long,c:long,h:long>>"), "leak-candidates")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    asked = base.select("_key", "_same", F.pmod(F.xxhash64("_key", "_same"), F.lit(SALTS)).cast("int").alias("salt"), F.inline("found")).withColumn("n", F.pmod("c", F.lit(16)).cast("int"))
    prints = bench.where("n = 0").select(F.col("hash").alias("p"), salts)
    windows = bench.where("n > 0").select("n", F.col("hash").alias("h"), "item", salts)
    hits = asked.join(prints, ["p", "salt"], "left_semi").join(windows, ["n", "h", "salt"])
    hits = hits.groupBy("_key", "_same").agg(F.collect_set("c").alias("codes"), F.array_sort(F.collect_set("item")).alias("items"))
    b, h = base.drop("found").alias("b"), hits.alias("h")
    both = b.join(h, F.expr("b._key <=> h._key and b._same = h._same"), "left")
    out = both.select("b._key", "n_words", "codes", F.coalesce("items", F.array().cast("array<long>")).alias("items"))
    return out.mapInArrow(_joined_spans, "_key long, n_words long, spans array<struct<s:int,e:int>>, items array<long>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block_bytes: int | None = None, nameless: bool = False) -> DataFrame:
    """Per document: key, n_words, spans (in words, end exclusive), items (ids, sorted).

    A benchmark that fits one block, the usual case, is broadcast and takes one pass without a shuffle. A larger one is joined
    by fingerprints (joined_leaks). Null and empty texts have no words; items with a null text are left out,
    and so are those with a null id, unless nameless: then their windows are spans too, but no id stands for them. Items without words match nothing; repeated rows and null keys are judged as any other; other columns are not read.
    """
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), t.alias("_text"), F.xxhash64(t).alias("_same"))
    id_ = F.col(f"`{item}`").cast("long")
    items_ = benchmark.select((F.coalesce(id_, F.lit(NAMELESS)) if nameless else id_).alias("i"), F.col(f"`{text}`").alias("t")).where("i is not null and t <> ''")
    if (items_.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > (block_bytes or BLOCK_BYTES):
        out = joined_leaks(rows, items_)
    else:
        block = items_.collect()
        shared = spark.sparkContext.broadcast(prepare([r.i for r in block], pa.array([r.t for r in block], pa.string())))
        out = rows.mapInArrow(_scan(shared), _HIT)
    items = F.filter("items", lambda x: x != NAMELESS) if nameless else F.col("items")
    return out.select(F.col("_key").alias(key), "n_words", "spans", items.alias("items"))


def covered(spans: str) -> Column:
    """How many words lie in any of the spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step)["n"].cast("long")


def leak_report(docs: DataFrame, benchmark: DataFrame, nameless: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; from find_leaks(), which says what odd rows give."""
    found = find_leaks(docs, benchmark, nameless=nameless).withColumn("n_hit", covered("spans"))
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, nameless: bool = False) -> DataFrame:
    """The documents that leak_report() does not call contaminated, with their own columns, repeated rows and null keys. Null and
    empty texts stay; no documents give no rows."""
    leaked = leak_report(docs, benchmark, nameless).where("contaminated and doc_id is not null").select("doc_id").distinct()
    clean = docs.join(leaked, "doc_id", "left_anti")
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))
