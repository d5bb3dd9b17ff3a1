"""Removal of repeated passages: every byte under a 50-byte string that also starts in a document with a smaller id goes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mixed, pieces, written_alone

#: Bytes of a repeated string; bytes of an anchor, and the places among which the least anchor hash is chosen: any two equal
#: strings of LENGTH bytes choose the same place, so comparing the surroundings of equal anchors finds every repeat.
LENGTH, ANCHOR = 50, 16
REACH = LENGTH - ANCHOR + 1
#: Bytes of text that numpy works on at a time, anchors gathered before they are dealt out, contexts of an anchor in one gathering from which it counts as hot.
_PIECE, _GATHER, _HOT = 1 << 21, 400_000, 64
_PLACE = np.uint64((1 << 24) - 1)
#: Buckets for each shuffle partition.
_BUCKETS = 4
_FIELDS = (("a", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("lo", "<i4"), ("n", "<i4"))
RUN = np.dtype(list(_FIELDS))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16 + LENGTH + REACH, np.uint8)])
    n = len(data) + 8 + LENGTH
    out = np.empty(n, np.uint64)
    for o in range(8):
        part = out[o::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), o)
    return out


def window_hash(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each place on."""
    out = np.full(len(at), 7, np.uint64)
    for o in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        out = mixed(out * np.uint64(31) + words[at + o])
    return out


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash, context hash) of all runs of windows that choose the same anchor; places in data.

    The context is all bytes of the run's windows, with the anchor's place in them.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    valid = np.zeros(max(n, 1), bool)
    lengths = np.diff(ends)
    for s, e in zip(ends[:-1][lengths >= LENGTH], ends[1:][lengths >= LENGTH], strict=True):
        valid[s : e - LENGTH + 1] = True
    if not valid.any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    words = words_at(data)
    gram = mixed(words[: n + LENGTH] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(words[8 : n + LENGTH + 8]))
    key = (gram & ~_PLACE) | (_PLACE - np.arange(len(gram), dtype=np.uint64))
    least, width = key, 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])[:n]
    anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
    change = anchor[1:] != anchor[:-1]
    lo = np.flatnonzero(valid & np.concatenate([[True], change | ~valid[:-1]]))
    hi = np.flatnonzero(valid & np.concatenate([change | ~valid[1:], [True]]))
    where = anchor[lo]
    context = window_hash(words, lo) + mixed(window_hash(words, hi)) * np.uint64(3)
    context = mixed(context ^ ((hi - lo).astype(np.uint64) << np.uint64(32) | (where - lo).astype(np.uint64)))
    return lo, hi, gram[where], context


def pack_runs(found: np.ndarray) -> bytes:
    """Records column by column, ids and places as differences, compressed."""
    out = [np.uint32(len(found)).tobytes()]
    for name, kind in _FIELDS:
        column = found[name]
        if name in ("doc", "lo"):
            column = np.diff(column, prepend=column.dtype.type(0))
        out.append(np.ascontiguousarray(column.astype(kind)).view(np.uint8).reshape(len(found), -1).T.tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_runs(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    n, at = int(np.frombuffer(raw, np.uint32, 1)[0]), 4
    out = np.zeros(n, RUN)
    for name, kind in _FIELDS:
        size = np.dtype(kind).itemsize
        column = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
        out[name] = np.cumsum(column, dtype=column.dtype) if name in ("doc", "lo") else column
        at += n * size
    return out


def decide(found: np.ndarray, hot: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(removed, open, rest) of runs: removed have the same context in a smaller document; open are the others of anchors with
    several contexts; rest those of anchors with one. With hot, only anchors with so many contexts are open, and two of their
    runs are in rest as well, to tell others of that anchor."""
    found = found[np.lexsort((found["doc"], found["c"], found["a"]))]
    new_a = np.concatenate([[True], found["a"][1:] != found["a"][:-1]])[: len(found)]
    new_c = new_a | np.concatenate([[True], found["c"][1:] != found["c"][:-1]])[: len(found)]
    group, context = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
    later = found["doc"] > found["doc"][np.flatnonzero(new_c)][context]
    contexts = np.bincount(group[new_c], minlength=group[-1] + 1 if len(group) else 0)
    several = contexts[group] >= (hot or 2)
    rest = ~later & ~several
    if hot:
        first = np.flatnonzero(new_c & several)
        rank = np.arange(len(first)) - np.searchsorted(group[first], group[first], "left")
        rest[first[rank < 2]] = True
    return found[later], found[~later & several], found[rest]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Runs of many documents at a time."""
    held: list[np.ndarray] = []
    for batch in pieces(batches, "_text", _PIECE):
        batch = batch.filter(batch.column(0).is_valid())
        if not batch.num_rows:
            continue
        data, ends = buffers(batch.column(2))
        doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at, stop, within in _bounded(ends):
            lo, hi, a, c = runs(data[at:stop], within)
            owner = np.searchsorted(ends, lo + at, "right") - 1
            own = np.zeros(len(lo), RUN)
            own["a"], own["c"], own["doc"], own["tag"], own["lo"], own["n"] = a, c, doc[owner], tag[owner], lo + at - ends[owner], hi - lo
            held.append(own)
        if sum(map(len, held)) >= _GATHER:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _bounded(ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, ends within) of stretches of a buffer: whole documents, or parts of a long one that share LENGTH - 1 bytes, so that every window is in one part."""
    if ends[-1] <= 2 * _PIECE:
        yield 0, int(ends[-1]), ends
        return
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        at = s
        while at < e:
            stop = min(e, at + _PIECE)
            yield at, stop, np.array([0, stop - at])
            at = stop - LENGTH + 1 if stop < e else e


def adjacent(found: np.ndarray) -> np.ndarray:
    """Runs of windows with those that follow each other in a document made one."""
    found = found[np.lexsort((found["lo"], found["tag"], found["doc"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["doc"][1:] != found["doc"][:-1]) | (found["tag"][1:] != found["tag"][:-1]) | (found["lo"][1:] != found["lo"][:-1] + found["n"][:-1] + 1)
    at = np.flatnonzero(new)
    out = found[at]
    last = found[np.append(at[1:], len(found)) - 1] if len(at) else out
    out["n"] = last["lo"] + last["n"] - out["lo"]
    return out


def _first(buckets: int):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, found in enumerate(_chunks(batches)):
            gone, known, rest = decide(found, _HOT)
            rows = [((number * 7919 + i) % buckets, kind, pack_runs(part)) for i, (kind, part) in enumerate(((1, adjacent(gone)), (2, known))) if len(part)]
            side = (rest["a"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(side, kind="stable")
            cut = np.searchsorted(side[order], np.arange(buckets + 1))
            order = [np.sort(order[cut[b] : cut[b + 1]]) for b in range(buckets)]
            by_place = np.lexsort((rest["lo"], rest["doc"]))
            rank = np.empty(len(rest), np.int64)
            rank[by_place] = np.arange(len(rest))
            rows += [(b, 0, pack_runs(rest[own[np.argsort(rank[own])]])) for b, own in enumerate(order) if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "data"])

    return first


def _run_rows(kind: int, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found["a"].view(np.int64)), *(pa.array(np.ascontiguousarray(found[x])) for x in ("doc", "tag", "lo", "n"))], names=["kind", "a", "doc", "tag", "lo", "n"])


_RUN_SCHEMA = "kind int, a long, doc long, tag long, lo int, n int"


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges the anchors of a bucket at a time; hot ones were judged before and pass through."""
    now, held = -1, []

    def ready() -> Iterator[pa.RecordBatch]:
        if held:
            gone, known, _ = decide(np.concatenate(held))
            yield _run_rows(1, adjacent(gone))
            yield _run_rows(2, known)
            held.clear()

    for batch in batches:
        for bucket, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind:
                yield _run_rows(kind, unpack_runs(data))
                continue
            if bucket != now:
                yield from ready()
                now = bucket
            held.append(unpack_runs(data))
    yield from ready()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with their open runs: (a, doc, tag, lo, bytes) of these."""
    for batch in pieces(batches, "_text"):
        data, ends = buffers(batch.column(2))
        open_runs = batch.column(3)
        flat = open_runs.flatten()
        a, lo, n = (flat.field(i).to_numpy() for i in range(3))
        owner = np.repeat(np.arange(batch.num_rows), open_runs.value_lengths().fill_null(0).to_numpy())
        start = ends[owner] + lo
        size = n + LENGTH
        end = np.cumsum(size)
        at = np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        cells = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int32)), pa.py_buffer(data[at].tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(batch.column(0).to_numpy()[owner]), pa.array(batch.column(1).to_numpy()[owner]), pa.array(lo), cells], names=["a", "doc", "tag", "lo", "context"])


def judged(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tag, first window, windows after it) of the windows that a smaller document holds as well."""
    words = words_at(data)
    windows = np.diff(ends) - LENGTH + 1
    owner = np.repeat(np.arange(len(doc)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = window_hash(words, ends[owner] + within)
    order = np.lexsort((doc[owner], hashes))
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])[: len(order)]
    least = doc[owner][order][np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = np.zeros(len(order), bool)
    gone[order] = doc[owner][order] > least
    begin = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (owner[1:] != owner[:-1])])[: len(gone)])
    end = np.flatnonzero(gone & np.concatenate([~gone[1:] | (owner[1:] != owner[:-1]), [True]])[: len(gone)])
    own = owner[begin]
    return doc[own], tag[own], (lo[own] + within[begin]).astype(np.int32), (end - begin).astype(np.int32)


def _third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges open runs window by window, all of an anchor together; what is held is bounded by splitting between anchors."""
    held: list[pa.RecordBatch] = []

    def ready(own: pa.RecordBatch) -> pa.RecordBatch:
        data, ends = buffers(own.column(4).cast(pa.large_binary()))
        out = judged(*(own.column(i).to_numpy() for i in (1, 2, 3)), data, ends)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc", "tag", "lo", "n"])

    for batch in batches:
        held.append(batch)
        last = batch.column(0)[batch.num_rows - 1].as_py() if batch.num_rows else None
        if sum(b.num_rows for b in held) >= 20_000:
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = both.column(0).to_numpy()
            cut = int(np.searchsorted(keys, last, "left"))
            held = [both.slice(cut)] if cut else [both]
            if cut:
                yield ready(both.slice(0, cut))
    if held and sum(b.num_rows for b in held):
        yield ready(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        data, ends = buffers(batch.column(1))
        raw = data.tobytes()
        rows = []
        for i, gone in enumerate(batch.column(2)):
            own = raw[ends[i] : ends[i + 1]]
            removed, spans, kept, at = 0, 0, [], 0
            if gone.is_valid:
                lo, n = (gone.values.field(j).to_numpy() for j in (0, 1))
                order = np.argsort(lo, kind="stable")
                start, end = lo[order], np.maximum.accumulate((lo + n)[order] + LENGTH)
                new = np.concatenate([[True], start[1:] > end[:-1]])
                first = np.flatnonzero(new)
                for s, e in zip(start[first].tolist(), end[np.append(first[1:], len(end)) - 1].tolist(), strict=True):
                    kept.append(own[at:s])
                    removed, spans, at = removed + e - s, spans + 1, e
            kept.append(own[at:])
            rows.append((len(own), removed, spans, b"".join(kept)))
        n, removed, spans, kept = (list(x) for x in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document.

    1. Each task cuts its documents into runs of windows that choose the same anchor and drops what smaller documents of the
       same gathering hold; the rest meets by anchor, in compressed blocks of records for each bucket.
    2. Within an anchor, runs with the same context as a smaller document's are removed whole. Anchors with one context are
       done. Runs of the others, the edges of repeated passages, stay open.
    3. The bytes of open runs meet by anchor and are judged window by window.
    4. The removed runs of a document meet its text.
    The text is shuffled once, for 3 and 4. Null and empty texts have no bytes. Rows with a null key keep everything and
    take nothing from others. Rows that share a key are no smaller than each other; each is judged by its own text. Texts
    under LENGTH bytes lose nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = _BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("_text"))  # a new name: a kept one would let Spark plan the two exchanges below differently
    shared = not rows.groupBy("doc").count().where("count > 1 and doc is not null").isEmpty()
    rows = rows.select("doc", (F.xxhash64("_text") if shared else F.lit(0).cast("long")).alias("tag"), "_text")
    dealt = rows.mapInArrow(_first(buckets), "bucket int, kind int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    found, _ = written_alone(dealt.mapInArrow(_second, _RUN_SCHEMA), "repeats")
    open_runs = found.where("kind = 2").groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "lo", "n")).alias("open"))
    keyed = rows.where("doc is not null")  # the same plan on both sides of its two joins, so that its exchange is made once
    contexts = keyed.join(open_runs, ["doc", "tag"]).select("doc", "tag", "_text", "open").mapInArrow(_contexts, "a long, doc long, tag long, lo int, context binary")
    more = contexts.repartition("a").sortWithinPartitions("a").mapInArrow(_third, "doc long, tag long, lo int, n int")
    gone = found.where("kind = 1").select("doc", "tag", "lo", "n").unionByName(more).groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("gone"))
    joined = keyed.join(gone, ["doc", "tag"], "left").select("doc", "_text", "gone")
    keyless = rows.where("doc is null").select("doc", "_text", F.lit(None).cast(joined.schema["gone"].dataType).alias("gone"))
    out = joined.unionAll(keyless).mapInArrow(_finish, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("key", key)


def repeat_report(docs: DataFrame) -> DataFrame:
    """remove_repeats() without the bytes that remain."""
    return remove_repeats(docs).drop("kept")
