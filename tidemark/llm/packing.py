"""Packing: documents in the order of a Hilbert curve through their projected vectors, cut into sequences along it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, pieces, written
from .tokens import encoder, with_end

SEQUENCE = 2048
#: Buckets of a hashed document vector, dimensions that it is projected to, bits of each on the curve, bits that part equal places.
FEATURES, DIMENSIONS, BITS, TIE_BITS = 256, 4, 10, 20
_RANGES = 8
#: Bytes of texts, or of ids, that a task handles at a time.
_PIECE = 2 << 20


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (rows x dimensions) with coordinates under 2^bits.

    The published transposition of coordinates: undo the excess of rotations from the top bit down, then Gray-decode.
    """
    x = points.astype(np.int64, copy=True)
    n, top = x.shape[1], 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(n):
            inverted = (x[:, i] & level) != 0
            swap = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inverted, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = top
    while level > 1:
        turn ^= np.where(x[:, -1] & level, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place on the curve of each document: hashed counts of its ids, to unit length, projected, quantised."""
    normal = np.random.default_rng(20).standard_normal((FEATURES, DIMENSIONS))
    out = []
    for at in range(0, len(ends) - 1, 2048):
        own = ends[at : at + 2049]
        n = len(own) - 1
        feature = (mixed(ids[own[0] : own[-1]]) % np.uint64(FEATURES)).astype(np.int64)
        vectors = np.bincount(np.repeat(np.arange(n), np.diff(own)) * FEATURES + feature, minlength=n * FEATURES).reshape(n, FEATURES)
        length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1, keepdims=True))
        places = vectors @ normal / np.maximum(length, 1)
        out.append(hilbert_key(np.clip((places + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _encoded(tokenizer: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in pieces(batches, "t", _PIECE):
            ids, ends = with_end(*own.encode(batch.column(1)), end)
            tie = mixed(batch.column(0).fill_null(-1).to_numpy().astype(np.uint64)) >> np.uint64(64 - TIE_BITS)
            key = (curve_keys(ids, ends) << TIE_BITS) | tie.astype(np.int64)
            # ids of small vocabularies take two bytes
            width = 2 if own.vocabulary <= 1 << 16 and end < 1 << 16 else 4
            data = ids.astype(f"<u{width}").tobytes()
            cells = pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array(np.diff(ends)), pa.array(np.full(len(key), width, np.int32)), cells], names=["doc_id", "key", "n", "width", "ids"])

    return encode


def pack_documents(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids (little-endian unsigned 32-bit).

    Documents follow the curve, neighbours sharing sequences; the stream of their ids is cut every size ids, so only its very
    last sequence can be short. Ids are computed once and written; ranges of the key, taken from its quantiles and so even
    where many documents are equal, are added up to know where each begins (one sum a range goes to the driver), then every
    range is sorted and streamed. Null and empty texts are the id end alone; null keys and repeated rows are packed as any
    other; no other column is read; no documents give no rows.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    spark = docs.sparkSession
    encoded = rows.mapInArrow(_encoded(tokenizer, end), "doc_id long, key long, n long, width int, ids binary")
    encoded, _ = written(encoded, "packing-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(parts * _RANGES, 1 << 15)
    quantiles = encoded.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20_000)).first()[0]
    bounds = np.unique(np.array(quantiles or [], np.int64))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), "right").astype(np.int32))

    dealt = encoded.withColumn("range", range_of("key"))
    sums = dict(dealt.groupBy("range").agg(F.sum("n")).collect())
    begins = np.concatenate([[0], np.cumsum([sums.get(i, 0) for i in range(len(bounds) + 1)])]).astype(np.int64)
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "key", "doc_id")

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")[: 7 + with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = -1, 0
        for batch in pieces(batches, "ids", _PIECE):
            out: dict[str, list] = {n: [] for n in names}
            for doc, n, width, ids, r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids", "range")), strict=True):
                if r != now:
                    now, at = r, int(begins[r])
                start = 0
                while start < n:
                    length = min(n - start, size - (at + start) % size)
                    raw = np.frombuffer(ids, f"<u{width}", length, start * width).astype("<u4").tobytes()
                    for c, v in zip(out, (doc, start, length, zlib.crc32(raw), n, (at + start) // size, (at + start) % size, raw), strict=False):
                        out[c].append(v)
                    start += length
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()], names=list(out))

    return ordered.mapInArrow(cut, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names))


def packing_report(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """The pieces by digest, without their ids."""
    return pack_documents(docs, tokenizer, end, with_ids=False)
