"""What the operators of this subpackage share: shared folders, text buffers, digests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, written_at

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost no recomputation."""
    return written_at(df, name)


def written_alone(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), with df's shuffle files deleted as soon as the table is there; df should not be executed again."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting)
    conf.set(setting, "true")
    try:
        return written(df, name)
    finally:
        conf.set(setting, before)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else; every code point keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins (one entry more than rows); null is empty. No copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that each holds about most bytes of the column, or one longer row. Memory that Arrow has
    kept for reuse is given back after the last one: workers outlive their tasks and stand beside those of the next stage."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = buffers(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that scatters them (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd multiplier for polynomial hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each pair, whatever its length, in time in proportion to values.

    prefix[i] is the sum of v[j] * b^-j for j < i, so (prefix[e] - prefix[s]) * b^s depends on the content alone.
    """
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed(values.astype(np.uint64) + np.uint64(1)) * powers(len(values), inverse), out=prefix[1:])
    up = powers(len(values) + 1)
    return mixed((prefix[ends] - prefix[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray, ends: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words (runs of bytes in the table member) begin and end, and each row's first word (one entry more than rows)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    step = np.diff(inside)
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = np.unique(cut[(inside[cut] & inside[cut + 1]).astype(bool)])
    starts = np.flatnonzero(step == 1)
    stops = np.flatnonzero(step == -1)
    if len(joined):
        starts, stops = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([stops, joined]))
    return starts, stops, np.searchsorted(starts, ends)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges, both ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased UTF-8: every byte over 0x7F belongs to a code point over 0x7F.
WORD = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of the words [^\x20\x09-\x0D]+.
SOLID = byte_table((0, 8), (14, 31), (33, 255))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return _FOLD[data]


def lists(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of flat, row i being flat[ends[i]:ends[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
