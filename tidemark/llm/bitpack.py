"""Token-ID output: files of ids in the fewest bits that hold the vocabulary, in blocks of fixed size with offsets."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces, shared_path, written
from .tokens import encoder, with_end

# The file format. All numbers are little-endian.
MAGIC = b"TIDEBIT1"
HEADER = struct.Struct("<8sIIIIQQ")  # magic, bits, ids in a block, part, file in its part, documents, ids
#: Ids in a block and, about, in a file. A file also holds the ids of its last document whole.
BLOCK, FILE_IDS = 1 << 16, 1 << 22
_KEY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("end", "<u8")])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of so many bits each, lowest bit first, padded to eight ids."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.ravel()[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = groups[:, j] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first n ids of pack()."""
    m = -(-n // 8)
    raw = np.frombuffer(data, np.uint8, m * bits).reshape(m, bits)
    out = np.zeros((m, 8), np.uint32)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = np.zeros(m, np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.ravel()[:n]


def to_file(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, bits: int, part: int, number: int) -> bytes:
    """A file: header, document index, offsets of the blocks, blocks."""
    index = np.zeros(len(doc_ids), _KEY)
    index["doc_id"], index["known"], index["end"] = doc_ids, known, ends[1:]
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join([HEADER.pack(MAGIC, bits, BLOCK, part, number, len(doc_ids), len(ids)), index.tobytes(), offsets.tobytes(), *blocks])


class Reader:
    """A file of to_file(); read() unpacks only the blocks that a range of ids touches."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.part, self.number, n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        self.index = np.frombuffer(data, _KEY, n_docs, HEADER.size)
        at = HEADER.size + self.index.nbytes
        self.offsets = np.frombuffer(data, "<u8", -(-self.n_ids // self.block) + 1, at).astype(np.int64)
        self.body = memoryview(data)[at + self.offsets.nbytes :]
        self.ends = np.concatenate([[0], self.index["end"].astype(np.int64)])

    def read(self, start: int, stop: int) -> np.ndarray:
        out = []
        for b in range(start // self.block, -(-stop // self.block)):
            n = min(self.block, self.n_ids - b * self.block)
            ids = unpack(self.body[self.offsets[b] : self.offsets[b + 1]], self.bits, n)
            out.append(ids[max(0, start - b * self.block) : stop - b * self.block])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.read(self.ends[i], self.ends[i + 1])


def _store(folder: str, name: str, data: bytes) -> str:
    """Writes a file under a name of this attempt's own, which it returns: a task that runs again never meets what an attempt
    before it left. Readers go by the manifest, so leftovers count for nothing."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}.bits"
    with store.open_output_stream(f"{root}/{file}") as out:
        out.write(data)
    return file


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all documents in ascending order of the key; returns the manifest (part, number, file, n_ids, n_docs).

    Texts are dealt by range of the key and sorted (rows with the same key by their text, null keys first), then encoded and
    written by each task in files of bounded size. Null and empty texts are the id end alone. Rows with one key, or none, are one
    range and so one task, which streams them. No other column is read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    dealt = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    schema = "part int, number int, file string, n_ids long, n_docs long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits = bits_for(max(own.vocabulary, end + 1))
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            ids, lengths, keys, known = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            name = _store(folder, f"part-{part:06d}-{number:06d}", to_file(ids, np.concatenate([[0], np.cumsum(lengths)]), keys, known, bits, part, number))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(ids)]), pa.array([len(keys)])], names=["part", "number", "file", "n_ids", "n_docs"])

        size = 0
        for batch in pieces(batches, "t", 2 << 20):
            ids, ends = with_end(*own.encode(batch.column(1)), end)
            keys = batch.column(0)
            held.append((ids, np.diff(ends), keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)))
            size += len(ids)
            if size >= FILE_IDS:
                yield flush()
                number, size = number + 1, 0
        if held:
            yield flush()

    return written(dealt.mapInArrow(write, schema), "ids-manifest")[0]


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the manifest's files, start counting all ids before it in their order.

    Other files in the folder are not counted; no documents give no rows. The files go through Spark's own reader; what the driver gets is one sum for each writing task.
    """
    before, total = [], 0
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before.append((r.part, total))
        total += r.n
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.createDataFrame(before, "part int, base long")
    bases = manifest.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "number", F.xxhash64("file").alias("mark"), (F.col("base") + F.col("inner")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, mark in zip(*batch.columns, strict=True):
                file = Reader(data.as_py())
                n = len(file.index)
                crcs = np.fromiter((zlib.crc32(file.document(i).astype("<u4").tobytes()) for i in range(n)), np.int64, n) if n < 2 or file.n_ids // n > file.block else _crcs(file)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, file.part, np.int32)), pa.array(np.full(n, file.number, np.int32)), pa.array(np.full(n, mark.as_py(), np.int64)), pa.array(file.index["doc_id"].astype(np.int64), mask=file.index["known"] == 0), pa.array(file.ends[:-1]), pa.array(np.diff(file.ends)), pa.array(crcs)], names=["part", "number", "mark", "doc_id", "local", "n_tokens", "ids_crc32"])

    if not before:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bits").load(folder).select("content", F.xxhash64(F.element_at(F.split("path", "/"), -1)).alias("mark"))
    rows = files.mapInArrow(read, "part int, number int, mark long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "number", "mark"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _crcs(file: Reader) -> np.ndarray:
    """Of all documents, each block being unpacked once."""
    data = memoryview(file.read(0, file.n_ids).astype("<u4").tobytes())
    return np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(file.ends, file.ends[1:], strict=False)), np.int64, len(file.ends) - 1)


def token_files(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Writes the documents' ids to a new folder of the shared one and reads them back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "ids")
    return read_ids(spark, folder, write_ids(docs, folder, tokenizer, end))
