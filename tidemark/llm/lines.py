"""Line deduplication: lines that stand in many documents go from all of them, the others stay in their order.

Lines are exploded as digests, a digest's documents are counted apart, and the digests over the threshold go back to the
documents that hold them, where the text is put together again. Texts cross the cluster once, digests three times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_columns, pieces, unused, written

#: Stripped from both ends of a line for its key: the bytes 20 and 09 to 0D.
BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of digests that are handed on at a time.
SOME = 1 << 20


def digest(line: bytes) -> bytes | None:
    """128 bits of the line's key (stripped, A-Z in lower case); None for an empty key."""
    key = line.strip(BLANK).lower()
    return hashlib.blake2b(key, digest_size=16).digest() if key else None


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_digests(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(digest, key): the different keys of each row's lines, less the empty one. A row is handed on in parts if it has many lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for i, value in enumerate(batch.column(0)):
                for d in {digest(line) for line in _lines(value.as_py())} - {None}:
                    found.append(d)
                    of.append(i)
                if len(found) * 16 > SOME:
                    yield out(batch, found, of)
                    found, of = [], []
            yield out(batch, found, of)

    def out(batch: pa.RecordBatch, found: list[bytes], of: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1).take(pa.array(of, pa.int32()))], names=["digest", "key"])

    return docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key")).mapInArrow(run, "digest binary, key long")


def frequent_lines(docs: DataFrame, least: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, n): keys of lines in at least so many documents. Rows with one id are one document; the null id is an id like others.

    A line that all documents share is counted by (line, document) first, so no task meets all its documents at once.
    """
    once = line_digests(docs.withColumn(key, F.col(f"`{key}`").cast("long")), text, key).groupBy("digest", "key").agg(F.lit(1).alias("one"))
    return once.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_lines(docs: DataFrame, frequent: DataFrame, n_lines: str, n_dropped: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the frequent lines dropped from their texts, and two counts; every row comes back, with all its columns.

    A row takes its digests from a join by a hash of its id and text, so rows of one id, or copies of one text, are not one key.
    """
    row, gone = unused(docs, "row"), unused(docs, "gone")
    keyed = docs.withColumn(row, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")))
    mine = line_digests(keyed, text, row).join(frequent.select("digest"), "digest", "left_semi")
    lists = mine.groupBy("key").agg(F.collect_set("digest").alias(gone)).withColumnRenamed("key", row)
    both = keyed.join(lists.hint("shuffle_hash"), row, "left").select(*(F.col(f"`{c}`") for c in docs.columns), gone)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces([batch], text):
                texts, total, dropped = [], [], []
                for value, own in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    lines = _lines(value)
                    total.append(len(lines))
                    if own:
                        left = [line for line in lines if digest(line) not in own_set] if (own_set := set(own)) else lines
                        dropped.append(len(lines) - len(left))
                        value = b"\n".join(left).decode("utf-8", "surrogatepass")
                    else:
                        dropped.append(0)
                    texts.append(value)
                columns = [*part.columns[:-1], pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
                columns[at] = pa.array(texts, part.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return both.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = 10, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """documents with every line dropped whose key (stripped, A-Z in lower case) stands in at least `least` documents, and the
    numbers of lines before and of lines dropped; these two columns' names must be new ones.

    A null text stays null and counts as one empty line; empty keys never go; a text that loses all lines is empty. Rows with one
    id count as one document but each keeps its own text; repeated rows stay as often as they are. No rows give no rows.
    Other columns pass as they are.
    """
    if clash := {n_lines.lower(), n_dropped.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    frequent, _ = written(frequent_lines(docs, least), "frequent-lines")
    return without_lines(docs, frequent, n_lines, n_dropped)


def line_report(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of documents; dedup_lines() says what odd rows give."""
    out = dedup_lines(doc_columns(docs, "doc_id", "text"), least)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
