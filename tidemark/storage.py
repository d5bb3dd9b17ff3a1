"""Tables in the folder that the cluster shares, to end the lineage of iterative work."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder of our own, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints', spark.sparkContext.applicationId)}"
    return found.rstrip("/")


_own = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """The folders that written() makes inside, in this thread; those still in the list at the end are deleted."""
    made: list[str] = []
    lists = _own.__dict__.setdefault("lists", [])
    lists.append(made)
    try:
        yield made
    finally:
        lists.pop()
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def left_to_caller(paths: list[str]) -> None:
    """Tables that a passing() inside let go become those of the one around, if there is any."""
    if lists := getattr(_own, "lists", None):
        lists[-1] += paths


#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes, _lock, _before = 0, threading.Lock(), None


@contextmanager
def leaving_no_shuffle(spark: SparkSession) -> Iterator[None]:
    """A write inside removes its shuffle files when it ends: its rows lie in the table then. Without this they stay until the driver
    happens to collect its garbage. The setting is put back when the last of several threads leaves."""
    global _writes, _before
    with _lock:
        if not _writes:
            _before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writes += 1
    try:
        yield
    finally:
        with _lock:
            _writes -= 1
            if not _writes:
                spark.conf.unset(_CLEANUP) if _before is None else spark.conf.set(_CLEANUP, _before)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table, computed once, and where it is."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with leaving_no_shuffle(df.sparkSession):
        df.write.parquet(path)
    left_to_caller([path])
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, computed once."""
    return written_at(df, name)[0]
