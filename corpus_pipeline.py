"""The corpus pipeline: five stages applied one after the other to the documents table, each to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, langid, packing, secrets, similarity
from tidemark.llm.common import drop, table, written
from tidemark.llm.queries import vocabulary
from tidemark.storage import passing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones; those without a letter or a text go."""
    return langid.known_languages(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word shingles link, the one with the least doc_id."""
    return similarity.one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in windows of benchmark items."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows the text where it is known."""
    return secrets.redact_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences, as pieces."""
    return packing.packing_report(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secret_free),
    ("packing", sequences),
]

#: No stage of the five is expressible in SQL as a whole; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables, and those of its predecessor, are deleted once its own result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing(spark) as made:
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            made.remove(path)
        if last:
            drop(spark, last)
        last = path
    return docs
