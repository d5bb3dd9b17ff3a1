"""Known review dumps, and the command that turns them into logs: python -m tidemark.sources.registry --dataset NAME --input-dir DIR --output-dir DIR."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import interactions as log

# Short names of public review dumps, with their file and the log that is made of it.
DATASETS = {
    "beauty": ("Luxury_Beauty_5.json", "dataset_amazon_lux_beauty_5_core.csv"),
    "industry": ("Industrial_and_Scientific_5.json", "dataset_amazon_industry_5_core.csv"),
    "pantry": ("Prime_Pantry_5.json", "dataset_amazon_pantry_5_core.csv"),
    "music": ("Digital_Music_5.json", "dataset_amazon_music_5_core.csv"),
    "instruments": ("Musical_Instruments_5.json", "dataset_amazon_instruments_5_core.csv"),
}


def convert(spark: SparkSession, name: str, input_dir: str, output_dir: str) -> str:
    """Cleans one dump into a log; returns where it is. A missing dump raises FileNotFoundError."""
    source, target = (f"{d.rstrip('/')}/{f}" for d, f in zip((input_dir, output_dir), DATASETS[name], strict=True))
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"the {name} reviews are not at {source}")
    log.write_log(log.earliest(log.complete(log.read_reviews(spark, source))), target)
    return target


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--dataset", choices=sorted(DATASETS), action="append", help="repeatable; all of them without it")
    parser.add_argument("--input-dir", required=True)
    parser.add_argument("--output-dir", required=True)
    asked = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return [convert(spark, name, asked.input_dir, asked.output_dir) for name in asked.dataset or sorted(DATASETS)]


if __name__ == "__main__":
    main()
