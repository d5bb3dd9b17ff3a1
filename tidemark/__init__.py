"""Spark-first analytics over sparse interaction logs and text corpora."""
