"""Interaction logs (userid, itemid, ts, rating): review dumps, CSV logs, and the driver's tables in their place."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a review dump with the columns they become, and the time format of a log.
REVIEW_FIELDS = {"reviewerID": "userid", "asin": "itemid", "unixReviewTime": "ts", "overall": "rating"}
LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss"
RATING_BY_EVENT = {"purchase": 5.0, "signup": 4.0, "click": 3.0, "view": 2.0, "error": 1.0}


def typed(raw: DataFrame) -> DataFrame:
    """The four columns of a log from strings: what cannot be read becomes null, never an error."""
    return raw.select(
        F.col("userid").cast("string").alias("userid"),
        F.col("itemid").cast("string").alias("itemid"),
        F.expr("cast(timestamp_seconds(try_cast(ts AS double)) AS timestamp_ntz)").alias("ts"),
        F.expr("try_cast(rating AS double)").alias("rating"),
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines dump. Only four fields are parsed; blank lines are no rows, a malformed line fails the job."""
    schema = ", ".join(f"{f} string" for f in REVIEW_FIELDS)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"no review records in {path}")
    return typed(rows.select(*(F.col(f).alias(c) for f, c in REVIEW_FIELDS.items())))


def complete(log: DataFrame) -> DataFrame:
    """Rows with all four values; NaN counts as missing."""
    return log.na.drop(subset=["userid", "itemid", "ts", "rating"])


def earliest(log: DataFrame) -> DataFrame:
    """The first event of each user and item, the higher rating of equal times. One hash aggregate, combined before the shuffle."""
    first = F.min(F.struct("ts", (-F.col("rating")).alias("negative"))).alias("first")
    return log.groupBy("userid", "itemid").agg(first).select("userid", "itemid", F.col("first.ts").alias("ts"), (-F.col("first.negative")).alias("rating"))


def audit(raw: DataFrame) -> DataFrame:
    """One row: raw, invalid and duplicate rows, rows kept, users, items."""
    usable = complete(raw)
    kept = earliest(usable).agg(F.count("*").alias("n_kept"), F.count_distinct("userid").alias("n_users"), F.count_distinct("itemid").alias("n_items"))
    counts = raw.agg(F.count("*").alias("n_raw")).crossJoin(usable.agg(F.count("*").alias("n_usable"))).crossJoin(kept)  # three single rows
    return counts.select("n_raw", (F.col("n_raw") - F.col("n_usable")).alias("n_invalid"), (F.col("n_usable") - F.col("n_kept")).alias("n_duplicate"), "n_kept", "n_users", "n_items")


def write_log(log: DataFrame, path: str) -> None:
    """CSV with a header, ordered by time, user and item."""
    log.select("userid", "itemid", F.col("ts").alias("timestamp"), "rating").orderBy("timestamp", "userid", "itemid").write.option("header", True).option("timestampNTZFormat", LOG_TIME).csv(path)


def read_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A CSV log with a header. Times that cannot be read are an error, or null if not strict."""
    log = spark.read.schema("userid string, itemid string, timestamp string, rating double").option("header", True).csv(path)
    return with_times(log.withColumnRenamed("timestamp", "ts"), strict)


def with_times(log: DataFrame, strict: bool = True) -> DataFrame:
    """ts as a time without zone, from ISO text or from seconds since 1970 in UTC. With strict, any that is missing or cannot be
    read raises ValueError."""
    text = F.trim(F.col("ts").cast("string"))
    seconds = F.expr("cast(timestamp_seconds(try_cast(trim(cast(ts AS string)) AS double)) AS timestamp_ntz)")
    read = seconds if dict(log.dtypes)["ts"] in ("int", "bigint", "double", "float") else F.coalesce(F.try_to_timestamp(text).cast("timestamp_ntz"), seconds)
    out = log.withColumn("ts", read)
    if strict and (bad := out.where("ts is null").count()):
        raise ValueError(f"{bad} times cannot be read")
    return out


def from_cells(spark: SparkSession, cells: Iterable[tuple]) -> DataFrame:
    """Feedback (userid, itemid, y) from literal cells: duplicates are added, zeros dropped; negative or non-finite values are an error."""
    df = spark.createDataFrame(list(cells), "userid long, itemid long, y double")
    if not df.where("y < 0 or isnan(y) or y = double('infinity') or y is null").isEmpty():
        raise ValueError("feedback must be finite and not negative")
    return df.groupBy("userid", "itemid").agg(F.sum("y").alias("y")).where("y <> 0")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts of all order lines (with line number and order key)."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    rating = 1.0 + F.floor((F.col("l_quantity") - 1) / 10)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("userid"), F.col("l_partkey").alias("itemid"), F.col("o_orderdate").alias("ts"), rating.cast("double").alias("rating"), "l_orderkey", "l_linenumber")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of first lines only, without repeated pairs."""
    return earliest(dense(spark, sf_dir).where("l_linenumber = 1"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the key in the properties of events, rated by kind of event."""
    rating = F.create_map(*(F.lit(x) for pair in RATING_BY_EVENT.items() for x in pair))[F.col("event_type")]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("userid"), F.get_json_object("props", "$.k").cast("long").alias("itemid"), "ts", rating.alias("rating"))


def stamp(now: datetime.datetime) -> str:
    """The name part of a run's report folder."""
    return now.strftime("%Y%m%dT%H%M%SZ")


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder for each table of a report, in as many parts as the table has; parts follow its order."""
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{folder}/{name}")
