"""The global temporal split: two cuts between times, fit and evaluation windows, what evaluation drops, data statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .feedback import LIKED, matrix
from .positions import before

RATIOS = (0.7, 0.1, 0.2)


def starts(log: DataFrame) -> DataFrame:
    """(ts, n, start): rows of each time and how many rows come before it. The log is read once: its times are written."""
    return before(written(log.groupBy("ts").agg(F.count("*").alias("n")), "times"), "ts", "n", "start")


def cuts(log: DataFrame, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """One row (n_rows, train_end, val_end, train_cut, val_cut), as boundaries() finds them."""
    kind = dict(log.dtypes)["ts"]
    return log.sparkSession.createDataFrame([boundaries(log, ratios)], f"n_rows long, train_end long, val_end long, train_cut {kind}, val_cut {kind}")


def boundaries(log: DataFrame, ratios: tuple[float, float, float] = RATIOS) -> tuple:
    """(n_rows, train_end, val_end, train_cut, val_cut): the changes of time nearest to the targets, the earlier of equals.

    Targets come from the ratios in double arithmetic. The last change is left to the test window; times are rows here, so
    neither events nor times meet in the driver.
    """
    if min(ratios) <= 0 or not math.isclose(sum(ratios), 1.0):
        raise ValueError("ratios must be positive and add up to 1")
    at = written(starts(log), "starts")
    totals = at.agg(F.sum("n").alias("n_rows"), F.max("start").alias("last"), F.count("*").alias("times")).first()
    if (totals.times or 0) < 3:
        raise ValueError("a split needs at least three distinct times")
    change = at.where("start > 0")

    def nearest(rows: DataFrame, share: float):
        target = math.floor(totals.n_rows * share)
        gap = F.abs(F.col("start") - target)
        return rows.agg(F.min(F.struct(gap.alias("gap"), F.col("start"), F.col("ts"))).alias("x")).first().x

    train = nearest(change.where(F.col("start") < totals["last"]), ratios[0])
    val = nearest(change.where(F.col("start") > train.start), ratios[0] + ratios[1])
    return totals.n_rows, train.start, val.start, train.ts, val.ts


def labelled(log: DataFrame, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """log with part: train, val or test."""
    *_, train, val = boundaries(log, ratios)
    return log.withColumn("part", F.when(F.col("ts") < F.lit(train), "train").when(F.col("ts") < F.lit(val), "val").otherwise("test"))


def stage(parts: DataFrame, final: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fit events, evaluation events): train + val against test, or train against val."""
    return (parts.where("part <> 'test'"), parts.where("part = 'test'")) if final else (parts.where("part = 'train'"), parts.where("part = 'val'"))


def known_events(fit: DataFrame, ahead: DataFrame, cold_start: str = "drop") -> DataFrame:
    """Evaluation events of the fit window's items and, unless cold_start is "pad", of its users."""
    out = ahead.join(fit.select("itemid").distinct(), "itemid", "left_semi")
    return out if cold_start == "pad" else out.join(fit.select("userid").distinct(), "userid", "left_semi")


def fit_and_eval(fit: DataFrame, ahead: DataFrame, cold_start: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Both windows as matrices."""
    return matrix(fit), matrix(known_events(fit, ahead, cold_start))


def drop_stats(fit: DataFrame, ahead: DataFrame, threshold: float = LIKED) -> DataFrame:
    """One row: events of unknown users, of these with a positive rating, and the same of unknown items among known users."""
    users, items = (fit.select(c).distinct().withColumn(f"_{c}", F.lit(True)) for c in ("userid", "itemid"))
    flagged = ahead.join(users, "userid", "left").join(items, "itemid", "left")
    no_user, no_item = F.col("_userid").isNull(), F.col("_userid").isNotNull() & F.col("_itemid").isNull()
    good = F.col("rating") > threshold
    return flagged.agg(F.count_if(no_user).alias("future_user"), F.count_if(no_user & good).alias("future_user_positive"), F.count_if(no_item).alias("future_item"), F.count_if(no_item & good).alias("future_item_positive"))


def _density(users, items, cells):
    share = F.when(users * items > 0, 100.0 * cells / (users * items)).otherwise(0.0)
    return F.round(share, 6).alias("density_pct"), F.round(100.0 - share, 6).alias("sparsity_pct")


def raw_stats(log: DataFrame) -> DataFrame:
    got = log.agg(F.count_distinct("userid").alias("n_users"), F.count_distinct("itemid").alias("n_items"), F.count("*").alias("n_interactions"))
    return got.select("*", *_density(F.col("n_users"), F.col("n_items"), F.col("n_interactions")))


def eval_stats(fit: DataFrame, ahead: DataFrame, threshold: float = LIKED) -> DataFrame:
    """One row for an evaluation window: its matrix, users with a positive target and a positive history by group, drops."""
    y, target = fit_and_eval(fit, ahead)
    shape = target.agg(F.count_distinct("userid").alias("n_users"), F.count_distinct("itemid").alias("n_items"), F.count("*").alias("n_interactions"))
    shape = shape.select("*", *_density(F.col("n_users"), F.col("n_items"), F.col("n_interactions")))
    n = F.col("n_liked")
    history = y.where(F.col("y") > threshold).groupBy("userid").agg(F.count("*").alias("n_liked"))
    groups = history.join(target.where(F.col("y") > threshold).select("userid").distinct(), "userid", "left_semi").agg(F.count("*").alias("n_users_eval"), F.count_if(n == 1).alias("interaction_1"), F.count_if(n == 2).alias("interaction_2"), F.count_if(n >= 3).alias("interaction_3_plus"))
    return shape.crossJoin(groups).crossJoin(drop_stats(fit, ahead, threshold))  # single rows
