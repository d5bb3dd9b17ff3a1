"""Views of feedback: all values, seen, liked; and how active users are."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ratings over this are liked, not those equal to it.
LIKED = 3.0
# The groups by size of history.
GROUPS = ("interaction_1", "interaction_2", "interaction_3_plus")
#: Users without a history, where they are asked for.
ZERO = "interaction_0"


def matrix(log: DataFrame) -> DataFrame:
    """(userid, itemid, y): the highest rating of each pair; a zero is no feedback."""
    return log.groupBy("userid", "itemid").agg(F.max("rating").alias("y")).where("y <> 0")


def seen(y: DataFrame) -> DataFrame:
    return y.where("y <> 0").select("userid", "itemid")


def liked(y: DataFrame, threshold: float = LIKED) -> DataFrame:
    return y.where(F.col("y") > threshold).select("userid", "itemid")


def activity(y: DataFrame, threshold: float = LIKED) -> DataFrame:
    """(userid, n_seen, n_liked) of all users."""
    return y.groupBy("userid").agg(F.count("*").alias("n_seen"), F.count_if(F.col("y") > threshold).alias("n_liked"))


def group_of(n: Column) -> Column:
    """The group of a history of n; null for none."""
    return F.when(n == 1, GROUPS[0]).when(n == 2, GROUPS[1]).when(n >= 3, GROUPS[2])


def popularity(y: DataFrame, threshold: float = LIKED) -> DataFrame:
    """(itemid, score): how many like each item; 0 for items that nobody likes."""
    return y.groupBy("itemid").agg(F.count_if(F.col("y") > threshold).alias("score"))


def activity_members(y: DataFrame, basis: str = "liked", users: DataFrame | None = None, threshold: float = LIKED) -> DataFrame:
    """(userid, grp) by size of the history that is liked or seen. With users (userid) those without any such history, known to y or
    not, are interaction_0."""
    if basis not in ("liked", "seen"):
        raise ValueError(basis)
    counts = activity(y.where("y <> 0"), threshold).select("userid", F.col(f"n_{basis}").alias("n"))
    if users is not None:
        counts = users.select("userid").distinct().join(counts, "userid", "left").select("userid", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.select("userid", F.when(F.col("n") == 0, ZERO).otherwise(group_of(F.col("n"))).alias("grp")).where(F.lit(users is not None) | (F.col("grp") != ZERO))


def named_members(users: DataFrame, groups: dict[str, DataFrame]) -> DataFrame:
    """(userid, grp) of groups by name, each a table with userid; a user may be in several. No group at all, the name "all" and users
    that are not among the given are errors."""
    if not groups:
        raise ValueError("there must be a group")
    if "all" in groups:
        raise ValueError("every user is in all: a group cannot be called so")
    parts = [df.select("userid", F.lit(name).alias("grp")).distinct() for name, df in groups.items()]
    out = functools.reduce(DataFrame.unionByName, parts)
    if strange := out.join(users.select("userid"), "userid", "left_anti").count():
        raise ValueError(f"{strange} members are no known users")
    return out
