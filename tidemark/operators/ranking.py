"""Top-k lists over the whole catalogue without what a user has seen, and NDCG by cutoff and group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from .feedback import GROUPS, LIKED, group_of
from .positions import codes, numbered

CUTOFFS = (10, 20, 50, 100, 200)
#: A head of so many items is numbered in a window, before which each task keeps no more than these; a longer one by ranges.
HEAD = 1000


def _numbered(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("userid").orderBy(F.desc("score"), "itemid")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_popular(scores: DataFrame, users: DataFrame, seen: DataFrame, k: int, profile: str | None = None) -> DataFrame:
    """(userid, itemid, score, rank) where all users, or all of one profile, share the item scores.

    A user who has seen s items needs the first k + s of the common order alone, so nothing like users x items is made: only
    the head of an order, as long as the longest of these, is asked for, and users meet it by number. A user with a long history
    makes a long head, which no task holds whole.
    """
    by = [profile] if profile else []
    counts = users.join(seen.groupBy("userid").agg(F.count("*").alias("s")), "userid", "left").withColumn("need", (F.coalesce("s", F.lit(0)) + k).cast("int"))
    longest = counts.agg(F.max("need")).first()[0] or 0
    order = [F.desc("score"), F.asc("itemid")]
    if longest <= HEAD:
        return _short_head(scores, users, seen, k, by, order, longest)
    head = numbered(scores, by, order).where(F.col("at") <= longest)
    asked = counts.select("userid", *by, F.explode(F.sequence(F.lit(1), "need")).alias("at"))
    return _numbered(asked.join(head, [*by, "at"]).join(seen, ["userid", "itemid"], "left_anti").select("userid", "itemid", "score"), k)


def _short_head(scores: DataFrame, users: DataFrame, seen: DataFrame, k: int, by: list[str], order: list, longest: int) -> DataFrame:
    """top_popular() where the head and each history fit a row: a user's list is the head less what is seen, so users x head is
    neither joined nor sorted."""
    ranked = scores.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by else scores.orderBy(*order).limit(longest).withColumn("at", F.row_number().over(Window.orderBy(*order)))
    head = written(ranked.where(F.col("at") <= longest).select(*by, "at", "itemid", "score"), "head")
    whole = head.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "itemid"))), lambda x: x["itemid"]).alias("head"))
    own = seen.join(users.select("userid"), "userid", "left_semi").groupBy("userid").agg(F.collect_list("itemid").alias("gone"))
    both = users.select("userid", *by).join(own, "userid", "left")
    both = both.join(whole, by) if by else both.crossJoin(F.broadcast(whole))  # one row
    left = F.when(F.col("gone").isNull(), F.col("head")).otherwise(F.array_except("head", "gone"))
    lists = both.select("userid", *by, F.posexplode(F.slice(left, 1, k)).alias("at", "itemid")).withColumn("rank", F.col("at") + 1).drop("at")
    values = head.drop("at") if by else F.broadcast(head.drop("at"))
    return lists.join(values, [*by, "itemid"]).select("userid", "itemid", "score", "rank")


def top_sparse(scores: DataFrame, users: DataFrame, items: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The same for scores (userid, itemid, score) that are positive where present and 0 elsewhere: the first k, then items in order.

    Of the items without a score at most k + seen + scored of the catalogue's first can be reached.
    """
    own = scores.join(users, "userid", "left_semi").join(seen, ["userid", "itemid"], "left_anti").select("userid", "itemid", "score")
    kept = _numbered(own, k).select("userid", "itemid", "score")
    short = kept.groupBy("userid").agg(F.count("*").alias("n"))
    blocked = seen.join(users, "userid", "left_semi").unionByName(kept.select("userid", "itemid"))
    block = blocked.groupBy("userid").agg(F.count("*").alias("s"))
    need = users.join(short, "userid", "left").join(block, "userid", "left").where(F.coalesce("n", F.lit(0)) < k).select("userid", F.explode(F.sequence(F.lit(0), (F.coalesce("s", F.lit(0)) + k - 1).cast("long"))).alias("idx"))
    fill = need.join(codes(items, "itemid"), "idx").select("userid", "itemid").join(blocked, ["userid", "itemid"], "left_anti").withColumn("score", F.lit(0.0))
    return _numbered(kept.unionByName(fill), k)


def eligible(y: DataFrame, target: DataFrame, threshold: float = LIKED, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(userid, grp) of users with a positive history and a positive target, and their targets.

    With members (userid, grp; a user may be in several groups) users are those of any group that have a positive target."""
    goal = target.where(F.col("y") > threshold).select("userid", "itemid")
    if members is not None:
        users = members.select("userid", "grp").distinct().join(goal.select("userid").distinct(), "userid", "left_semi")
        return users, goal.join(users.select("userid"), "userid", "left_semi")
    history = y.where(F.col("y") > threshold).groupBy("userid").agg(F.count("*").alias("n"))
    users = history.join(goal.select("userid").distinct(), "userid", "left_semi").select("userid", group_of(F.col("n")).alias("grp"))
    return users, goal.join(users.select("userid"), "userid", "left_semi")


def ndcg(top: DataFrame, users: DataFrame, goal: DataFrame, ranked: DataFrame, cutoffs=CUTOFFS, groups=GROUPS, runs: int | None = None) -> DataFrame:
    """(grp, cutoff, ndcg, n_users) for "all" and every group; 0 for a group without users. With runs top has lists of so many runs
    (run, from 0), and the result rows of each.

    users (userid, grp) may hold a user in several groups: it counts in each of them, and once in "all". ranked (userid, n_ranked) says how many items a user's list could hold; the ideal gain counts targets that were masked.
    """
    ks = F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")
    by = [] if runs is None else ["run"]
    hits = top.join(goal, ["userid", "itemid"], "left_semi").select(*by, "userid", "rank")
    gain = hits.select(*by, "userid", "rank", ks).where("rank <= cutoff").groupBy(*by, "userid", "cutoff").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    size = goal.groupBy("userid").agg(F.count("*").alias("n_goal"))
    best = F.least("n_goal", F.least(F.col("cutoff").cast("long"), F.col("n_ranked")))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1.0))
    everyone = users.select("userid").distinct()
    known = everyone.join(size, "userid").join(ranked.dropDuplicates(["userid"]), "userid").select("userid", "n_goal", "n_ranked", ks)
    if by:
        known = known.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    per = known.join(gain, [*by, "userid", "cutoff"], "left").withColumn("value", F.when(best > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0))
    grouped = per.join(users.select("userid", "grp").distinct(), "userid")
    long = per.select(*by, "cutoff", "value", F.lit("all").alias("grp")).unionByName(grouped.select(*by, "cutoff", "value", "grp"))
    got = long.groupBy(*by, "grp", "cutoff").agg(F.avg("value").alias("ndcg"), F.count("*").alias("n_users"))
    frame = users.sparkSession.createDataFrame([(g, k) for g in ("all", *groups) for k in cutoffs], "grp string, cutoff int")
    if by:
        frame = frame.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return frame.join(got, [*by, "grp", "cutoff"], "left").select(*by, "grp", "cutoff", F.round(F.coalesce("ndcg", F.lit(0.0)), 9).alias("ndcg"), F.coalesce("n_users", F.lit(0)).cast("long").alias("n_users"))


def list_sizes(users: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """(userid, n_ranked): catalogue items that a user has not seen."""
    n = items.select("itemid").distinct().count()
    return users.join(seen.groupBy("userid").agg(F.count("*").alias("s")), "userid", "left").select("userid", (F.lit(n) - F.coalesce("s", F.lit(0))).cast("long").alias("n_ranked"))
