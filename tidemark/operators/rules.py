"""Association rules from what users like and the clusters they and items are in, and the signal that rules give."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from . import kmeans
from .cooccurrence import PAIRS_A_TASK, counts, directed_counts, half_counts, met, pair_count
from .feedback import LIKED, liked, seen
from .positions import codes
from .ranking import top_popular, top_sparse

#: Starts of a clustering, of which the one of least cost counts.
STARTS = 10
# The families of rules and the ways to normalise.
KINDS = ("item", "icl", "ucl")
NORMALISERS = ("row_max", "log_row_max")


def one_rows(y: DataFrame, of: str, threshold: float = LIKED) -> tuple[DataFrame, int]:
    """(of, ones: sorted numbers of what is liked) of every user or item of y, and how many numbers there are; written."""
    other = "itemid" if of == "userid" else "userid"
    numbers = written(codes(y, other), "numbers")
    own = liked(y, threshold).join(numbers, other).groupBy(of).agg(F.array_sort(F.collect_set("idx")).alias("ones"))
    none = F.array().cast("array<long>")
    return written(y.select(of).distinct().join(own, of, "left").select(of, F.coalesce("ones", none).alias("ones")), "rows"), numbers.count()


def clusters(y: DataFrame, of: str, k: int, seed: int = 42, threshold: float = LIKED) -> DataFrame | None:
    """(of, cluster) for of = userid or itemid by k-means over sparse rows of likes. Rows without a like teach nothing but
    get a cluster. None, which is all in cluster 0, for k = 1 or without likes."""
    if k == 1 or liked(y, threshold).isEmpty():
        return None
    rows, width = one_rows(y, of, threshold)
    return compacted(kmeans.fit(rows, width, k, STARTS, seed))


def compacted(labels: DataFrame) -> DataFrame:
    """Labels with their clusters numbered anew, without gaps and in the same order."""
    own = labels.columns[0]
    return labels.join(F.broadcast(codes(labels, "cluster", "_new")), "cluster").select(own, F.col("_new").cast("int").alias("cluster"))


def tokens(y: DataFrame, user_cluster: DataFrame | None = None, item_cluster: DataFrame | None = None, threshold: float = LIKED) -> DataFrame:
    """(userid, kind, token): liked items, the cluster of every observed user, clusters of liked items.

    Clusters are (userid, cluster) and (itemid, cluster); without them all are in cluster 0.
    """
    likes = liked(y, threshold)
    users = seen(y).select("userid").distinct()
    ucl = users.join(user_cluster, "userid") if user_cluster is not None else users.withColumn("cluster", F.lit(0))
    icl = likes.join(item_cluster, "itemid") if item_cluster is not None else likes.withColumn("cluster", F.lit(0))
    of = "string" if dict(y.dtypes)["itemid"] == "string" else "long"
    kind = lambda df, name, token: df.select("userid", F.lit(name).alias("kind"), F.col(token).cast(of).alias("token"))
    return kind(likes, "item", "itemid").unionByName(kind(ucl, "ucl", "cluster")).unionByName(kind(icl, "icl", "cluster").distinct())


def token_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("kind", "token").agg(F.count("*").alias("n"))


def pairs(t: DataFrame) -> DataFrame:
    """(kind, token, itemid, n): users with the token who like the item, another one than itself."""
    return counts(_items(t)).select(F.lit("item").alias("kind"), F.col("i").alias("token"), F.col("j").alias("itemid"), "n").unionByName(_by_cluster(t))


def _items(t: DataFrame) -> DataFrame:
    return t.where("kind = 'item'").select("userid", F.col("token").alias("itemid"))


def _by_cluster(t: DataFrame) -> DataFrame:
    return met(t.where("kind <> 'item'"), _items(t)).groupBy("kind", "token", "itemid").agg(F.count("*").alias("n"))


def frequent(t: DataFrame, count: DataFrame, users: int, min_support: float) -> DataFrame:
    """The tokens that enough users have: a pair is no more frequent than either side, so no rule of that support is lost."""
    often = count.where(F.col("n") / F.lit(float(users)) >= min_support)
    return t.join(often.select("kind", "token"), ["kind", "token"], "left_semi")


def rules(y: DataFrame, t: DataFrame, min_support: float = 0.0, min_confidence: float = 0.0, min_lift: float = 0.0) -> DataFrame:
    """(kind, token, itemid, n, support, confidence, lift) of pairs that reach all three bounds."""
    users = y.select("userid").distinct().count()
    count = token_counts(t)
    items = count.where("kind = 'item'").select(F.col("token").alias("itemid"), F.col("n").alias("n_item"))
    often = frequent(t, count, users, min_support) if min_support > 0 else t
    # pairs of items bring their counts along: there are too many of them to be joined
    half = half_counts(_items(often).join(items, "itemid"), "n_item")
    way = lambda i, j: F.struct(F.col(i).alias("token"), F.col(j).alias("itemid"), F.col(f"n_item_{i}").alias("n_token"), F.col(f"n_item_{j}").alias("n_item"))
    of_items = half.select(F.lit("item").alias("kind"), "n", F.explode(F.array(way("i", "j"), way("j", "i"))).alias("p")).select("kind", "n", "p.*")
    of_clusters = _by_cluster(often).join(F.broadcast(count.where("kind <> 'item'").withColumnRenamed("n", "n_token")), ["kind", "token"]).join(items, "itemid")
    both = of_items.unionByName(of_clusters)
    out = both.select("kind", "token", "itemid", "n", (F.col("n") / F.lit(float(users))).alias("support"), (F.col("n") / F.col("n_token").cast("double")).alias("confidence"), (F.col("n") * F.lit(float(users)) / (F.col("n_token").cast("double") * F.col("n_item"))).alias("lift"))
    return out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def item_rules(t: DataFrame) -> Callable[[int, int], DataFrame]:
    """share(n, of): (token, itemid, confidence) of the rules() of liked items that a hash deals to share n, without bounds. Pairs are
    made for the items of the share alone, so no more of them lies on disk at a time."""
    likes = _items(t)

    def share(n: int, of: int) -> DataFrame:
        mine = likes.where(F.pmod(F.xxhash64("itemid"), F.lit(of)) == n)
        mine = mine.join(mine.groupBy("itemid").agg(F.count("*").alias("n_token")), "itemid")
        tasks = max(t.sparkSession.sparkContext.defaultParallelism, math.ceil(2 * pair_count(likes) / of / PAIRS_A_TASK))
        met_ = directed_counts(mine, likes, tasks, "n_token")
        return met_.select(F.col("i").alias("token"), F.col("j").alias("itemid"), (F.col("n") / F.col("n_token").cast("double")).alias("confidence"))

    return share


def signal(t: DataFrame, found: DataFrame, observed: DataFrame, kinds: tuple[str, ...] = ("item", "icl", "ucl")) -> DataFrame:
    """(userid, itemid, s): summed confidence of the rules that a user's tokens fire, for items not seen."""
    fired = t.where(F.col("kind").isin(*kinds)).join(found.where(F.col("kind").isin(*kinds)).select("kind", "token", "itemid", "confidence"), ["kind", "token"])
    return fired.groupBy("userid", "itemid").agg(F.sum("confidence").alias("s")).join(observed, ["userid", "itemid"], "left_anti")


def normalised(s: DataFrame, how: str = "row_max") -> DataFrame:
    """The signal over its user's highest, after log1p for log_row_max."""
    if how not in NORMALISERS:
        raise ValueError(how)
    value = F.log1p("s") if how == "log_row_max" else F.col("s")
    return s.withColumn("s", value).withColumn("s", F.col("s") / F.max("s").over(Window.partitionBy("userid")))


@dataclass(frozen=True)
class Signal:
    """A signal without a row for every user and item: what users with the same clusters share is kept once.

    users (userid, profile, scale), base (profile, itemid, s), cells (userid, itemid, s), seen (userid, itemid). A cell has
    its value; any other item of the user's profile that is not seen has scale * s; all else has none.
    """

    users: DataFrame
    base: DataFrame
    cells: DataFrame
    seen: DataFrame

    def of(self, some: DataFrame) -> Signal:
        """The same for some users (userid) alone."""
        return Signal(*(df if "profile" in df.columns and "userid" not in df.columns else df.join(some.select("userid"), "userid", "left_semi") for df in (self.users, self.base, self.cells, self.seen)))

    def corrections(self) -> DataFrame:
        """(userid, itemid, own, shared): the user's own cells with their value and, if the profile has the item too, what they
        replace; and items of the profile that are seen, without a value of their own."""
        base = self.base.withColumnRenamed("s", "b")
        shared = (F.col("scale") * F.col("b")).alias("shared")
        own = self.cells.join(self.users, "userid", "left").join(base, ["profile", "itemid"], "left").select("userid", "itemid", F.col("s").alias("own"), shared)
        gone = self.seen.join(self.users, "userid").join(base, ["profile", "itemid"]).select("userid", "itemid", F.lit(None).cast("double").alias("own"), shared)
        return own.unionByName(gone)

    def delta(self) -> DataFrame:
        """(userid, itemid, w, r): the weight and the value that corrections() add to what the profile gives."""
        one = lambda c: F.col(c).isNotNull().cast("double")
        return self.corrections().select("userid", "itemid", (one("own") - one("shared")).alias("w"), (F.coalesce("own", F.lit(0.0)) - F.coalesce("shared", F.lit(0.0))).alias("r"))

    def shared_top(self, k: int, by: str = "s") -> DataFrame:
        """(userid, itemid, score): the k best of each user's profile that are not seen, own cells or not, by value or by item."""
        scores = self.base.select("profile", "itemid", F.col(by).alias("score"))
        return top_popular(scores, self.users.select("userid", "profile"), self.seen, k, "profile").select("userid", "itemid", "score")

    def digest(self) -> DataFrame:
        """(userid, n, total, top, last_item) of each user with a signal."""
        some = self.base.groupBy("profile").agg(F.count("*").alias("n_base"), F.sum("s").alias("total_base"))
        first = self.shared_top(1).select("userid", F.col("score").alias("top_base"))
        last = self.shared_top(1, "itemid").select("userid", F.col("itemid").alias("last_base"))
        own = self.corrections().groupBy("userid").agg(F.sum(F.col("own").isNotNull().cast("long") - F.col("shared").isNotNull().cast("long")).alias("n_more"), F.sum(F.coalesce("own", F.lit(0.0)) - F.coalesce("shared", F.lit(0.0))).alias("more"), F.max("own").alias("top_own"), F.max(F.when(F.col("own").isNotNull(), F.col("itemid"))).alias("last_own"))
        zero = F.lit(0)
        rows = self.users.join(F.broadcast(some), "profile", "left").drop("profile").join(own, "userid", "full").join(first, "userid", "left").join(last, "userid", "left")
        n = (F.coalesce("n_base", zero) + F.coalesce("n_more", zero)).cast("long")
        total = F.coalesce(F.col("scale") * F.col("total_base"), F.lit(0.0)) + F.coalesce("more", F.lit(0.0))
        return rows.where(n > 0).select("userid", n.alias("n"), total.alias("total"), F.greatest(F.col("scale") * F.col("top_base"), "top_own").alias("top"), F.greatest("last_base", "last_own").alias("last_item"))

    def normalised(self, how: str = "row_max") -> Signal:
        """Over each user's highest value, after log1p for log_row_max."""
        if how not in NORMALISERS:
            raise ValueError(how)
        value = F.log1p("s") if how == "log_row_max" else F.col("s")
        raw = Signal(self.users, *(df.withColumn("s", value) for df in (self.base, self.cells)), self.seen)
        own = raw.cells.groupBy("userid").agg(F.max("s").alias("top_own"))
        tops = raw.shared_top(1).select("userid", F.col("score").alias("top_base")).join(own, "userid", "full").select("userid", F.greatest("top_base", "top_own").alias("top"))
        tops = written(tops, "tops")
        users = self.users.join(tops, "userid", "left").select("userid", "profile", F.coalesce(1 / F.col("top"), F.lit(1.0)).alias("scale"))
        cells = raw.cells.join(tops, "userid").select("userid", "itemid", (F.col("s") / F.col("top")).alias("s"))
        return Signal(written(users, "profiles"), raw.base, written(cells, "cells"), self.seen)

    def top(self, users: DataFrame, items: DataFrame, k: int, digits: int = 9) -> DataFrame:
        """(userid, itemid, score, rank): the k best by rounded value, then items without one in order.

        An item's value is no less than what its profile gives, so only the best own cells and the k best of the profile count.
        """
        own = self.of(users)
        rounded = Signal(own.users, own.base.withColumn("s", F.round("s", digits)), own.cells.withColumn("s", F.round("s", digits)), own.seen)
        both = rounded.shared_top(k).unionByName(rounded.cells.withColumnRenamed("s", "score"))
        return top_sparse(both.groupBy("userid", "itemid").agg(F.max("score").alias("score")), users, items, own.seen, k)

    def quantised(self) -> Signal:
        """Values in single precision."""
        return Signal(self.users, *(df.withColumn("s", F.col("s").cast("float").cast("double")) for df in (self.base, self.cells)), self.seen)

    def rows(self) -> DataFrame:
        """(userid, itemid, s) of every cell: users x items, for small data alone."""
        d = self.corrections()
        shared = self.users.join(self.base, "profile").select("userid", "itemid", (F.col("scale") * F.col("s")).alias("s"))
        return shared.join(d, ["userid", "itemid"], "left_anti").unionByName(d.where("own is not null").select("userid", "itemid", F.col("own").alias("s")))

    def collect(self) -> list:
        return self.rows().collect()


def factored(t: DataFrame, found: DataFrame, observed: DataFrame, kinds: tuple[str, ...] = KINDS) -> Signal:
    """signal() as a Signal: rules of liked items make cells, those of clusters the base of each profile, which is the set of a
    user's cluster tokens (at most as many as there are clusters)."""
    shared = [k for k in kinds if k != "item"]
    key = F.array_sort(F.collect_set(F.concat_ws(":", "kind", "token"))).alias("key")
    profiles = t.where(F.col("kind").isin(shared)).groupBy("userid").agg(key).withColumn("profile", F.xxhash64("key"))
    users = written(profiles.select("userid", "profile", F.lit(1.0).alias("scale"), "key"), "profiles")
    parts = users.groupBy("profile").agg(F.first("key").alias("key")).select("profile", F.explode("key").alias("key"))
    fired = found.withColumn("key", F.concat_ws(":", "kind", "token")).join(F.broadcast(parts), "key")
    base = written(fired.groupBy("profile", "itemid").agg(F.sum("confidence").alias("s")), "base")
    users = users.drop("key")
    if "item" not in kinds:
        return Signal(users, base, observed.sparkSession.createDataFrame([], _cells(observed)), observed)
    own = signal(t, found, observed, ("item",)).withColumnRenamed("s", "own")
    whole = own.join(users, "userid", "left").join(base, ["profile", "itemid"], "left").select("userid", "itemid", (F.col("own") + F.coalesce("s", F.lit(0.0))).alias("s"))
    return Signal(users, base, written(whole, "cells"), observed)


def _cells(seen: DataFrame) -> str:
    kinds = dict(seen.dtypes)
    return f"userid {kinds['userid']}, itemid {kinds['itemid']}, s double"


def full_signal(y: DataFrame, how: str = "row_max", k_user: int = 1, k_item: int = 1, min_support: float = 0.0, min_confidence: float = 0.0, min_lift: float = 0.0, seed: int = 42) -> Signal:
    """The normalised signal of all three families of rules, in single precision."""
    checked(k_user, k_item, min_support, min_confidence, min_lift, how)
    t = written(tokens(y, clusters(y, "userid", k_user, seed), clusters(y, "itemid", k_item, seed)), "tokens")
    found = written(rules(y, t, min_support, min_confidence, min_lift), "rules")
    return factored(t, found, seen(y)).normalised(how).quantised()


def checked(k_user: int, k_item: int, min_support: float, min_confidence: float, min_lift: float, how: str) -> None:
    """Raises ValueError for settings that no signal has."""
    for name, value in (("k_user", k_user), ("k_item", k_item)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} must be a positive whole number")
    for name, value, most in (("min_support", min_support, 1.0), ("min_confidence", min_confidence, 1.0), ("min_lift", min_lift, math.inf)):
        if not math.isfinite(value) or not 0 <= value <= most:
            raise ValueError(f"{name} must be finite, not negative and at most {most}")
    if how not in NORMALISERS:
        raise ValueError(f"normalize must be one of {NORMALISERS}")
