"""The library's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextvars import ContextVar
from urllib.parse import quote

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence, factors, feedback, fired, graph, kmeans, lightgcn, neumf, ranking, rules, sampling, split
from ..operators.positions import codes
from ..sources import interactions as log
from ..storage import passing, shared_dir, written
from . import reports
from .models import MODELS, SearchScores, Stages, Windows, fit_model, fit_signal
from .search import Fit, best_of, mean_sd, planned, random_search, resumed, sample_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Not for the driver: the same queries over fixture I2, and queries over literals, with their SQL. Tests run them.
FIXTURES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIXTURE_SQL: dict[str, str] = {}

# What the fixture keeps of the order lines: a seventh of them, for cold users.
_FIRST_LINES = " WHERE l_linenumber = 1"
_whole: ContextVar[bool] = ContextVar("whole", default=False)


def _over_whole_log(f):
    def run(spark, sf_dir):
        token = _whole.set(True)
        try:
            return f(spark, sf_dir)
        finally:
            _whole.reset(token)

    return run


def query(sql: str | None = None, whole: bool = True, fixture: bool = False):
    """Registers a query. One whose SQL takes fixture I2 is a fixture, and registered over all order lines as whole_..., with the
    same SQL less the filter (unless whole is false); one without SQL takes all order lines."""

    def add(f):
        if sql and (fixture or _FIRST_LINES in sql):
            FIXTURES[f.__name__], FIXTURE_SQL[f.__name__] = f, sql
            if whole and not fixture:
                QUERIES[f"whole_{f.__name__}"], ORACLE[f"whole_{f.__name__}"] = _over_whole_log(f), sql.replace(_FIRST_LINES, "")
        elif sql:
            QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        else:
            (FIXTURES if fixture else QUERIES)[f.__name__] = _over_whole_log(f)
        return f

    return add


def _log(spark, sf_dir):
    return log.earliest(log.dense(spark, sf_dir)) if _whole.get() else log.sparse(spark, sf_dir)


def _split(spark, sf_dir):
    """The log with its windows; the joined and cleaned log is computed once."""
    return split.labelled(written(_log(spark, sf_dir), "log"))


def _final(spark, sf_dir):
    """(fit matrix, evaluation matrix) of the last stage, computed once."""
    y, target = split.fit_and_eval(*split.stage(_split(spark, sf_dir)))
    return written(y, "fit"), written(target, "target")


def _ranks(spark, sf_dir):
    y, target = _final(spark, sf_dir)
    users, goal = ranking.eligible(y, target)
    return y, users, goal


# The tables of the SQL: I1 and I2 are the logs, log is I2 without repeats, then the split of the last stage.
I1 = """I1 AS (SELECT o_custkey AS userid, l_partkey AS itemid, o_orderdate AS ts, 1.0::DOUBLE + floor((l_quantity - 1) / 10) AS rating, l_orderkey, l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LOG = f"""{I1}, log AS (SELECT userid, itemid, ts, rating FROM (SELECT *, row_number() OVER (PARTITION BY userid, itemid ORDER BY ts, rating DESC) AS k FROM I1 WHERE l_linenumber = 1) WHERE k = 1)"""
CUT = f"""{LOG}, starts AS (SELECT ts, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM log GROUP BY ts),
  size AS (SELECT sum(n)::BIGINT AS n_rows, max(start) AS last FROM starts),
  train AS (SELECT start, ts FROM starts, size WHERE start > 0 AND start < last ORDER BY abs(start - floor(n_rows * 0.7::DOUBLE)), start LIMIT 1),
  val AS (SELECT s.start, s.ts FROM starts s, size, train WHERE s.start > train.start ORDER BY abs(s.start - floor(n_rows * (0.7::DOUBLE + 0.1::DOUBLE))), s.start LIMIT 1),
  parts AS (SELECT log.*, CASE WHEN log.ts < (SELECT ts FROM train) THEN 'train' WHEN log.ts < (SELECT ts FROM val) THEN 'val' ELSE 'test' END AS part FROM log)"""


def _stage(fit: str, ahead: str) -> str:
    return f"""{CUT}, fit AS (SELECT * FROM parts WHERE part IN ({fit})), ahead AS (SELECT * FROM parts WHERE part = '{ahead}'),
  y AS (SELECT userid, itemid, max(rating) AS y FROM fit GROUP BY ALL HAVING max(rating) <> 0),
  known AS (SELECT * FROM ahead WHERE userid IN (SELECT userid FROM fit) AND itemid IN (SELECT itemid FROM fit)),
  target AS (SELECT userid, itemid, max(rating) AS y FROM known GROUP BY ALL HAVING max(rating) <> 0),
  likes AS (SELECT userid, itemid FROM y WHERE y > 3.0), items AS (SELECT DISTINCT itemid FROM fit)"""


FIT = _stage("'train', 'val'", "test")
VAL = _stage("'train'", "val")
GOAL = f"""{FIT}, history AS (SELECT userid, count(*) AS n FROM likes GROUP BY userid),
  goal AS (SELECT userid, itemid FROM target WHERE y > 3.0 AND userid IN (SELECT userid FROM history)),
  users AS (SELECT userid, CASE WHEN n = 1 THEN 'interaction_1' WHEN n = 2 THEN 'interaction_2' ELSE 'interaction_3_plus' END AS grp FROM history WHERE userid IN (SELECT userid FROM goal)),
  scores AS (SELECT itemid, count(*) FILTER (y > 3.0) AS score FROM y GROUP BY itemid)"""


def _top(k: int, score: str = "s.score", join: str = "JOIN scores s ON s.itemid = i.itemid") -> str:
    return f""", ranked AS (SELECT * FROM (SELECT u.userid, i.itemid, {score} AS score, row_number() OVER (PARTITION BY u.userid ORDER BY {score} DESC, i.itemid) AS rank
    FROM users u CROSS JOIN items i {join} WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.userid = u.userid AND y.itemid = i.itemid)) WHERE rank <= {k})"""


NDCG = """, sizes AS (SELECT userid, count(*) AS n_goal FROM goal GROUP BY userid),
  rooms AS (SELECT u.userid, (SELECT count(*) FROM items) - (SELECT count(*) FROM y WHERE y.userid = u.userid) AS n_ranked FROM users u),
  ks AS (SELECT unnest([10, 20, 50, 100, 200]) AS cutoff),
  gains AS (SELECT r.userid, cutoff, sum(1 / log2(rank + 1)) AS dcg FROM ranked r JOIN goal USING (userid, itemid) JOIN ks ON rank <= cutoff GROUP BY ALL),
  ideal AS (SELECT m, sum(1 / log2(m + 1)) OVER (ORDER BY m) AS idcg FROM range(1, 201) t(m)),
  per AS (SELECT u.userid, grp, ks.cutoff, coalesce(dcg, 0) / idcg AS value FROM users u JOIN sizes USING (userid) JOIN rooms USING (userid) CROSS JOIN ks
    JOIN ideal ON m = least(n_goal, ks.cutoff, n_ranked) LEFT JOIN gains g ON g.userid = u.userid AND g.cutoff = ks.cutoff),
  long AS (SELECT 'all' AS grp, cutoff, value FROM per UNION ALL SELECT grp, cutoff, value FROM per)
  SELECT g.grp, ks.cutoff::INT AS cutoff, round(coalesce(avg(value), 0), 9) AS ndcg, count(value)::BIGINT AS n_users
  FROM (SELECT unnest(['all', 'interaction_1', 'interaction_2', 'interaction_3_plus']) AS grp) g CROSS JOIN ks LEFT JOIN long ON long.grp = g.grp AND long.cutoff = ks.cutoff GROUP BY g.grp, ks.cutoff"""
RULES = f"""{FIT}, tokens AS (SELECT userid, 'item' AS kind, itemid::BIGINT AS token FROM likes UNION ALL SELECT DISTINCT userid, 'ucl', 0 FROM y UNION ALL SELECT DISTINCT userid, 'icl', 0 FROM likes),
  counts AS (SELECT kind, token, count(*) AS n FROM tokens GROUP BY ALL),
  met AS (SELECT t.kind, t.token, l.itemid, count(*) AS n FROM tokens t JOIN likes l USING (userid) WHERE NOT (t.kind = 'item' AND t.token = l.itemid) GROUP BY ALL),
  found AS (SELECT m.kind, m.token, m.itemid, m.n, m.n / (SELECT count(DISTINCT userid) FROM y)::DOUBLE AS support, m.n / c.n::DOUBLE AS confidence,
    m.n * (SELECT count(DISTINCT userid) FROM y)::DOUBLE / (c.n::DOUBLE * i.n) AS lift
    FROM met m JOIN counts c ON c.kind = m.kind AND c.token = m.token JOIN counts i ON i.kind = 'item' AND i.token = m.itemid)"""
SIGNAL = f"""{RULES}, signal AS (SELECT t.userid, f.itemid, sum(f.confidence) AS s FROM tokens t JOIN found f ON f.kind = t.kind AND f.token = t.token
    WHERE KINDS AND NOT EXISTS (SELECT 1 FROM y WHERE y.userid = t.userid AND y.itemid = f.itemid) GROUP BY ALL)"""
DIGEST = "SELECT userid, count(*)::BIGINT AS n, round(sum(s), 6) AS total, round(max(s), 6) AS top, max(itemid)::BIGINT AS last_item FROM signal GROUP BY userid"
ALL_KINDS, PERSONAL, GENERIC = "TRUE", "t.kind IN ('item', 'icl')", "t.kind = 'ucl'"
NORMAL = SIGNAL.replace("signal AS", "raw AS").replace("KINDS", ALL_KINDS) + ", signal AS (SELECT userid, itemid, VALUE / max(VALUE) OVER (PARTITION BY userid) AS s FROM raw)"
COUNTS = f"{FIT}, c AS (SELECT a.itemid AS i, b.itemid AS j, count(*) AS n FROM likes a JOIN likes b ON a.userid = b.userid AND a.itemid <> b.itemid GROUP BY ALL)"
PMI = f"{COUNTS}, f AS (SELECT i, sum(n) AS f FROM c GROUP BY i), m AS (SELECT c.i, c.j, ln(c.n * (SELECT sum(n) FROM c)::DOUBLE / (a.f::DOUBLE * b.f)) - ln(NEG) AS value FROM c JOIN f a ON a.i = c.i JOIN f b ON b.i = c.j)"
GRAPH = f"""{FIT}, e AS (SELECT 'u' || userid AS src, 'i' || itemid AS dst FROM likes UNION ALL SELECT 'i' || itemid, 'u' || userid FROM likes),
  d AS (SELECT src, count(*) AS degree FROM e GROUP BY src), a AS (SELECT e.src, e.dst, 1.0 / sqrt(x.degree::DOUBLE * z.degree) AS w FROM e JOIN d x ON x.src = e.src JOIN d z ON z.src = e.dst)"""


# ---- sources and cleaning
@query(f"WITH {I1} SELECT userid, itemid, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, rating FROM I1")
def ingest_project_rename(spark, sf_dir):
    return log.dense(spark, sf_dir).select("userid", "itemid", F.date_format("ts", log.LOG_TIME).alias("ts"), "rating")


@query(f"WITH {I1}, raw AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN userid END AS userid, itemid, CASE WHEN l_orderkey % 11 <> 0 THEN ts END AS ts, rating FROM I1) SELECT userid::VARCHAR AS userid, itemid::VARCHAR AS itemid, ts::TIMESTAMP AS ts, rating FROM raw WHERE userid IS NOT NULL AND ts IS NOT NULL")
def ingest_dropna_typed(spark, sf_dir):
    text = log.dense(spark, sf_dir).select(F.when(F.col("l_orderkey") % 7 != 0, F.col("userid").cast("string")).alias("userid"), F.col("itemid").cast("string").alias("itemid"), F.when(F.col("l_orderkey") % 11 != 0, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")).otherwise("soon").alias("ts"), F.col("rating").cast("string").alias("rating"))
    return log.complete(log.typed(text))


@query(f"WITH {I1} SELECT userid, itemid, ts, rating FROM (SELECT *, row_number() OVER (PARTITION BY userid, itemid ORDER BY ts, rating DESC) AS k FROM I1) WHERE k = 1")
def ingest_dedupe_earliest(spark, sf_dir):
    return log.earliest(log.dense(spark, sf_dir))


@query(f"WITH {I1} SELECT count(*)::BIGINT AS n_raw, 0::BIGINT AS n_invalid, (count(*) - count(DISTINCT (userid, itemid)))::BIGINT AS n_duplicate, count(DISTINCT (userid, itemid))::BIGINT AS n_kept, count(DISTINCT userid)::BIGINT AS n_users, count(DISTINCT itemid)::BIGINT AS n_items FROM I1")
def ingest_audit_counts(spark, sf_dir):
    return log.audit(log.dense(spark, sf_dir))


@query(f"WITH {LOG} SELECT userid, itemid, ts, rating FROM log ORDER BY ts, userid, itemid")
def event_log_sorted(spark, sf_dir):
    return _log(spark, sf_dir).orderBy("ts", "userid", "itemid")


@query("SELECT event_id, user_id AS userid, (props->>'$.k')::BIGINT AS itemid, ts, CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'signup' THEN 4.0 WHEN 'click' THEN 3.0 WHEN 'view' THEN 2.0 WHEN 'error' THEN 1.0 END::DOUBLE AS rating FROM events")
def json_field_extract(spark, sf_dir):
    return log.events(spark, sf_dir)


# ---- views
@query(f"WITH {FIT} SELECT userid, itemid, y, 1 AS b, (y > 3.0)::INT AS l FROM y")
def feedback_views_ybl(spark, sf_dir):
    return _final(spark, sf_dir)[0].select("userid", "itemid", "y", F.lit(1).alias("b"), (F.col("y") > feedback.LIKED).cast("int").alias("l"))


@query(f"WITH {FIT} SELECT userid, count(*)::BIGINT AS n_seen, count(*) FILTER (y > 3.0)::BIGINT AS n_liked FROM y GROUP BY userid")
def activity_counts(spark, sf_dir):
    return feedback.activity(_final(spark, sf_dir)[0])


def _groups(column: str) -> str:
    return f"WITH {FIT}, a AS (SELECT userid, count(*) AS n_seen, count(*) FILTER (y > 3.0) AS n_liked FROM y GROUP BY userid) SELECT CASE WHEN {column} = 1 THEN 'interaction_1' WHEN {column} = 2 THEN 'interaction_2' WHEN {column} >= 3 THEN 'interaction_3_plus' END AS grp, count(*)::BIGINT AS n_users FROM a WHERE {column} > 0 GROUP BY 1"


@query(_groups("n_liked"))
def activity_groups(spark, sf_dir):
    return feedback.activity(_final(spark, sf_dir)[0]).where("n_liked > 0").groupBy(feedback.group_of(F.col("n_liked")).alias("grp")).agg(F.count("*").alias("n_users"))


@query(_groups("n_seen"))
def activity_groups_seen_basis(spark, sf_dir):
    return feedback.activity(_final(spark, sf_dir)[0]).groupBy(feedback.group_of(F.col("n_seen")).alias("grp")).agg(F.count("*").alias("n_users"))


# ---- split
@query(f"WITH {CUT} SELECT ts, n::BIGINT AS n, start FROM starts WHERE start > 0")
def split_change_points(spark, sf_dir):
    return split.starts(_log(spark, sf_dir)).where("start > 0").select("ts", "n", "start")


@query(f"WITH {CUT} SELECT n_rows, (SELECT start FROM train) AS train_end, (SELECT start FROM val) AS val_end, (SELECT ts FROM train) AS train_cut, (SELECT ts FROM val) AS val_cut FROM size")
def split_boundaries(spark, sf_dir):
    return split.cuts(_log(spark, sf_dir))


@query(f"WITH {CUT} SELECT userid, itemid, ts, part FROM parts")
def split_labels(spark, sf_dir):
    return _split(spark, sf_dir).select("userid", "itemid", "ts", "part")


@query(f"WITH {CUT} SELECT part, count(*)::BIGINT AS n, count(DISTINCT userid)::BIGINT AS n_users, count(DISTINCT itemid)::BIGINT AS n_items, min(ts) AS first_ts, max(ts) AS last_ts FROM parts GROUP BY part")
def split_partition_stats(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("userid").alias("n_users"), F.count_distinct("itemid").alias("n_items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {FIT} SELECT * FROM y")
def fit_matrix(spark, sf_dir):
    return _final(spark, sf_dir)[0]


@query(f"WITH {FIT} SELECT * FROM target")
def eval_matrix(spark, sf_dir):
    return _final(spark, sf_dir)[1]


@query(f"WITH {FIT} SELECT userid, (row_number() OVER (ORDER BY userid) - 1)::BIGINT AS idx FROM (SELECT DISTINCT userid FROM fit)")
def user_dim(spark, sf_dir):
    return codes(split.stage(_split(spark, sf_dir))[0], "userid")


@query(f"WITH {FIT} SELECT itemid, (row_number() OVER (ORDER BY itemid) - 1)::BIGINT AS idx FROM items")
def item_dim(spark, sf_dir):
    return codes(split.stage(_split(spark, sf_dir))[0], "itemid")


_DROPS = """count(*) FILTER (nu)::BIGINT AS future_user, count(*) FILTER (nu AND rating > 3.0)::BIGINT AS future_user_positive, count(*) FILTER (NOT nu AND ni)::BIGINT AS future_item, count(*) FILTER (NOT nu AND ni AND rating > 3.0)::BIGINT AS future_item_positive
  FROM (SELECT rating, userid NOT IN (SELECT userid FROM fit) AS nu, itemid NOT IN (SELECT itemid FROM fit) AS ni FROM ahead)"""


@query(f"WITH {FIT} SELECT {_DROPS}")
def eval_drop_stats(spark, sf_dir):
    return split.drop_stats(*split.stage(_split(spark, sf_dir)))


@query(f"WITH {FIT} SELECT userid, itemid, ts, rating FROM ahead WHERE userid NOT IN (SELECT userid FROM fit)", whole=False)  # the whole log has none at sf0.001
def eval_unknown_users(spark, sf_dir):
    fit, ahead = split.stage(_split(spark, sf_dir))
    return ahead.join(fit.select("userid").distinct(), "userid", "left_anti").select("userid", "itemid", "ts", "rating")


_EARLY = FIT.replace(_FIRST_LINES, "").replace("0.7::DOUBLE", "0.05::DOUBLE").replace("0.1::DOUBLE", "0.15::DOUBLE").replace("part IN ('train', 'val')", "part = 'train'").replace("part = 'test'", "part = 'val'")


@query(f"WITH {_EARLY} SELECT userid, itemid, ts, rating FROM ahead WHERE userid NOT IN (SELECT userid FROM fit)")
def whole_eval_unknown_users(spark, sf_dir):
    """Over all order lines with the first twentieth to fit on, by which not every user has come."""
    log_ = written(log.earliest(log.dense(spark, sf_dir)), "log")
    fit, ahead = split.stage(split.labelled(log_, (0.05, 0.15, 0.8)), final=False)
    return ahead.join(fit.select("userid").distinct(), "userid", "left_anti").select("userid", "itemid", "ts", "rating")


@query(f"WITH {FIT} SELECT userid, itemid, ts, rating FROM known")
def eval_known_pairs(spark, sf_dir):
    return split.known_events(*split.stage(_split(spark, sf_dir))).select("userid", "itemid", "ts", "rating")


_SHAPE = "count(DISTINCT userid)::BIGINT AS n_users, count(DISTINCT itemid)::BIGINT AS n_items, count(*)::BIGINT AS n_interactions, round(100.0::DOUBLE * count(*) / (count(DISTINCT userid) * count(DISTINCT itemid)), 6) AS density_pct, round(100.0::DOUBLE - 100.0::DOUBLE * count(*) / (count(DISTINCT userid) * count(DISTINCT itemid)), 6) AS sparsity_pct"


@query(f"WITH {LOG} SELECT {_SHAPE} FROM log")
def eda_raw(spark, sf_dir):
    return split.raw_stats(_log(spark, sf_dir))


def _eda(stage: str) -> str:
    return f"""WITH {stage}, history AS (SELECT userid, count(*) AS n FROM likes GROUP BY userid), able AS (SELECT * FROM history WHERE userid IN (SELECT userid FROM target WHERE y > 3.0))
  SELECT * FROM (SELECT {_SHAPE} FROM target), (SELECT count(*)::BIGINT AS n_users_eval, count(*) FILTER (n = 1)::BIGINT AS interaction_1, count(*) FILTER (n = 2)::BIGINT AS interaction_2, count(*) FILTER (n >= 3)::BIGINT AS interaction_3_plus FROM able), (SELECT {_DROPS})"""


@query(_eda(VAL))
def eda_val(spark, sf_dir):
    return split.eval_stats(*split.stage(_split(spark, sf_dir), final=False))


@query(_eda(FIT))
def eda_test(spark, sf_dir):
    return split.eval_stats(*split.stage(_split(spark, sf_dir)))


# ---- popularity and ranking
@query(f"WITH {GOAL} SELECT itemid, score::BIGINT AS score FROM scores")
def mostpop_scores(spark, sf_dir):
    return feedback.popularity(_final(spark, sf_dir)[0])


def _popular(spark, sf_dir, k):
    y, users, goal = _ranks(spark, sf_dir)
    return y, users, goal, ranking.top_popular(feedback.popularity(y), users.select("userid"), feedback.seen(y), k)


@query(f"WITH {GOAL}{_top(20)} SELECT userid, itemid, score::BIGINT AS score, rank::INT AS rank FROM ranked")
def mostpop_topk(spark, sf_dir):
    return _popular(spark, sf_dir, 20)[3].select("userid", "itemid", "score", "rank")


@query(f"WITH {GOAL}{_top(200)}{NDCG}")
def ndcg_all_cutoffs_by_group(spark, sf_dir):
    y, users, goal, top = _popular(spark, sf_dir, 200)
    return ranking.ndcg(top, users, goal, ranking.list_sizes(users.select("userid"), y, feedback.seen(y)))


@query(f"SELECT cutoff, ndcg FROM (WITH {GOAL}{_top(200)}{NDCG}) WHERE grp = 'all'")
def mostpop_ndcg(spark, sf_dir):
    return ndcg_all_cutoffs_by_group(spark, sf_dir).where("grp = 'all'").select("cutoff", "ndcg")


# ---- rules and signal
def _rules(spark, sf_dir):
    y = _final(spark, sf_dir)[0]
    t = rules.tokens(y)
    return y, t, rules.rules(y, t)


_MEMBERS = NDCG.replace("UNION ALL SELECT grp, cutoff, value FROM per)", "UNION ALL SELECT grp, cutoff, value FROM per UNION ALL SELECT 'even', cutoff, value FROM per WHERE userid % 2 = 0 UNION ALL SELECT 'third', cutoff, value FROM per WHERE userid % 3 = 0)").replace("'interaction_3_plus']) AS grp", "'interaction_3_plus', 'even', 'third', 'interaction_0']) AS grp")


@query(f"WITH {GOAL}{_top(200)}{_MEMBERS}")
def overlapping_groups_ndcg(spark, sf_dir):
    """mostpop_ndcg with named groups beside those by activity: users are in up to three of them."""
    y, target = _final(spark, sf_dir)
    everyone = y.select("userid").distinct()
    named = feedback.named_members(everyone, {"even": everyone.where("userid % 2 = 0"), "third": everyone.where("userid % 3 = 0")})
    active = feedback.activity_members(y)
    users, goal = ranking.eligible(y, target, members=active.unionByName(named.join(active.select("userid"), "userid", "left_semi")))
    ids = users.select("userid").distinct()
    top = ranking.top_popular(feedback.popularity(y), ids, feedback.seen(y), 200)
    return ranking.ndcg(top, users, goal, ranking.list_sizes(ids, y, feedback.seen(y)), groups=(*feedback.GROUPS, "even", "third", feedback.ZERO))


@query(f"WITH {RULES} SELECT userid, kind, token FROM tokens")
def rule_tokens(spark, sf_dir):
    return rules.tokens(_final(spark, sf_dir)[0])


@query(f"WITH {RULES} SELECT kind, token, n::BIGINT AS n FROM counts")
def rule_token_counts(spark, sf_dir):
    return rules.token_counts(rules.tokens(_final(spark, sf_dir)[0]))


@query(f"WITH {RULES} SELECT kind, token, itemid, n::BIGINT AS n FROM met")
def rule_pairs(spark, sf_dir):
    return rules.pairs(rules.tokens(_final(spark, sf_dir)[0]))


_METRICS = "kind, token, itemid, n::BIGINT AS n, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 6) AS lift"


def _rounded(found):
    return found.select("kind", "token", "itemid", "n", F.round("support", 9).alias("support"), F.round("confidence", 9).alias("confidence"), F.round("lift", 6).alias("lift"))


@query(f"WITH {RULES} SELECT {_METRICS} FROM found")
def rules_metrics(spark, sf_dir):
    return _rounded(_rules(spark, sf_dir)[2])


@query(f"WITH {RULES} SELECT {_METRICS} FROM found WHERE support >= 0.001::DOUBLE AND confidence >= 0.0015::DOUBLE AND lift >= 1.0::DOUBLE")
def rules_filtered(spark, sf_dir):
    y = _final(spark, sf_dir)[0]
    return _rounded(rules.rules(y, rules.tokens(y), 0.001, 0.0015, 1.0))


def _digest(s):
    return s.digest().select("userid", "n", F.round("total", 6).alias("total"), F.round("top", 6).alias("top"), "last_item")


def _signal_of(y, kinds=rules.KINDS):
    t = written(rules.tokens(y), "tokens")
    return fired.Fired(t, rules.rules(y, t), feedback.seen(y), kinds, item_rules=rules.item_rules(t))


def _signal(spark, sf_dir, kinds=rules.KINDS):
    return _signal_of(_final(spark, sf_dir)[0], kinds)


@query(f"WITH {SIGNAL.replace('KINDS', PERSONAL)} {DIGEST}")
def signal_personalized(spark, sf_dir):
    return _digest(_signal(spark, sf_dir, ("item", "icl")))


@query(f"WITH {SIGNAL.replace('KINDS', GENERIC)} {DIGEST}")
def signal_generic(spark, sf_dir):
    return _digest(_signal(spark, sf_dir, ("ucl",)))


@query(f"WITH {SIGNAL.replace('KINDS', ALL_KINDS)} {DIGEST}")
def signal_masked(spark, sf_dir):
    return _digest(_signal(spark, sf_dir))


@query(f"WITH {NORMAL.replace('VALUE', 's')} {DIGEST}")
def signal_row_max(spark, sf_dir):
    return _digest(_signal(spark, sf_dir).normalised())


@query(f"WITH {NORMAL.replace('VALUE', 'ln(1 + s)')} {DIGEST}")
def signal_log_row_max(spark, sf_dir):
    return _digest(_signal(spark, sf_dir).normalised("log_row_max"))


@query(f"WITH {GOAL}, {SIGNAL.replace('KINDS', PERSONAL).removeprefix(FIT + ', ')}, r AS (SELECT userid, itemid, round(s, 9) AS s FROM signal){_top(200, 'coalesce(r.s, 0)', 'LEFT JOIN r ON r.userid = u.userid AND r.itemid = i.itemid')}{NDCG}")
def rules_only_ndcg(spark, sf_dir):
    y, users, goal = _ranks(spark, sf_dir)
    top = _signal_of(y, ("item", "icl")).top(users.select("userid"), y, 200, goal=goal)
    return ranking.ndcg(top, users, goal, ranking.list_sizes(users.select("userid"), y, feedback.seen(y)))


@query(f"WITH {GOAL}, {SIGNAL.replace('KINDS', ALL_KINDS).removeprefix(FIT + ', ')}, r AS (SELECT userid, itemid, round(s, 9) AS s FROM signal){_top(200, 'coalesce(r.s, 0)', 'LEFT JOIN r ON r.userid = u.userid AND r.itemid = i.itemid')}{NDCG}")
def rules_ndcg(spark, sf_dir):
    """rules_only_ndcg, whose SQL leaves out the clusters of users, with all three families of rules."""
    y, users, goal = _ranks(spark, sf_dir)
    top = _signal_of(y).top(users.select("userid"), y, 200, goal=goal)
    return ranking.ndcg(top, users, goal, ranking.list_sizes(users.select("userid"), y, feedback.seen(y)))


_USERS_BY, _ITEMS_BY = 3, 2


def _cluster_sql(of: str, other: str, k: int, name: str) -> str:
    """Clusters of users or items by the likes of the first so many of them as centres: the nearest, the smaller number of equals."""
    return f"""{name}_first AS (SELECT {of} AS c, row_number() OVER (ORDER BY {of}) - 1 AS k FROM (SELECT DISTINCT {of} FROM likes) ORDER BY {of} LIMIT {k}),
  {name}_n AS (SELECT {of}, count(*) AS n FROM likes GROUP BY {of}),
  {name}_met AS (SELECT a.{of}, f.k, count(*) AS n FROM likes a JOIN likes b ON a.{other} = b.{other} JOIN {name}_first f ON f.c = b.{of} GROUP BY ALL),
  {name}_far AS (SELECT y.{of}, f.k, coalesce(n.n, 0) + c.n - 2 * coalesce(m.n, 0) AS d FROM (SELECT DISTINCT {of} FROM y) y CROSS JOIN {name}_first f JOIN {name}_n c ON c.{of} = f.c
    LEFT JOIN {name}_n n ON n.{of} = y.{of} LEFT JOIN {name}_met m ON m.{of} = y.{of} AND m.k = f.k),
  {name} AS (SELECT {of}, dense_rank() OVER (ORDER BY k) - 1 AS cluster FROM (SELECT {of}, arg_min(k, d * {k} + k) AS k FROM {name}_far GROUP BY {of}))"""


_CLUSTERED = RULES.replace("tokens AS (", f"{_cluster_sql('userid', 'itemid', _USERS_BY, 'by_user')}, {_cluster_sql('itemid', 'userid', _ITEMS_BY, 'by_item')}, tokens AS (", 1).replace("SELECT DISTINCT userid, 'ucl', 0 FROM y", "SELECT userid, 'ucl', cluster FROM by_user").replace("SELECT DISTINCT userid, 'icl', 0 FROM likes", "SELECT DISTINCT userid, 'icl', cluster FROM likes JOIN by_item USING (itemid)")


def _first_rows(y, of, k):
    """The clusters of _cluster_sql()."""
    rows, width = rules.one_rows(y, of)
    first = [r.ones for r in rows.where(F.size("ones") > 0).orderBy(of).limit(k).collect()]
    return rules.compacted(kmeans.nearest(rows, width, first))


@query(f"WITH {GOAL}, {SIGNAL.replace(RULES, _CLUSTERED).replace('KINDS', ALL_KINDS).removeprefix(FIT + ', ')}, r AS (SELECT userid, itemid, round(s, 9) AS s FROM signal){_top(200, 'coalesce(r.s, 0)', 'LEFT JOIN r ON r.userid = u.userid AND r.itemid = i.itemid')}{NDCG}")
def clustered_rules_ndcg(spark, sf_dir):
    """rules_ndcg with several clusters of users and of items, around fixed centres."""
    y, users, goal = _ranks(spark, sf_dir)
    t = written(rules.tokens(y, _first_rows(y, "userid", _USERS_BY), _first_rows(y, "itemid", _ITEMS_BY)), "tokens")
    top = fired.Fired(t, rules.rules(y, t), feedback.seen(y), item_rules=rules.item_rules(t)).top(users.select("userid"), y, 200, goal=goal)
    return ranking.ndcg(top, users, goal, ranking.list_sizes(users.select("userid"), y, feedback.seen(y)))


@query()
def like_clusters(spark, sf_dir):
    """Clusters of users by what they like, the best of ten starts."""
    y = _final(spark, sf_dir)[0]
    return rules.clusters(y, "userid", 5)


# ---- co-occurrence
def _likes(spark, sf_dir):
    return feedback.liked(_final(spark, sf_dir)[0])


@query(f"WITH {COUNTS} SELECT i, j, n::BIGINT AS n FROM c")
def item_cooccurrence(spark, sf_dir):
    return cooccurrence.counts(_likes(spark, sf_dir))


def _pmi(k):
    return f"WITH {PMI.replace('NEG', k)} SELECT i, j, round(value, 8) AS value FROM m WHERE value > 0"


@query(_pmi("1"))
def sppmi_k1(spark, sf_dir):
    return cooccurrence.sppmi_of(_likes(spark, sf_dir)).select("i", "j", F.round("value", 8).alias("value"))


@query(_pmi("5"))
def sppmi_k5(spark, sf_dir):
    return cooccurrence.sppmi_of(_likes(spark, sf_dir), 5).select("i", "j", F.round("value", 8).alias("value"))


# ---- graph
def _edges(spark, sf_dir):
    return graph.edges(feedback.liked(_final(spark, sf_dir)[0]))


@query(f"WITH {GRAPH} SELECT * FROM e")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {GRAPH} SELECT src, degree::BIGINT AS degree FROM d")
def graph_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT src, dst, round(w, 9) AS w FROM a")
def graph_adjacency(spark, sf_dir):
    return graph.adjacency(_edges(spark, sf_dir)).select("src", "dst", F.round("w", 9).alias("w"))


@query(f"WITH {GRAPH} SELECT a.src AS node, round(sum(a.w * d.degree), 7) AS value FROM a JOIN d ON d.src = a.dst GROUP BY a.src")
def graph_propagate_1hop(spark, sf_dir):
    e = _edges(spark, sf_dir)
    values = graph.degrees(e).select(F.col("src").alias("node"), F.col("degree").cast("double").alias("value"))
    return graph.propagate(graph.adjacency(e), values).select("node", F.round("value", 7).alias("value"))


@query(f"WITH {GRAPH}, v0 AS (SELECT src AS node, degree::DOUBLE AS value FROM d), v1 AS (SELECT a.src AS node, sum(a.w * value) AS value FROM a JOIN v0 ON v0.node = a.dst GROUP BY a.src), v2 AS (SELECT a.src AS node, sum(a.w * value) AS value FROM a JOIN v1 ON v1.node = a.dst GROUP BY a.src), every AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2) SELECT node, round(sum(value) / 3, 7) AS value FROM every GROUP BY node")
def graph_layer_mean(spark, sf_dir):
    e = _edges(spark, sf_dir)
    values = graph.degrees(e).select(F.col("src").alias("node"), F.col("degree").cast("double").alias("value"))
    return graph.layer_mean(graph.adjacency(e), values, 2).select("node", F.round("value", 7).alias("value"))


# ---- factors
_SIZE, _ALPHA = 4, 10.0


def _fixed(keys, key, mul, mod):
    """Factors that both engines can compute: ((key * (k + 1)) % mod) / 10."""
    vec = F.array(*((((F.col(key) * mul * (k + 1)) % mod) / F.lit(10.0)).alias(str(k)) for k in range(_SIZE)))
    return keys.select(F.col(key).cast("long").alias(key)).distinct().select(key, vec.alias("vec"))


_FACTORS = f"{FIT}, p AS (SELECT DISTINCT userid, k, ((userid * 3 * (k + 1)) % 7) / 10.0::DOUBLE AS v FROM y, range({_SIZE}) t(k)), q AS (SELECT DISTINCT itemid, k, ((itemid * 5 * (k + 1)) % 11) / 10.0::DOUBLE AS v FROM y, range({_SIZE}) t(k))"


def _pq(y):
    return _fixed(y, "userid", 3, 7), _fixed(y, "itemid", 5, 11)


@query("WITH v AS (SELECT vec_id, (k - 1)::INT AS k, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) t(k)) SELECT a.k AS row, b.k AS col, round(sum(a.x * b.x), 6) AS value FROM v a JOIN v b USING (vec_id) GROUP BY a.k, b.k")
def gram_matrix(spark, sf_dir):
    g = factors.gram(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    cells = [(i, j, float(g[i, j])) for i in range(len(g)) for j in range(len(g))]
    return spark.createDataFrame(cells, "row int, col int, value double").withColumn("value", F.round("value", 6))


@query(f"WITH {_FACTORS} SELECT l.userid, q.k::INT AS k, round((1 + {_ALPHA}::DOUBLE) * sum(q.v), 8) AS value FROM likes l JOIN q ON q.itemid = l.itemid GROUP BY l.userid, q.k")
def als_rhs(spark, sf_dir):
    y = _final(spark, sf_dir)[0]
    parts = feedback.liked(y).join(_pq(y)[1], "itemid").select("userid", F.posexplode("vec").alias("k", "v"))
    return parts.groupBy("userid", "k").agg(F.round((1 + _ALPHA) * F.sum("v"), 8).alias("value"))


def _half_step_sql() -> str:
    """The normal equations of each user, (Q'Q + 0.5 I + alpha sum v v') x = (1 + alpha) sum v, solved by Cholesky's factors."""
    n = range(_SIZE)
    lower = [(i, j) for i in n for j in range(i + 1)]
    cells = ", ".join(f"max(CASE WHEN k = {i} AND j = {j} THEN s + g END) AS a{i}{j}" for i, j in lower)
    right = ", ".join(f"max(CASE WHEN k = {i} THEN s END) AS b{i}" for i in n)
    less = lambda terms: "".join(f" - {t}" for t in terms)
    steps = [f"sqrt(a{i}{i}{less(f'l{i}{h} * l{i}{h}' for h in range(i))}) AS l{i}{i}" if i == j else f"(a{i}{j}{less(f'l{i}{h} * l{j}{h}' for h in range(j))}) / l{j}{j} AS l{i}{j}" for i, j in lower]
    steps += [f"(b{i}{less(f'l{i}{h} * z{h}' for h in range(i))}) / l{i}{i} AS z{i}" for i in n]
    steps += [f"(z{i}{less(f'l{h}{i} * x{h}' for h in range(i + 1, _SIZE))}) / l{i}{i} AS x{i}" for i in reversed(n)]
    return f"""WITH {_FACTORS}, gq AS (SELECT a.k, b.k AS j, sum(a.v * b.v) + CASE WHEN a.k = b.k THEN 0.5 ELSE 0 END AS g FROM q a JOIN q b USING (itemid) GROUP BY a.k, b.k),
  w AS (SELECT l.userid, a.k, b.k AS j, {_ALPHA}::DOUBLE * sum(a.v * b.v) AS s FROM likes l JOIN q a ON a.itemid = l.itemid JOIN q b ON b.itemid = l.itemid WHERE a.k >= b.k GROUP BY l.userid, a.k, b.k),
  r AS (SELECT l.userid, q.k, (1 + {_ALPHA}::DOUBLE) * sum(q.v) AS s FROM likes l JOIN q ON q.itemid = l.itemid GROUP BY l.userid, q.k),
  m AS (SELECT userid, {cells} FROM w JOIN gq USING (k, j) GROUP BY userid), b AS (SELECT userid, {right} FROM r GROUP BY userid),
  x AS (SELECT userid, {", ".join(steps)} FROM m JOIN b USING (userid))
  {" UNION ALL ".join(f"SELECT userid, {i}::INT AS k, round(x{i}, 8) AS value FROM x" for i in n)}"""


@query(_half_step_sql())
def als_user_half_step(spark, sf_dir):
    y = _final(spark, sf_dir)[0]
    found = factors.fold_in(feedback.liked(y), _pq(y)[1], _SIZE, 0.5, _ALPHA)
    return found.select("userid", F.posexplode("vec").alias("k", "value")).withColumn("value", F.round("value", 8))


@query(f"""WITH {_FACTORS}, gp AS (SELECT a.k, b.k AS j, sum(a.v * b.v) AS g FROM p a JOIN p b USING (userid) GROUP BY ALL), gq AS (SELECT a.k, b.k AS j, sum(a.v * b.v) AS g FROM q a JOIN q b USING (itemid) GROUP BY ALL),
  s AS (SELECT l.userid, l.itemid, sum(p.v * q.v) AS s FROM likes l JOIN p ON p.userid = l.userid JOIN q ON q.itemid = l.itemid AND q.k = p.k GROUP BY ALL)
  SELECT round((SELECT sum(gp.g * gq.g) FROM gp JOIN gq USING (k, j)) + (SELECT sum((1 + {_ALPHA}::DOUBLE) * (1 - s) * (1 - s) - s * s) FROM s), 3) AS loss""")
def wmf_loss(spark, sf_dir):
    y = _final(spark, sf_dir)[0]
    loss = factors.wmf_loss(feedback.liked(y), *_pq(y), _ALPHA)
    return spark.createDataFrame([(loss,)], "loss double").select(F.round("loss", 3).alias("loss"))


_BIAS = f"{_FACTORS.replace(FIT, PMI.replace('NEG', '1'))}, cell AS (SELECT m.i, m.j, m.value, sum(a.v * b.v) AS score FROM m JOIN q a ON a.itemid = m.i JOIN q b ON b.itemid = m.j AND b.k = a.k WHERE m.value > 0 GROUP BY ALL), bi AS (SELECT i, avg(value - score - 0.1::DOUBLE) AS bias FROM cell GROUP BY i), bj AS (SELECT j, avg(value - score - coalesce(bias, 0) - 0.1::DOUBLE) AS bias FROM cell LEFT JOIN bi USING (i) GROUP BY j)"


def _biases(spark, sf_dir, contexts=True):
    y = _final(spark, sf_dir)[0]
    q = _pq(y)[1]
    return factors.biases(feedback.liked(y), q, q, 0.1, contexts=contexts)


@query(f"WITH {_BIAS} SELECT i, round(bias, 7) + 0.0::DOUBLE AS bias FROM bi")
def cofactor_item_bias(spark, sf_dir):
    return _biases(spark, sf_dir, contexts=False)[0].select("i", (F.round("bias", 7) + 0.0).alias("bias"))


@query(f"WITH {_BIAS} SELECT j, round(bias, 7) + 0.0::DOUBLE AS bias FROM bj")
def cofactor_context_bias(spark, sf_dir):
    return _biases(spark, sf_dir)[1].select("j", (F.round("bias", 7) + 0.0).alias("bias"))


@query(f"WITH {_BIAS} SELECT round(avg(value - score - coalesce(bi.bias, 0) - coalesce(bj.bias, 0)), 6) AS bias FROM cell LEFT JOIN bi USING (i) LEFT JOIN bj USING (j)")
def cofactor_global_bias(spark, sf_dir):
    return spark.createDataFrame([(_biases(spark, sf_dir)[2],)], "bias double").select(F.round("bias", 6).alias("bias"))


def _fitted(spark, sf_dir, fit):
    y, users, goal = _ranks(spark, sf_dir)
    p, q = fit(y)
    return factors.top_factors(p.join(users.select("userid"), "userid", "left_semi"), q, feedback.seen(y), 10).select("userid", "itemid", F.round("score", 6).alias("score"), "rank")


@query()
def wmf_fit_scores(spark, sf_dir):
    return _fitted(spark, sf_dir, lambda y: factors.fit_wmf(y, sweeps=10, in_tasks=True))


@query()
def signal_wmf_fit_scores(spark, sf_dir):
    return _fitted(spark, sf_dir, lambda y: factors.fit_wmf(y, sweeps=10, signal=rules.full_signal(y), gamma=0.5, in_tasks=True))


@query()
def cofactor_fit_scores(spark, sf_dir):
    return _fitted(spark, sf_dir, lambda y: factors.fit_cofactor(y, sweeps=10, in_tasks=True))


@query()
def lightgcn_scores(spark, sf_dir):
    """One Adam step for every 2,048 triples. Scores are sigmoids in single precision, whose ties fall back to the item's order."""
    y, users, goal = _ranks(spark, sf_dir)
    p, q = lightgcn.factors_of(lightgcn.fit(y, size=32, layers=2, epochs=30, in_tasks=True))
    top = factors.top_scored(p.join(users.select("userid"), "userid", "left_semi"), q, feedback.seen(y), 10, factors.sigmoids, factors.sigmoid)
    return top.select("userid", "itemid", F.round(F.col("score").cast("float"), 6).alias("score"), "rank")


@query()
def neumf_scores(spark, sf_dir):
    """One Adam step for every 256 samples of each of ten epochs; sigmoids in single precision, as above."""
    y, users, goal = _ranks(spark, sf_dir)
    top = neumf.fit(y, epochs=10).top(users, feedback.seen(y), 10)
    return top.select("userid", "itemid", F.round(F.col("score").cast("float"), 6).alias("score"), "rank")


@query()
def negative_samples(spark, sf_dir):
    y = _final(spark, sf_dir)[0]
    return sampling.negatives(feedback.liked(y), y.select("itemid"))


@query()
def bpr_triples(spark, sf_dir):
    y = _final(spark, sf_dir)[0]
    return sampling.triples(feedback.liked(y), y.select("itemid"))


@query()
def kmeans_vectors(spark, sf_dir):
    """Clusters of the embeddings, the best of several seeds by training cost."""
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    best = min((KMeans(k=5, seed=s, maxIter=10).fit(data) for s in range(3)), key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("vec_id", F.col("prediction").cast("long").alias("cluster"))


# ---- search
@query(fixture=True)
def hyperparam_samples(spark, sf_dir):
    return sample_table(spark, 20)


def _search(spark, sf_dir, models):
    with passing(spark):
        return random_search(spark, "whole", SearchScores(Windows.of(_split(spark, sf_dir), final=False)), models, rounds=10)


@query()
def wmf_rounds(spark, sf_dir):
    """Ten rounds of plain WMF, each at all its drawn settings, on the validation window: one job fits and ranks them all."""
    return _search(spark, sf_dir, ("wmf",))


@query()
def wmf_search(spark, sf_dir):
    """The same for all models that are fitted: forty fits, too long for a driver that runs every query (SLOW)."""
    return _search(spark, sf_dir, ("wmf", "signal_wmf", "cofactor", "lightgcn"))


#: Queries that take an hour or more at any size: callers ask for them by name, the driver's list leaves them out.
SLOW = ("wmf_search",)


#: What search_scores takes: rounds and seeds.
_ROUNDS, _SEEDS = 1, (42, 43)
SCORES = "dataset string, model string, seed int, round int, settings string, score double"


def _logs(spark, sf_dir) -> Stages:
    """The two logs of the driver's tables."""
    return Stages({"order-lines": log.earliest(log.dense(spark, sf_dir)), "events": log.earliest(log.events(spark, sf_dir).na.drop())})


def _search_folder(spark, sf_dir, name) -> str:
    return f"{shared_dir(spark)}/search/{quote(sf_dir, safe='')}/{name}"


def searched(spark, stages: Stages, folder: str, rounds: int = _ROUNDS, seeds: tuple[int, ...] = _SEEDS, models: tuple[str, ...] = MODELS, together: int = 8) -> DataFrame:
    """(dataset, model, seed, round, settings, score): NDCG at 10 of the validation window for every fit of a search."""
    stages.ready(final=False)

    def score(fit):
        x = stages.windows(fit.dataset, False)
        with passing(spark):
            found = float(x.score(fit_model(x.y, fit.model, json.loads(fit.settings))))
        return spark.createDataFrame([(fit.dataset, fit.model, fit.seed, fit.round, fit.settings, found)], SCORES)

    return resumed(spark, folder, planned(stages.logs, models, rounds, seeds), score, SCORES, together)


def tested(spark, stages: Stages, best: DataFrame, folder: str, cutoffs: tuple[int, ...] = ranking.CUTOFFS, together: int = 8) -> DataFrame:
    """Rows of the test window for the best settings (dataset, model, seed, round, score, settings), refitted on train and validation."""
    stages.ready(final=True)
    fits = [Fit(r.dataset, r.model, r.seed, r.round, r.settings) for r in best.collect()]  # one for each dataset, model and seed
    schema = "dataset string, round int, settings string, " + reports.test_schema(cutoffs)

    def row(fit):
        x, settings = stages.windows(fit.dataset, True), json.loads(fit.settings)

        def refit(y, phases):
            if fit.model != "signal_wmf":
                return fit_model(y, fit.model, settings)
            with phases.phase("signal"):
                signal = fit_signal(y, settings)
            return fit_model(y, fit.model, settings, signal)

        got = reports.test_row(x, fit.dataset, fit.model, fit.seed, refit, cutoffs)
        return got.select(F.lit(fit.dataset).alias("dataset"), F.lit(fit.round).alias("round"), F.lit(fit.settings).alias("settings"), *(F.col(f"`{c}`") for c in got.columns))

    return reports.ordered(resumed(spark, folder, fits, row, schema, together).drop("dataset"), cutoffs)


def _scores(spark, sf_dir, stages):
    return searched(spark, stages, _search_folder(spark, sf_dir, "scores"))


@query()
def search_scores(spark, sf_dir):
    """A round of each of six models on both logs for two seeds, each at all its drawn settings."""
    return _scores(spark, sf_dir, _logs(spark, sf_dir))


@query()
def search_best(spark, sf_dir):
    """The best settings of each log, model and seed, from the rows of search_scores, which are kept."""
    return best_of(search_scores(spark, sf_dir))


@query()
def search_mean_sd(spark, sf_dir):
    return mean_sd(best_of(search_scores(spark, sf_dir)))


@query()
def search_tested(spark, sf_dir):
    """The test window's row for each of these best settings."""
    stages = _logs(spark, sf_dir)
    best = best_of(_scores(spark, sf_dir, stages))
    return tested(spark, stages, best, _search_folder(spark, sf_dir, "tested"))


# ---- reports, on literal results
_RESULTS = [("d1", "a", 42, 1, 0.2), ("d1", "a", 42, 2, 0.2), ("d1", "a", 43, 1, 0.25), ("d1", "b", 42, 1, 0.1), ("d1", "b", 43, 1, float("nan")), ("d1", "b", 43, 2, 0.4), ("d2", "a", 42, 1, 0.7)]
_VALUES = ", ".join(f"('{d}', '{m}', {s}, {r}, {'NULL' if v != v else v}::DOUBLE)" for d, m, s, r, v in _RESULTS)
_BEST = f"r AS (SELECT * FROM (VALUES {_VALUES}) t(dataset, model, seed, round, score)), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, seed ORDER BY score DESC, round) AS k FROM r WHERE score IS NOT NULL) WHERE k = 1)"


def _results(spark):
    return spark.createDataFrame(_RESULTS, "dataset string, model string, seed int, round int, score double")


@query(fixture=True, sql=f"WITH {_BEST} SELECT dataset, model, seed::INT AS seed, round::INT AS round, score FROM best")
def best_config(spark, sf_dir):
    return best_of(_results(spark))


@query(fixture=True, sql=f"WITH {_BEST} SELECT dataset, model, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS sd, count(DISTINCT seed)::BIGINT AS n_seeds FROM best GROUP BY dataset, model")
def results_mean_sd(spark, sf_dir):
    return mean_sd(best_of(_results(spark)))
