"""URL filters: smoothed variable-order Markov models of accepted and rejected URLs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop, unused, written

# The rules, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The longest context, the weight of the next shorter one, and a floor that stands for unseen characters.
ORDER, BACKOFF, FLOOR = 3, 4.0, 1.0 / 1024
#: The share of accepted training URLs that the calibrated threshold may block.
LOSS = 0.05
#: One accepted URL in so many calibrates instead of teaching.
CALIBRATION = 5
#: A model of so many rows at most (about 100 bytes each, 100 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Digits of a score that count: the order in which doubles are added does not reach them.
DIGITS = 9
_BEGIN, _END = "\u0002", "\u0003"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES, host: str = "host", path: str = "path") -> DataFrame:
    """pages with rule and rule_verdict: those of the longest rule that fits the host or a domain over it, and the path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == domain) | F.col(host).endswith("." + domain)) & F.col(path).startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return pages.withColumn("_rule", out).withColumns({"rule": F.col("_rule.rule"), "rule_verdict": F.col("_rule.verdict")}).drop("_rule")


def model_text(url: Column) -> Column:
    """What the models read: the url without its scheme, A-Z in lower case; null as empty."""
    return F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), UPPER, LOWER)


def grams(text: Column) -> Column:
    """An array with, for each character of the text and for its end, that character after the ORDER characters before it.

    The text is cut into its characters once, so the work is in proportion to its length.
    """
    chars = F.split(F.concat(F.lit(_BEGIN * ORDER), text, F.lit(_END)), "")
    gram = lambda c: lambda i: F.concat(*(F.get(c, i + k) for k in range(ORDER + 1)))
    # the outer transform names the characters, so that they are cut out once
    return F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - (ORDER + 1)), gram(c)))[0]


def fit(rows: DataFrame, text: str = "text", accepted: str = "accepted") -> DataFrame:
    """(gram, ratio) for every gram of the rows: log p(character | context) in the accepted minus that in the rejected model.

    accepted is true, false, or null for rows that teach nothing and are only to be scored. Both models are interpolated
    from the longest context down to a uniform floor:
    p_k(c | ctx) = (n(ctx c) + BACKOFF * p_{k-1}(c | shorter ctx)) / (n(ctx) + BACKOFF).
    Counts cover all rows. Distinct grams are counted before anything is joined, so a frequent gram is one row.
    """
    count = lambda flag: F.sum(F.when(F.col(accepted) == flag, 1).otherwise(0))
    seen, path = written(rows.select(F.explode(grams(F.col(text))).alias("gram"), accepted).groupBy("gram").agg(count(True).alias("a"), count(False).alias("r")), "grams")
    totals = seen.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "ar")).first()
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(whole).alias("whole"), F.col("gram").substr(F.lit(ORDER + 1 - k), F.lit(k + whole)).alias("part")) for k in range(ORDER + 1) for whole in (0, 1) if k + whole)))
    flat = seen.withColumn("_p", parts).select("gram", "a", "r", "_p.*")
    sums = flat.groupBy("k", "whole", "part").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    back = flat.drop("a", "r").join(sums, ["k", "whole", "part"])
    wide = back.groupBy("gram").agg(*(F.max(F.when((F.col("k") == k) & (F.col("whole") == whole), F.col(x))).alias(f"{x}{k}{whole}") for x in "ar" for k in range(ORDER + 1) for whole in (0, 1) if k + whole))
    p = {}
    for x in "ar":
        p[x] = F.lit(FLOOR)
        for k in range(ORDER + 1):
            context = F.col(f"{x}{k}0") if k else F.lit(totals[x])
            p[x] = (F.col(f"{x}{k}1") + BACKOFF * p[x]) / (context + BACKOFF)
    model, at = written(wide.select("gram", (F.log(p["a"]) - F.log(p["r"])).alias("ratio")), "markov")
    drop(rows.sparkSession, path)
    return model


def score(rows: DataFrame, model: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
    """rows with the mean log ratio of the characters of each text, to DIGITS digits: equal texts have equal scores.

    Rows are numbered and written; their characters carry the number alone, meet again under it, summed first in their task,
    and join the rest of the row. The model is broadcast behind a count of its rows; a larger one is joined by shuffle, where
    adaptive execution splits frequent grams.
    """
    number = unused(rows, "row")
    numbered, _ = written(rows.withColumn(number, F.monotonically_increasing_id()), "url-rows")
    small = model.count() <= BROADCAST_ROWS
    each = numbered.select(number, F.explode(grams(F.col(text))).alias("gram"))
    means = each.join(F.broadcast(model) if small else model, "gram").groupBy(number).agg(F.round(F.avg("ratio"), DIGITS).alias(into))
    return numbered.drop(into).join(means, number, "left").drop(number)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page.

    A fitting rule decides. Other urls are blocked if their score is under the threshold. That is calibrated on one in
    CALIBRATION (by hash of the url) of those that rules accept, which the models do not learn: a share of LOSS of these lies
    under it (of all accepted ones, if none of them is set aside; 0 if no rule accepts any). Null urls and urls without ://
    have an empty host and path and are judged by the models as any other; repeated rows and null ids stay, each judged by
    its own url; other columns are not read.
    """
    url = F.col("url")
    rows = with_rule(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), model_text(url).alias("text")), rules)
    fits = F.col("rule_verdict") == "allow"
    aside = fits & (F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0)
    rows = rows.withColumn("aside", aside).withColumn("accepted", F.when(~F.coalesce("aside", F.lit(False)), fits))
    model = fit(rows)
    scored, _ = written(score(rows, model), "url-scores")
    quantile = lambda some: F.percentile_approx(F.when(some, F.col("score")), LOSS, 10_000)
    threshold = scored.agg(F.coalesce(quantile(F.col("aside")), quantile(F.col("accepted")), F.lit(0.0))).first()[0]
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
