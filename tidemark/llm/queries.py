"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import audit_report
from .bitpack import token_files
from .clusters import cluster_report
from .common import table
from .decontaminate import leak_report
from .langid import language_report
from .licenses import license_report
from .lines import line_report
from .mtree import search_report
from .packing import packing_report
from .repeats import repeat_report
from .secrets import secret_report
from .similarity import similar_groups
from .urls import judge


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_report(table(spark, sf_dir, "embeddings"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def vocabulary(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op11_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_mtree": op2_mtree,
    "op3_langid": op3_langid,
    "op4_urls": op4_urls,
    "op5_packing": op5_packing,
    "op9_bitpack": op9_bitpack,
    "op7_decontaminate": op7_decontaminate,
    "op10_repeats": op10_repeats,
    "op8_jaccard": op8_jaccard,
    "op6_licenses": op6_licenses,
    "op11_kdtree": op11_kdtree,
    "op12_filter_audit": op12_filter_audit,
    "op13_lines": op13_lines,
}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lloyd(k: int = 40, rounds: int = 5) -> str:
    """The rounds of op11 as common tables c0, c1, ... of centroids and a0, a1, ... of assignments."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding]::DOUBLE[] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x) OR abs(x::DOUBLE) >= 262144]) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v)::INT - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""d{n} AS (SELECT r, c, (list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, o.v) + list_inner_product(o.v, o.v))::BIGINT AS d FROM kept k CROSS JOIN c{n} o),
        a{n} AS MATERIALIZED (SELECT r, min(d) AS distance, arg_min(c, d * {k} + c) AS cluster FROM d{n} GROUP BY r)""")
        if n < rounds:
            parts.append(f"""m{n} AS (SELECT cluster, list(f ORDER BY p) AS v FROM (SELECT cluster, p, floor(sum(x) / count(*)) AS f FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS p FROM a{n} JOIN kept USING (r)) GROUP BY cluster, p) GROUP BY cluster),
        c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} ON cluster = c)""")
    return ", ".join(parts)


ORACLE: dict[str, str] = {
    "op11_kdtree": f"""
        WITH {_lloyd()}, totals AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a5 GROUP BY cluster)
        SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a5) AS inertia,
               sha256(array_to_string([x::BIGINT FOR x IN c5.v], ',')) AS centroid_sha256
        FROM a5 JOIN kept USING (r) JOIN totals USING (cluster) JOIN c5 ON c = cluster""",
    "op12_filter_audit": rf"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
        ), words AS (
            SELECT doc_id, part, t, regexp_extract_all(t, '[^ 	-
]+') AS w FROM texts
        ), failed AS (
            SELECT part, w.doc_id, [x[1] FOR x IN [['A', (len(w) < 200)::VARCHAR], ['B', (100 * len(list_distinct(w)) < 50 * len(w))::VARCHAR],
                   ['C', (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::VARCHAR],
                   ['D', regexp_matches(t, '[#$%&*|]')::VARCHAR], ['E', coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::VARCHAR]] IF x[2] = 'true'] AS fails FROM words w
        ), marks AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), counters AS MATERIALIZED (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM failed LEFT JOIN marks USING (doc_id) GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
            SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS x, string_split(left(filter_order, step::INT - 1), '') AS earlier FROM orders CROSS JOIN range(1, 6) t(step)
        ), judged AS (
            SELECT part, filter_order, step, x, n, good, toxic, fails, list_contains(fails, x) AS now, list_has_any(fails, earlier) AS gone FROM counters CROSS JOIN steps
        ), sums AS (
            SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT now AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT gone), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (now AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = [x]), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (now AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (now AND NOT gone), 0)::BIGINT AS toxic_lost FROM judged GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM sums""",
    "op13_lines": f"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), lines AS MATERIALIZED (
            SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM docs)
        ), frequent AS (
            SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 10
        ), marked AS (
            SELECT r, i, line, frequent.k IS NOT NULL AS gone FROM lines LEFT JOIN frequent USING (k)
        )
        SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked JOIN docs USING (r) GROUP BY r""",
    "op2_mtree": """
        WITH usable AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op7_decontaminate": rf"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
        ), items AS (
            SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
        ), starts AS (
            SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0
        ), windows AS MATERIALIZED (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM starts
        ), places AS (
            SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n
        ), hits AS MATERIALIZED (
            SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM places) JOIN windows USING (n, k)
        ), covered AS (
            SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r
        ), found AS (
            SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)""",
    "op8_jaccard": rf"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id,
                   coalesce(regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), shingles AS MATERIALIZED (
            SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
        ), sized AS MATERIALIZED (
            SELECT r, count(*) AS n, sha256(string_agg(s, '  ' ORDER BY s)) AS same FROM shingles GROUP BY r
        ), classes AS MATERIALIZED (
            SELECT same, any_value(n) AS n, min(r) AS c, min(doc_id) AS least FROM sized JOIN words USING (r) GROUP BY same
        ), members AS MATERIALIZED (
            SELECT r AS c, s FROM shingles WHERE r IN (SELECT c FROM classes)
        ), shared AS (
            SELECT a.c AS x, b.c AS y, count(*) AS k FROM members a JOIN members b ON a.s = b.s AND a.c <> b.c GROUP BY a.c, b.c
        ), links AS MATERIALIZED (
            SELECT x, y FROM shared JOIN classes a ON a.c = x JOIN classes b ON b.c = y WHERE 100 * k >= 75 * (a.n + b.n - k)
        ), reach AS (
            SELECT c, c AS other FROM classes UNION SELECT reach.c, y FROM reach JOIN links ON x = reach.other
        ), groups AS (
            SELECT reach.c, min(least) AS component_id FROM reach JOIN classes ON classes.c = reach.other GROUP BY reach.c
        )
        SELECT doc_id, coalesce(sized.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id)::BIGINT AS component_id
        FROM words LEFT JOIN sized USING (r) LEFT JOIN classes USING (same) LEFT JOIN groups USING (c)""",
    "op10_repeats": """
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), strings AS (
            SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM docs)
        ), hashed AS MATERIALIZED (
            SELECT r, doc_id, p, unhex(s) AS s FROM strings
        ), firsts AS (
            SELECT s, min(doc_id) AS least FROM hashed GROUP BY s HAVING count(*) > 1
        ), later AS (
            SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM hashed JOIN firsts USING (s) WHERE least < doc_id
        ), numbered AS (
            SELECT r, p, sum(CASE WHEN before IS NULL OR p - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run FROM later
        ), runs AS (
            SELECT r, min(p) AS start, max(p) + 50 AS stop FROM numbered GROUP BY r, run
        ), totals AS (
            SELECT r, sum(stop - start) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
        ), edges AS (
            SELECT r, start, stop FROM runs UNION ALL SELECT r, len(h) // 2, len(h) // 2 FROM docs
        ), gaps AS (
            SELECT r, start, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start, stop), 0) AS since FROM edges
        ), kept AS (
            SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (start - since)), '' ORDER BY start, since) AS k FROM gaps JOIN docs USING (r) GROUP BY r
        )
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM docs JOIN kept USING (r) LEFT JOIN totals USING (r)""",
}
