"""Queries of the normalisation operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import text as T
from contentgauge.operators import normalize as N
from contentgauge.sources import stage
from contentgauge.sources.tables import CONTENT_SQL, contents

KEYWORDS = ["theating", "wh", "éau"]


def _any(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(p)})" for p in parts) + ")"


def _count(text: str, parts: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_q(p)}) AS INT)" for p in parts) + ")"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_sql(column: str) -> str:
    out = f"trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g'))"
    for a, b in T.ENTITIES:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    out = f"regexp_replace({out}, 'https?://[!$-_a-z]+', '', 'g')"
    for mark, least, to in (("!", 2, "!"), ("?", 2, "?"), (".", 3, "...")):
        out = f"regexp_replace({out}, '[{mark}]{{{least},}}', '{to}', 'g')"
    return f"trim({out})"


CLEAN_SQL = f"WITH {CONTENT_SQL},\ncleaned AS (SELECT * FROM (SELECT * REPLACE ({_clean_sql('title')} AS title, {_clean_sql('body')} AS body) FROM content) WHERE title <> '' OR body <> '')"
_WORDS = "list_filter(regexp_split_to_array(lower(title || ' ' || body), '\\s+'), lambda w: w <> '')"
DEDUP_SQL = f"""{CLEAN_SQL},
fp AS (SELECT *, md5(array_to_string(list_transform({_WORDS}[1:50], lambda w: md5(w)), '')) AS fingerprint FROM cleaned),
kept AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY rating * 10 + upvotes + helpful_count * 2 DESC, seq) = 1)"""
_TITLE, _BODY = "lower(trim(title))", "lower(body)"
_ISIN = lambda x, vals: f"{x} IN ({', '.join(map(_q, vals))})"
SKIP_SQL = f"""CASE WHEN {_ISIN(_TITLE, T.ERROR_TITLES)} OR {_any(_TITLE, T.ERROR_TITLE_PARTS)} OR {_any(f'substr({_BODY}, 1, 500)', T.ERROR_BODY_PARTS)} THEN 'error_page'
 WHEN {_ISIN(_TITLE, T.LOGIN_TITLES)} OR {_any(_TITLE, T.LOGIN_TITLE_PARTS)} OR {_any(f'substr({_BODY}, 1, 1000)', T.LOGIN_BODY_PARTS)} THEN 'login_wall'
 WHEN length(body) < 100 THEN 'insufficient_content' END"""
LANGUAGE_SQL = f"""CASE WHEN length(trim({_BODY})) < 10 THEN 'unknown'
 WHEN {_count(_BODY, T.FRENCH)} > 3 AND {_count(_BODY, T.FRENCH)} > {_count(_BODY, T.ENGLISH)} THEN 'fr'
 WHEN {_count(_BODY, T.SPANISH)} > 3 AND {_count(_BODY, T.SPANISH)} > {_count(_BODY, T.ENGLISH)} THEN 'es' ELSE 'en' END"""
_WC = "len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> ''))"


def d1_clean_content(spark, sf_dir):
    return N.clean_content(contents(spark, sf_dir)).select("content_id", "title", "body")


def d3_dedup_content(spark, sf_dir):
    return N.dedup_content(N.clean_content(contents(spark, sf_dir))).select("content_id", "fingerprint")


def d13_summaries(spark, sf_dir):
    """Two sentences of every document; some have a description. Its test holds it against brute force."""
    described = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("  A description of document "), F.col("seq"), F.lit(", ends."))).when(F.col("seq") % 5 == 1, F.lit("short"))
    return N.summarize(contents(spark, sf_dir).withColumn("description", described)).select("content_id", "summary")


def d4_validate_length(spark, sf_dir):
    return N.validate_length(contents(spark, sf_dir)).select("content_id", "src")


def d5_normalization_stats(spark, sf_dir):
    """Texts are cleaned once, into a written table of their fingerprints and lengths, and are not shuffled."""
    raw = contents(spark, sf_dir)
    narrow = stage.written(N.with_length(N.with_fingerprint(N.clean_content(raw))).select("seq", "src", "rating", "upvotes", "helpful_count", "fingerprint", "n_text"))
    return N.normalization_stats(raw, N.validate_length(N.dedup_content(narrow)), ["src"])


def d6_skip_reason(spark, sf_dir):
    return N.with_skip_reason(contents(spark, sf_dir)).select("content_id", "skip_reason")


def d7_language(spark, sf_dir):
    return N.with_language(contents(spark, sf_dir)).select("content_id", "language", (~F.col("language").isin("en", "unknown")).alias("non_english"))


def d8_triage(spark, sf_dir):
    return N.with_triage(contents(spark, sf_dir)).select("content_id", "to_score", "reason", "default_score")


def d9_triage_score(spark, sf_dir):
    return N.triage_split(contents(spark, sf_dir), KEYWORDS).select("content_id", F.round("triage_score", 6).alias("triage_score"), "promoted")


def d10_filter_keywords(spark, sf_dir):
    return N.filter_keywords(contents(spark, sf_dir), KEYWORDS).select("content_id")


def d14_ratings(spark, sf_dir):
    c = contents(spark, sf_dir)
    return c.select("content_id", T.normalize_rating(F.col("rating"), F.col("channel")).alias("rating01"), F.md5("body").alias("content_hash"), F.length(T.truncate(F.col("body"), 500)).alias("n_truncated"))


QUERIES = {f.__name__: f for f in (d13_summaries, d1_clean_content, d3_dedup_content, d4_validate_length, d5_normalization_stats, d6_skip_reason, d7_language, d8_triage, d9_triage_score, d10_filter_keywords, d14_ratings)}

_LOW = "lower(title || chr(10) || body)"
ORACLES = {
    "d1_clean_content": CLEAN_SQL + " SELECT content_id, title, body FROM cleaned",
    "d3_dedup_content": DEDUP_SQL + " SELECT content_id, fingerprint FROM kept",
    "d4_validate_length": f"WITH {CONTENT_SQL} SELECT content_id, src FROM content WHERE length(title) + length(body) BETWEEN 10 AND 10000",
    "d5_normalization_stats": DEDUP_SQL + """, a AS (SELECT src, count(*) AS original_count FROM content GROUP BY src),
b AS (SELECT src, count(*) AS n FROM kept WHERE length(title) + length(body) BETWEEN 10 AND 10000 GROUP BY src)
SELECT src, original_count, coalesce(n, 0) AS final_count, original_count - coalesce(n, 0) AS removed_count, coalesce(n, 0) / original_count AS retention_rate FROM a LEFT JOIN b USING (src)""",
    "d6_skip_reason": f"WITH {CONTENT_SQL} SELECT content_id, {SKIP_SQL} AS skip_reason FROM content",
    "d7_language": f"WITH {CONTENT_SQL}, l AS (SELECT content_id, {LANGUAGE_SQL} AS language FROM content) SELECT *, language NOT IN ('en', 'unknown') AS non_english FROM l",
    "d8_triage": f"""WITH {CONTENT_SQL}, r AS (SELECT content_id, CASE WHEN length(trim(body)) < 100 THEN 'too_short'
 WHEN {_any('lower(title)', T.FUNCTIONAL_TITLE_PARTS)} AND length(trim(body)) < 300 THEN 'functional_page' WHEN {_any('lower(title)', T.TRIAGE_ERROR_PARTS)} THEN 'error_page' END AS r FROM content)
SELECT content_id, r IS NULL AS to_score, coalesce(r, 'passed') AS reason, CASE WHEN r IS NULL THEN 0.0 ELSE 0.5 END AS default_score FROM r""",
    "d9_triage_score": f"""WITH {CONTENT_SQL}, s AS (SELECT content_id, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN {_any(_LOW, KEYWORDS)} THEN 0.2 ELSE 0 END
 + CASE WHEN {_WC} < 30 THEN -0.1 WHEN {_WC} > 80 THEN 0.1 ELSE 0 END)), 6) AS triage_score FROM content) SELECT *, triage_score >= 0.6 AS promoted FROM s""",
    "d10_filter_keywords": f"WITH {CONTENT_SQL} SELECT content_id FROM content WHERE {_any(_LOW, KEYWORDS)}",
    "d14_ratings": f"""WITH {CONTENT_SQL} SELECT content_id, CASE channel WHEN 'amazon' THEN (rating - 1) / 4 WHEN 'reddit' THEN rating ELSE least(1.0, greatest(0.0, rating)) END AS rating01,
 md5(body) AS content_hash, least(length(body), 500) AS n_truncated FROM content""",
}
