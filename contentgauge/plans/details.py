"""Queries for branches that the given tables don't reach, with rows written out by id, and for details of other operators; with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import config as C
from contentgauge.functions import pages as P
from contentgauge.operators import analytics as A
from contentgauge.operators import normalize as N
from contentgauge.operators import page_tree
from contentgauge.operators import reports as R
from contentgauge.operators import review as V
from contentgauge.operators import runs as O
from contentgauge.operators import scoring as S
from contentgauge.operators import urls as U
from contentgauge.plans.normalization import LANGUAGE_SQL
from contentgauge.plans import scores as scores_plan
from contentgauge.plans.scores import CLASS_SQL, RUN, usage
from contentgauge.plans.urls import _MAIN, VARIED_SQL, urls
from contentgauge.sources import readers
from contentgauge.sources.tables import CONTENT_SQL, DIMENSIONS, SCORES_SQL, contents, scores, table

_LONG = "long enough text without anything odd " * 10
#: Titles, bodies and whether there is a screenshot by doc_id % 14, with the skip reason and the triage reason that they have.
GATED = [
    ("Access Denied", _LONG, False, "error_page", "error_page"), ("Oops 404", _LONG, False, "error_page", "error_page"), ("Fine", "An error occurred. " + _LONG, False, "error_page", "passed"), ("Please log in", _LONG, False, "login_wall", "passed"),
    ("Sign up now", "Come in. " * 20, False, "login_wall", "functional_page"), ("Fine", "Solve the captcha. " + _LONG, True, "login_wall", "passed"), ("Fine", "Too little.", False, "insufficient_content", "too_short"), ("Fine", "Too little.", True, None, "too_short"),
    ("Your cart", "Things to buy. " * 10, False, None, "functional_page"), ("Your cart", _LONG, False, None, "passed"), ("Internal Server Error", _LONG, False, "error_page", "error_page"), ("Page not found", "short", True, "error_page", "too_short"), ("Terror", "words " * 40, False, "error_page", "passed"), ("", _LONG, False, None, "passed"),
]
#: Hosts by page_id % 12 with the channel and platform type that they have, and those with the hint shopfeed.
HOSTS = [
    ("www.youtube.com", "youtube", "social"), ("youtu.be", "youtube", "social"), ("old.reddit.com", "reddit", "social"), ("amazon.co.uk", "amazon", "marketplace"), ("www.etsy.com", "etsy", "marketplace"), ("fb.com", "facebook", "social"),
    ("x.com", "twitter", "social"), ("ebay.com", "ebay", "marketplace"), ("myshop.example", "shopfeed", "marketplace"), ("forum.example", "shopfeed", "social"), ("plain.example", "shopfeed", "owned"), ("www.tiktok.com", "tiktok", "social"),
]
#: Lines of an answer by page_id % 8 ({H} is the page's host) and whether they name a domain.
LINES = [("https://www.{H}/path", True), ("- none here", False), ("{H} and others", True), ("# {H}", False), ("  HTTP://{H}  ", True), ("a.b", False), ("", False), ("http://shop.{H}", True)]


def _pick(rows, k, n):
    return F.element_at(F.array(*[F.lit(r[k]) for r in rows]), (n % len(rows) + 1).cast("int"))


def _gated(spark, sf_dir):
    n = F.col("seq")
    shot = F.when(_pick(GATED, 2, n), F.lit("s.png"))
    return contents(spark, sf_dir).withColumns({"title": _pick(GATED, 0, n), "body": _pick(GATED, 1, n), "screenshot_path": shot})


def d6_branches(spark, sf_dir):
    return N.with_skip_reason(_gated(spark, sf_dir)).select("content_id", "skip_reason")


def d8_branches(spark, sf_dir):
    return N.with_triage(_gated(spark, sf_dir)).select("content_id", "to_score", "reason", "default_score")


def g21_branches(spark, sf_dir):
    return O.blocked_urls(_gated(spark, sf_dir), RUN)


def d2_channels(spark, sf_dir):
    """Pages on known hosts, and on others with a hint."""
    n = F.col("page_id")
    url = F.concat(F.lit("https://"), _pick(HOSTS, 0, n), F.lit("/p/"), n.cast("string"))
    c = P.channel(url, F.lit("shopfeed"))
    return table(spark, sf_dir, "pages").select("page_id", c["channel"].alias("channel"), c["platform_type"].alias("platform_type"))


def c7_varied_urls(spark, sf_dir):
    """Main urls of brands of which some have hosts of other countries."""
    return U.main_urls(urls(spark, sf_dir, True), "page_id")


def c16_domains(spark, sf_dir):
    n = F.col("page_id")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    lines = table(spark, sf_dir, "pages").select(F.concat(F.lit("brand_"), (n % 3).cast("string")).alias("brand_id"), n.alias("pos"), F.replace(_pick(LINES, 0, n), F.lit("{H}"), host).alias("line"))
    return R.domain_candidates(lines)


def g18_gaps(spark, sf_dir):
    """Content of all brands but one and scores of all runs but one."""
    return A.run_presence(contents(spark, sf_dir).filter("brand_id <> 'brand_2'"), scores(spark, sf_dir).filter("run_id <> 'run_1'"))


#: Tokens of prompts and completions and dollars beyond which a run or model is over its quota.
QUOTA = (9_000, 5_000, 0.02)


def g20_over_quota(spark, sf_dir):
    """Usage against a quota that some runs and models are over."""
    found = A.usage_cost(usage(spark, sf_dir), C.prices(spark), ["run_id"], C.DEFAULT_MODEL, QUOTA)
    return found.withColumn("cost_usd", F.round("cost_usd", 9))


def g6_ratio(spark, sf_dir):
    items = S.classify(scores(spark, sf_dir)).select("content_id", *RUN, "overall").join(contents(spark, sf_dir).select("content_id", "title", "body").hint("shuffle_hash"), "content_id")
    adjusted = contents(spark, sf_dir).filter("seq % 5 = 0").select("content_id", (F.col("seq") % 100).cast("double").alias("adjusted"))
    return O.mean_ratio(O.item_summary(items, adjusted), RUN).withColumn("ratio_pct", F.round("ratio_pct", 9))


def _some_scores(spark, sf_dir):
    """Scores of which some are missing, with the platform type of their channel; some channels are unknown."""
    kind = F.when(F.col("channel").isin("youtube", "reddit"), "social").when(F.col("channel") == "amazon", "marketplace").when(F.col("channel") == "web", "owned").otherwise("email")
    return scores(spark, sf_dir).withColumns({"platform_type": F.when(F.col("seq") % 13 > 0, kind), "channel": F.when(F.col("seq") % 17 > 0, F.col("channel"))} | {"score_resonance": F.when(F.col("seq") % 3 > 0, F.col("score_resonance"))})


def g7_dimensions(spark, sf_dir):
    return A.modality_dimensions(_some_scores(spark, sf_dir), RUN).withColumn("average", F.round("average", 9))


def g7_insights(spark, sf_dir):
    """One brand has videos only."""
    s = _some_scores(spark, sf_dir).withColumn("modality", F.when(F.col("brand_id") == "brand_3", "video").otherwise(F.col("modality")))
    return A.modality_insights(A.modality_breakdown(s, RUN), RUN)


def _places(spark, sf_dir, by):
    found = A.place_breakdown(_some_scores(spark, sf_dir), RUN, by)
    return found.withColumns({c: F.round(c, 9) for c in (*DIMENSIONS, "overall")})


def g8_channel_dimensions(spark, sf_dir):
    return _places(spark, sf_dir, "channel")


def g8_platforms(spark, sf_dir):
    return _places(spark, sf_dir, "platform_type")


#: Visual results by doc_id % 8.
RESULTS = [
    ('{"signals": {"vis_clutter_score": {"score": 0.2}}, "overall_visual_score": 0.25, "status": "done"}',), ("{broken",), ("```json\n{\"signals\": {}}\n```",), ('{"status": "denied"}',), ("[1, 2]",), ("",), ('```\n{"overall_visual_score": 1}\n```',), ('"text"',),
]


def f24_results(spark, sf_dir):
    return R.visual_results(contents(spark, sf_dir).select("content_id", _pick(RESULTS, 0, F.col("seq")).alias("json")))


def b19_descriptions(spark, sf_dir):
    """Pages with short and long texts, of which some have a description."""
    n = F.col("page_id")
    meta = F.when(n % 3 == 0, F.concat(F.lit('<meta property="og:description" content=" What page '), n, F.lit(' is about. ">'))).when(n % 3 == 1, '<meta property="og:description" content="">').otherwise("")
    html = F.concat(F.lit("<html><head>"), meta, F.lit("</head><body><article>"), F.repeat(F.lit("ab "), (n % 100).cast("int")), F.lit("end</article></body></html>"))
    return page_tree.page_bodies(page_tree.page_trees(table(spark, sf_dir, "pages").withColumn("html", html))).select("page_id", "step", "body")


def d7_names(spark, sf_dir):
    return N.with_language(contents(spark, sf_dir)).select("content_id", "language_name", "non_english")


def d11_reading_time(spark, sf_dir):
    return V.text_stats(contents(spark, sf_dir)).select("content_id", "reading_time", F.array_join("weak_words", ",").alias("weak_words"))


def a5_collector(spark, sf_dir):
    """Pages as collected, with certificates, legal links and page metadata of some."""
    n = F.col("page_id")
    c = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("q"), n % 4).alias("query"), "url", F.lit("T").alias("title"), F.col("html").alias("body"), F.when(n % 6 == 0, True).alias("access_denied"), F.when(n % 2 == 0, F.lit("true")).otherwise("false").alias("ssl_valid"), F.when(n % 3 == 0, n).alias("ssl_expiry_days"),
        F.when(n % 5 == 0, "/privacy").alias("privacy"), F.when(n % 4 == 0, F.create_map(F.lit("title"), F.lit("Own"), F.lit("published_at"), F.lit("2020-01-01"), F.lit("terms"), F.lit("/t"))).alias("page_meta"), n.alias("page_id"),
    )
    m = F.col("meta_info")
    shown = ["query", "title", "access_denied", "published_at", "ssl_valid", "ssl_expiry_days", "ssl_issuer", "privacy", "terms"]
    return readers.from_collector(c).select("url", F.md5("raw_content").alias("raw_content"), F.md5(m["description"]).alias("description"), *[m[k].alias(k) for k in shown], F.size(F.map_keys("meta_info")).alias("keys"))


QUERIES = {
    f.__name__: f
    for f in (
        d6_branches, d8_branches, g21_branches, d2_channels, c7_varied_urls, c16_domains, g18_gaps, g20_over_quota, g6_ratio, g7_dimensions, g7_insights, g8_channel_dimensions, g8_platforms, f24_results, b19_descriptions, d7_names,
        d11_reading_time, a5_collector,
    )
}


def _case(rows, k, column="seq"):
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {column} % {len(rows)} " + " ".join(f"WHEN {i} THEN {one(r[k])}" for i, r in enumerate(rows)) + " END"


_MISSING = SCORES_SQL.replace("score_resonance", "resonance_0") + """,
sel AS (SELECT * REPLACE (CASE WHEN seq % 17 > 0 THEN channel END AS channel), CASE WHEN seq % 13 > 0 THEN CASE WHEN channel IN ('youtube', 'reddit') THEN 'social' WHEN channel = 'amazon' THEN 'marketplace' WHEN channel = 'web' THEN 'owned' ELSE 'email' END END AS platform_type, CASE WHEN seq % 3 > 0 THEN resonance_0 END AS score_resonance FROM scores)"""
_UNPIVOTED = "long AS (" + " UNION ALL ".join(f"SELECT brand_id, run_id, modality, '{d}' AS dimension, score_{d} AS score FROM sel" for d in DIMENSIONS) + ")"
_STATUS = lambda x: f"CASE WHEN round({x}, 9) >= 0.8 THEN 'excellent' WHEN round({x}, 9) >= 0.6 THEN 'good' WHEN round({x}, 9) >= 0.4 THEN 'moderate' ELSE 'poor' END"


def _places_sql(by: str) -> str:
    means = ", ".join(f"avg(score_{d}) AS {d}" for d in DIMENSIONS)
    total = f"(list_sum(list_filter([{', '.join(DIMENSIONS)}], lambda x: x IS NOT NULL)) / len(list_filter([{', '.join(DIMENSIONS)}], lambda x: x IS NOT NULL)))"
    return f"""WITH {_MISSING}, g AS (SELECT brand_id, run_id, coalesce({by}, 'unknown') AS {by}, count(*) AS n, count(DISTINCT coalesce(channel, 'unknown')) AS channels, {means} FROM (SELECT brand_id, run_id, seq, channel{', platform_type' if by != 'channel' else ''}, {', '.join(f'score_{d}' for d in DIMENSIONS)} FROM sel) GROUP BY ALL),
h AS (SELECT *, {total} AS overall FROM g) SELECT brand_id, run_id, {by}, n, channels, {', '.join(f'round({d}, 9) AS {d}' for d in DIMENSIONS)}, round(overall, 9) AS overall, {_STATUS('overall')} AS status, row_number() OVER (PARTITION BY brand_id, run_id ORDER BY n DESC, {by}) AS place FROM h"""


ORACLES = {
    "d6_branches": f"WITH {CONTENT_SQL} SELECT content_id, {_case(GATED, 3)} AS skip_reason FROM content",
    "d8_branches": f"WITH {CONTENT_SQL} SELECT content_id, {_case(GATED, 4)} = 'passed' AS to_score, {_case(GATED, 4)} AS reason, CASE WHEN {_case(GATED, 4)} = 'passed' THEN 0e0 ELSE 0.5 END AS default_score FROM content",
    "g21_branches": f"WITH {CONTENT_SQL}, s AS (SELECT *, {_case(GATED, 3)} AS skip_reason FROM content) SELECT brand_id, run_id, skip_reason, count(*) AS n, min(content_id) AS first FROM s WHERE skip_reason IN ('error_page', 'login_wall') GROUP BY ALL",
    "d2_channels": f"SELECT page_id, {_case(HOSTS, 1, 'page_id')} AS channel, {_case(HOSTS, 2, 'page_id')} AS platform_type FROM pages",
    "c7_varied_urls": f"WITH {VARIED_SQL}, {_MAIN} SELECT brand_id, main_url, abroad AND main_url IS NOT NULL AS has_variants FROM main",
    "c16_domains": """WITH h AS (SELECT page_id, 'brand_' || page_id % 3 AS brand_id, lower(replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', '')) AS host FROM pages),
d AS (SELECT brand_id, page_id AS pos, CASE page_id % 8 WHEN 0 THEN host WHEN 2 THEN host WHEN 7 THEN 'shop.' || host END AS domain FROM h), f AS (SELECT brand_id, domain, min(pos) AS pos FROM d WHERE domain IS NOT NULL GROUP BY ALL)
SELECT brand_id, domain, pos, row_number() OVER (PARTITION BY brand_id ORDER BY pos, domain) AS rank FROM f QUALIFY rank <= 15""",
    "g18_gaps": f"""WITH {SCORES_SQL}, n AS (SELECT run_id, brand_id, src, count(*) AS normalized_rows FROM content WHERE brand_id <> 'brand_2' GROUP BY ALL), s AS (SELECT run_id, brand_id, src, count(*) AS scores_rows FROM scores WHERE run_id <> 'run_1' GROUP BY ALL)
SELECT *, normalized_rows IS NOT NULL AS in_normalized, scores_rows IS NOT NULL AS in_scores FROM n FULL JOIN s USING (run_id, brand_id, src)""",
    "g20_over_quota": scores_plan.ORACLES["g20_usage_cost"].replace("prompt_tokens > 100000 OR completion_tokens > 50000 OR cost_usd > 1.0", f"prompt_tokens > {QUOTA[0]} OR completion_tokens > {QUOTA[1]} OR cost_usd > {QUOTA[2]}"),
    "g6_ratio": f"WITH {CLASS_SQL} SELECT brand_id, run_id, round(avg(CASE WHEN seq % 5 = 0 THEN seq % 100 ELSE overall * 100 END), 9) AS ratio_pct, count(*) AS items FROM cls GROUP BY ALL",
    "g7_dimensions": f"WITH {_MISSING}, {_UNPIVOTED} SELECT brand_id, run_id, modality, dimension, round(avg(score), 9) AS average, min(score) AS low, max(score) AS high, count(score) AS samples FROM long GROUP BY ALL HAVING count(score) > 0",
    "g7_insights": f"""WITH {_MISSING}, {_UNPIVOTED}, x AS (SELECT * REPLACE (CASE WHEN brand_id = 'brand_3' THEN 'video' ELSE modality END AS modality) FROM long), m AS (SELECT brand_id, run_id, modality, round(sum(score) / count(score), 9) AS t, count(*) / 5 AS n FROM x GROUP BY ALL)
SELECT brand_id, run_id, CASE WHEN count(*) > 1 THEN arg_min(modality, (-t, modality)) END AS strongest, CASE WHEN count(*) > 1 THEN arg_min(modality, (t, modality)) END AS weakest, arg_min(modality, (-n, modality)) AS most_common, count(*) AS modalities FROM m GROUP BY ALL""",
    "g8_channel_dimensions": _places_sql("channel"),
    "g8_platforms": _places_sql("platform_type"),
    "f24_results": f"""WITH {CONTENT_SQL}, k AS (SELECT content_id, seq % 8 AS k FROM content) SELECT content_id, k IN (0, 2, 6) AS success, CASE WHEN k = 3 THEN 'Visual analysis skipped: Access Denied to website' WHEN k IN (1, 4, 5, 7) THEN 'Failed to parse AI response' END AS error,
 CASE k WHEN 0 THEN 0.25 WHEN 2 THEN 0.5 WHEN 6 THEN 1e0 END AS overall_visual_score, CASE k WHEN 0 THEN 'done' WHEN 3 THEN 'denied' END AS status, CASE k WHEN 0 THEN 1 ELSE 0 END AS n_signals FROM k""",
    "b19_descriptions": """WITH t AS (SELECT page_id, 3 * (page_id % 100) + 3 AS n, repeat('ab ', page_id % 100) || 'end' AS text FROM pages)
SELECT page_id, CASE WHEN n < 200 AND page_id % 3 = 0 THEN 'description' WHEN n >= 100 THEN 'article' ELSE 'body' END AS step, CASE WHEN n < 200 AND page_id % 3 = 0 THEN 'What page ' || page_id || ' is about.' ELSE text END AS body FROM t""",
    "d7_names": f"WITH {CONTENT_SQL}, l AS (SELECT content_id, {LANGUAGE_SQL} AS language FROM content) SELECT content_id, CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE 'Unknown' END AS language_name, language IN ('fr', 'es') AS non_english FROM l",
    "d11_reading_time": f"""WITH {CONTENT_SQL} SELECT content_id, round(length(regexp_replace(body, '\\s+', '', 'g')) * 14.69 / 1000, 2) AS reading_time,
 array_to_string(list_filter({V.WEAK}, lambda w: contains(lower(body), ' ' || w || ' ')), ',') AS weak_words FROM content""",
    "a5_collector": """SELECT url, md5(html) AS raw_content, md5(substr(html, 1, 500)) AS description, 'q' || page_id % 4 AS query, CASE WHEN page_id % 4 = 0 THEN 'Own' ELSE 'T' END AS title, CASE WHEN page_id % 6 = 0 THEN 'true' ELSE 'false' END AS access_denied, CASE WHEN page_id % 4 = 0 THEN '2020-01-01' END AS published_at,
 CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END AS ssl_valid, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) END AS ssl_expiry_days, CAST(NULL AS VARCHAR) AS ssl_issuer, CASE WHEN page_id % 5 = 0 THEN '/privacy' END AS privacy, CASE WHEN page_id % 4 = 0 THEN '/t' END AS terms,
 CAST(6 + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END AS INTEGER) AS keys FROM pages""",
}
