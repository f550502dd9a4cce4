"""Queries of the report operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import config as C
from contentgauge.functions import pages
from contentgauge.functions import urls as U
from contentgauge.operators import analytics as A
from contentgauge.operators import detectors, normalize
from contentgauge.operators import reports as P
from contentgauge.operators import scoring as S
from contentgauge.operators import urls as U_ops
from contentgauge.plans.scores import ATTR_SQL, CLASS_SQL, LONG_SQL, RUN, SIGNAL_SQL, _dims_sql, _signals, _trust_sql, attributes
from contentgauge.plans.urls import _HOST, BRANDS, brands, urls
from contentgauge.sources.tables import CONTENT_SQL, DIMENSIONS, contents, scores, table

MULTIPLIERS = [("coherence", "landing_page", 1.2), ("coherence", "_default", 1.1), ("verification", "other", 1.3), ("resonance", "_default", 1.0)]


def _typed(spark, sf_dir):
    """Scores of documents with the url of the page of their id, or none."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")
    return scores(spark, sf_dir).join(p.hint("shuffle_hash"), "seq", "left").withColumn("content_type", P.content_type(F.col("url"), F.col("channel")))


def c9_national_urls(spark, sf_dir):
    u = urls(spark, sf_dir).withColumn("url", F.regexp_replace("url", r"://[^/]*\.example\.(com|net|org)", "://www.brand0.com.au"))
    return u.select("page_id", U.national_url(F.col("url"), F.lit("brand_0")).alias("national"))


def c10_expand_brands(spark, sf_dir):
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("brand_name")).unionByName(table(spark, sf_dir, "region").select(F.concat("r_name", F.lit("-x")).alias("brand_name")))
    e = P.expand_brands(b)
    return e.select("brand_name", *[F.array_join(c, " ").alias(c) for c in ("domains", "subdomains", "handles")])


def c13_profiles(spark, sf_dir):
    """Page urls with their hosts moved to a platform."""
    sites = F.element_at(F.array(*map(F.lit, ["www.instagram.com", "linkedin.com", "x.com", "example.com"])), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://"), sites, F.when(F.col("page_id") % 3 == 0, "/company").otherwise(""), U.path(F.col("url")))
    return urls(spark, sf_dir).select("page_id", P.valid_profile(url).alias("valid"))


def c16_candidates(spark, sf_dir):
    c = urls(spark, sf_dir).select("brand_id", F.concat("url", F.lit(".,")).alias("url"), F.col("page_id").alias("pos"), (F.col("page_id") % 5).alias("confidence"))
    return P.rank_candidates(c, brands(spark), 20)


def _reused(spark, sf_dir):
    """Orders as runs of customers, line items as assets found by their ship mode under their part's url; some have no query or url."""
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("brand_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"))
    k = F.col("l_partkey")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("raw_content"), F.when(k % 7 > 0, F.col("l_returnflag")).alias("query"), F.when(k % 5 > 0, F.concat(F.lit("https://p/"), k)).alias("url")
    )
    return normalize.reuse_recent(items, runs, F.to_timestamp(F.lit("1998-01-01")), 240)


def d15_reuse(spark, sf_dir):
    return _reused(spark, sf_dir).select("run_id", "line", "brand_id")


def d15_by_query(spark, sf_dir):
    return normalize.reused_by_query(_reused(spark, sf_dir))


def d15_new_candidates(spark, sf_dir):
    """Parts as candidates whose pages no reused asset has; every tenth has no url."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 > 0, F.concat(F.lit("https://p/"), "p_partkey")).alias("url"))
    return normalize.exclude_known(p, _reused(spark, sf_dir)).select("p_partkey", "url")


def d16_site_signals(spark, sf_dir):
    """Documents as pages of sites; some brands' global pages speak of people or disclose AI."""
    k = F.col("seq") % 11
    path = F.element_at(F.array(*map(F.lit, ["x", "About", "our-story", "team/1", "support", "help", "privacy", "legal", "editorial", "policy", "contact"])), (k + 1).cast("int"))
    said = F.when((F.col("seq") % 7 < 3) & k.isin(1, 9), "Written with Artificial Intelligence. ").when((F.col("seq") % 7 == 3) & (k == 7), "generated by AI ").when((F.col("seq") % 7 > 4) & (k == 2), "The Team. ").when((F.col("seq") % 7 == 4) & (k == 3), "the team, Editor ").otherwise("")
    a = contents(spark, sf_dir).withColumns({"url": F.concat(F.lit("http://s/"), path), "body": F.concat(said, F.col("body"))})
    return detectors.site_signals(a, RUN)


def d17_quota(spark, sf_dir):
    used = urls(spark, sf_dir).select(F.col("brand_id").alias("query"))
    return normalize.remaining_quota(brands(spark).select(F.col("brand_id").alias("query")), used, 10_000)


def f5_multipliers(spark, sf_dir):
    long = A.unpivoted(_typed(spark, sf_dir), ["content_id", "content_type"])
    found = P.apply_multipliers(long, spark.createDataFrame(MULTIPLIERS, "dimension string, content_type string, multiplier double"))
    return found.select("content_id", "dimension", "content_type", F.round("adjusted", 9).alias("adjusted"))


def f24_visual_signals(spark, sf_dir):
    """A visual result in JSON for each document; every seventh is broken text, every fifth failed, every third in a fence."""
    n = F.col("seq")
    body = F.format_string('{"signals": {"vis_design_quality": {"score": %.2f}, "vis_clutter_score": {"confidence": 0.5}, "other": {"score": 1}}, "status": "%s"}', (n % 101) / 100.0, F.when(n % 5 == 0, "failed").otherwise("done"))
    text = F.when(n % 7 == 0, "{broken").when(n % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return P.visual_signals(contents(spark, sf_dir).select("content_id", text.alias("json")), C.signal_defs(spark))


def g13_key_signals(spark, sf_dir):
    """Attributes and signals with the item's number and one of five urls; some evidence is empty."""
    own = {"seq": F.substring("content_id", 5, 20).cast("bigint")}
    named = lambda df: df.withColumns(own).withColumn("url", F.concat(F.lit("u"), F.col("seq") % 5))
    a = named(attributes(spark, sf_dir)).withColumn("evidence", F.when(F.col("seq") % 3 > 0, F.concat_ws(" ", "evidence", "attribute_id")).otherwise(""))
    s = named(_signals(spark, sf_dir)).withColumn("evidence", F.concat(F.lit("signal "), "signal_id"))
    maps = [spark.createDataFrame(rows, kind) for rows, kind in ((P.key_signal_rows(), "attribute_id string, key_signal string"), (list(P.SIGNAL_KEY_SIGNALS.items()), "signal_id string, key_signal string"), (P.expected_rows(), "dimension string, key_signal string"))]
    found = P.key_signal_status(a, s, *maps, RUN)
    return found.withColumns({"mean": F.round("mean", 9), "evidence": F.coalesce(F.array_join(F.transform("evidence", lambda x: F.concat_ws("@", x["evidence"], x["url"])), "; "), F.lit(""))})


def g14_contributions(spark, sf_dir):
    s, defs = _signals(spark, sf_dir), C.signal_defs(spark)
    means = s.groupBy(*RUN, "dimension", "signal_id").agg((F.avg("value") * 10).alias("mean"), F.first("weight").alias("weight"))
    return P.contributions(means, S.aggregate_dimensions(s, defs, RUN), RUN).groupBy(*RUN, "dimension").agg(F.round(F.sum("share"), 1).alias("total"))


def _findings(spark, sf_dir):
    """Attributes of documents on a hundred urls, labelled by their ids, and two rules for each document: one of a label that attributes have too."""
    n = F.substring("content_id", 5, 20).cast("bigint")
    url = F.concat(F.lit("u"), F.col("seq") % 100)
    a = attributes(spark, sf_dir).withColumn("seq", n).select(*RUN, "content_id", "seq", "dimension", "attribute_id", url.alias("url"), F.substring_index("attribute_id", "_", 1).alias("label"), "value")
    rule = lambda d, label, v: F.struct(F.lit(d).alias("dimension"), F.lit(label).alias("label"), v.cast("double").alias("value"))
    both = F.array(rule("coherence", "broken", F.col("seq") % 11), rule("resonance", "thin page", F.col("seq") % 12))
    rules = contents(spark, sf_dir).select(*RUN, "content_id", "seq", url.alias("url"), F.explode(both).alias("r")).select(*RUN, "content_id", "seq", "url", "r.*")
    return P.findings(a, rules)


def g15_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select(*RUN, "content_id", "dimension", "url", "label", "value", "kind", "origin")


def g15_issues(spark, sf_dir):
    return P.finding_counts(_findings(spark, sf_dir), RUN)


def g16_context(spark, sf_dir):
    return P.recommendation_context(scores(spark, sf_dir), RUN).withColumns({"average": F.round("average", 9), "gap": F.round("gap", 9)})


def g16_run_context(spark, sf_dir):
    return P.run_context(S.classify(scores(spark, sf_dir)), RUN).withColumn("average", F.round("average", 9))


def g16_low_items(spark, sf_dir):
    return P.low_items(S.classify(scores(spark, sf_dir)), RUN).select(*RUN, "content_id", "overall", "rank")


def g17_targets(spark, sf_dir):
    return P.success_targets(A.dimension_breakdown(scores(spark, sf_dir), RUN)).select(*RUN, "dimension", F.round("target", 9).alias("target"), "timeline")


def g17_overall(spark, sf_dir):
    return P.overall_targets(S.classify(scores(spark, sf_dir)), RUN).withColumns({"current": F.round("current", 9), "target": F.round("target", 9)})


def g24_calibration(spark, sf_dir):
    sums = ["marketing", "coherence", "verification", "base_coherence", "base_verification"]
    return P.calibration_summary(_typed(spark, sf_dir), RUN).select(*RUN, "n", *[F.round(c, 9).alias(c) for c in [*[f"high_{d}" for d in DIMENSIONS], *sums]])


def g25_examples(spark, sf_dir):
    return P.example_items(S.classify(scores(spark, sf_dir)), RUN).select(*RUN, "content_id", "rank")


def g26_brand_score(spark, sf_dir):
    s = _signals(spark, sf_dir)
    trust = S.trust_score(S.aggregate_dimensions(s, C.signal_defs(spark), ["content_id", "brand_id"]), ["content_id", "brand_id"])
    found = P.brand_score(trust, s, [x[0] for x in C.SIGNALS])
    return found.select("brand_id", *[F.round(c, 9).alias(c) for c in ("overall", "confidence", "coverage")], F.array_join("missing", ",").alias("missing"))


def g28_content_mix(spark, sf_dir):
    return P.content_mix(_typed(spark, sf_dir), RUN)


def c14_broken_links(spark, sf_dir):
    """Links in conversation turns against a status table of page urls; a link that is nowhere counts as working."""
    p = table(spark, sf_dir, "pages")
    said = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("content_id"), F.concat(F.lit("see "), F.col("url"), F.lit(" and (http://a.b/c) or "), F.col("url")).alias("body"))
    status = p.filter("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("k")).select("url", F.when(F.col("k") % 6 == 0, 404).when(F.col("k") % 6 == 2, 403).otherwise(200).alias("status"), (F.col("k") % 10 == 0).alias("failed"))
    return U_ops.broken_links(said, status)


def d2_metadata(spark, sf_dir):
    """Channel, platform type and modality of pages where they are not known yet."""
    u = urls(spark, sf_dir)
    c = pages.channel(F.col("url"), F.when(F.col("page_id") % 2 == 0, "shopfeed"))
    return u.select("page_id", c["channel"].alias("channel"), c["platform_type"].alias("platform_type"), pages.modality(F.concat("url", F.when(F.col("page_id") % 5 == 0, ".mp4").otherwise("")), F.lit("web"), F.lit(""), F.lit(None).cast("string")).alias("modality"))


def g23_visual_snapshot(spark, sf_dir):
    n = F.col("seq")
    items = contents(spark, sf_dir).select(*RUN, "content_id", "seq", (n % 7 != 0).alias("success"), F.when(n % 5 == 0, "denied").otherwise("done").alias("status"), F.when(n % 2 == 0, (n % 97) / 100.0).alias("design_score"), ((n * 7) % 89 / 100.0).alias("overall_visual_score"))
    return P.visual_snapshot(items, RUN).select(*RUN, "content_id", "score", "list", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        c9_national_urls, c10_expand_brands, c13_profiles, c16_candidates, d15_reuse, d15_by_query, d15_new_candidates, d16_site_signals, d17_quota, f5_multipliers, f24_visual_signals, g13_key_signals, g14_contributions, g15_findings, g15_issues, g16_context,
        g16_run_context, g16_low_items, g17_targets, g17_overall, g23_visual_snapshot, g24_calibration, c14_broken_links, d2_metadata, g25_examples, g26_brand_score, g28_content_mix,
    )
}

_q = lambda s: "'" + s + "'"
_part = lambda x, xs: "(" + " OR ".join(f"contains({x}, {_q(s)})" for s in xs) + ")"
_PATH = r"regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_LOW = "lower(coalesce(url, ''))"
_TYPE = f"CASE WHEN contains({_LOW}, '/blog/') THEN 'blog' WHEN {_part(_LOW, ['/news/', '/story/'])} THEN 'news' WHEN contains({_LOW}, '/article/') THEN 'article' WHEN {_part(_LOW, P.LEGAL)} THEN 'legal_policy' WHEN ends_with({_LOW}, '/') OR {_part(_LOW, P.LANDING)} THEN 'landing_page' WHEN channel IN ('reddit', 'twitter', 'facebook', 'instagram') THEN 'social_post' ELSE 'other' END"
TYPED_SQL = CLASS_SQL + f", typed AS (SELECT cls.*, {_TYPE} AS content_type FROM cls LEFT JOIN pages ON page_id = seq)"
_MULT = "CASE WHEN dimension = 'coherence' THEN CASE content_type WHEN 'landing_page' THEN 1.2 ELSE 1.1 END WHEN dimension = 'verification' AND content_type = 'other' THEN 1.3 ELSE 1.0 END"
_BELOW = "CASE attribute_id WHEN 'author_brand_identity_verified' THEN 6 WHEN 'readability_grade_level_fit' THEN 7 ELSE 10 END"
_FORMS = "CASE WHEN contains(n, ' ') THEN [replace(n, ' ', '-'), replace(n, ' ', '')] WHEN contains(n, '-') THEN [n, replace(n, '-', '')] ELSE [n] END"
_LIFTED = "content_type IN ('landing_page', 'product_page', 'other')"
FINDINGS_SQL = f"""{ATTR_SQL}, fa AS (SELECT brand_id, run_id, content_id, dimension, 'u' || CAST(content_id[5:] AS BIGINT) % 100 AS url, split_part(attribute_id, '_', 1) AS label, value, unnest(list_filter([CASE WHEN value < {_BELOW} THEN 'issue' END, CASE WHEN value >= 8 THEN 'success' END], lambda x: x IS NOT NULL)) AS kind FROM attrs),
fr AS (SELECT brand_id, run_id, content_id, seq, 'coherence' AS dimension, 'u' || seq % 100 AS url, 'broken' AS label, CAST(seq % 11 AS DOUBLE) AS value FROM content UNION ALL SELECT brand_id, run_id, content_id, seq, 'resonance', 'u' || seq % 100, 'thin page', CAST(seq % 12 AS DOUBLE) FROM content),
fk AS (SELECT *, 'issue' AS kind FROM fr WHERE value < 10 UNION ALL SELECT *, 'success' FROM fr WHERE value >= 8), fo AS (SELECT * FROM fk QUALIFY row_number() OVER (PARTITION BY dimension, url, label, kind ORDER BY value, seq) = 1),
found AS (SELECT *, 'attribute' AS origin FROM fa UNION ALL SELECT brand_id, run_id, content_id, dimension, url, label, value, kind, 'rule' FROM fo ANTI JOIN fa USING (dimension, url, label, kind))"""
REUSED_SQL = """WITH ru AS (SELECT l_orderkey AS run_id, l_linenumber AS line, o_custkey AS brand_id, l_partkey AS k, CASE WHEN l_partkey % 7 > 0 THEN l_returnflag END AS query FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 240 HOUR AND o_orderstatus <> 'F' AND trim(l_returnflag) <> '')"""
ORACLES = {
    "c9_national_urls": r"SELECT page_id, regexp_replace(url, '://[^/]*[.]example[.](com|net|org)', '://www.brand0.au') AS national FROM pages",
    "c10_expand_brands": f"""WITH b AS (SELECT n_name AS brand_name FROM nation UNION ALL SELECT r_name || '-x' FROM region), f AS (SELECT brand_name, n, {_FORMS} AS forms FROM (SELECT brand_name, lower(trim(brand_name)) AS n FROM b))
SELECT brand_name, array_to_string(flatten(list_transform(forms, lambda x: [x || '.com', 'www.' || x || '.com'])), ' ') AS domains,
 array_to_string(flatten(list_transform(forms, lambda x: ['blog.' || x || '.com', 'www.' || x || '.com', 'shop.' || x || '.com', 'store.' || x || '.com'])), ' ') AS subdomains,
 array_to_string(list_concat(flatten(list_transform(forms, lambda x: ['@' || x, x])), CASE WHEN list_contains(forms, n) THEN [] ELSE ['@' || n, n] END), ' ') AS handles FROM f""",
    "c13_profiles": f"""WITH p AS (SELECT page_id, page_id % 4 AS s, CASE WHEN page_id % 3 = 0 THEN '/company' ELSE '' END || lower({_PATH}) AS path FROM pages)
SELECT page_id, CASE WHEN s = 0 THEN path NOT IN ('', '/') AND NOT {_part('path', ['/p/', '/tv/', '/explore/', '/accounts/', '/reels/', '/stories/'])} WHEN s = 1 THEN {_part('path', ['/company/', '/showcase/'])}
 WHEN s = 2 THEN path NOT IN ('', '/') AND NOT {_part('path', ['/i/', '/search/', '/hashtag/', '/status/', '/explore/', '/notifications/'])} END AS valid FROM p""",
    "c16_candidates": f"""WITH u AS (SELECT 'brand_' || page_id % 3 AS brand_id, url, min(page_id) AS pos, arg_min(page_id % 5, page_id) AS confidence FROM pages GROUP BY ALL), h AS (SELECT *, {_HOST} AS host FROM u),
k AS (SELECT *, CASE WHEN regexp_replace(host, '^www[.]', '') IN ({', '.join(_q(d) for b in BRANDS for d in b[1])}) AND list_contains(CASE brand_id {' '.join(f"WHEN '{b[0]}' THEN {b[1]}" for b in BRANDS)} END, regexp_replace(host, '^www[.]', '')) THEN 'primary' ELSE 'subdomain' END AS kind FROM h WHERE ends_with(host, '.com') OR ends_with(host, '.us'))
SELECT brand_id, url, pos, confidence, kind, row_number() OVER (PARTITION BY brand_id ORDER BY kind <> 'primary', confidence DESC, pos) AS rank FROM k QUALIFY rank <= 20""",
    "d15_reuse": REUSED_SQL + " SELECT run_id, line, brand_id FROM ru",
    "d15_by_query": REUSED_SQL + " SELECT query, count(*) AS reused FROM ru WHERE query IS NOT NULL GROUP BY query",
    "d15_new_candidates": REUSED_SQL + " SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN 'https://p/' || p_partkey END AS url FROM part WHERE p_partkey % 10 = 0 OR p_partkey NOT IN (SELECT k FROM ru WHERE k % 5 > 0)",
    "d16_site_signals": f"""WITH {CONTENT_SQL}, m AS (SELECT *, seq % 11 AS k,
 CASE WHEN seq % 7 < 3 AND seq % 11 IN (1, 9) THEN 'ai' WHEN seq % 7 = 3 AND seq % 11 = 7 THEN 'ai' WHEN seq % 7 > 4 AND seq % 11 = 2 THEN 'people' ELSE '' END AS said FROM content)
SELECT brand_id, run_id, bool_or(k IN (1, 2, 3, 6, 7, 8) AND (said = 'ai' OR contains(lower(body), 'ai-generated') OR contains(lower(body), 'generated by ai'))) AS has_global_ai_disclosure,
 bool_or(k IN (1, 2, 3) AND (said = 'people' OR contains(body, 'Team'))) AS has_global_author_info, count(*) FILTER (WHERE k NOT IN (0, 9)) AS global_pages FROM m GROUP BY ALL""",
    "d17_quota": "SELECT 'brand_' || page_id % 3 AS query, greatest(0, 10000 - count(*)) AS remaining FROM pages GROUP BY ALL HAVING remaining > 0",
    "f5_multipliers": f"WITH {TYPED_SQL}, {LONG_SQL.replace('FROM cls', 'FROM typed')} SELECT content_id, dimension, content_type, round(least(1.0, score * {_MULT}), 9) AS adjusted FROM long",
    "f24_visual_signals": f"""WITH {CONTENT_SQL}, ok AS (SELECT * FROM content WHERE seq % 7 <> 0 AND seq % 5 <> 0)
SELECT content_id, 'vis_design_quality' AS signal_id, 'coherence' AS dimension, 0.15 AS weight, (seq % 101) / 100.0 AS value, 0.7 AS confidence FROM ok
UNION ALL SELECT content_id, 'vis_clutter_score', 'coherence', 0.10, 0.5, 0.5 FROM ok""",
    "g13_key_signals": f"""WITH {SIGNAL_SQL}, km AS (SELECT * FROM ({C.values_sql(P.key_signal_rows())}) AS t(attribute_id, key_signal)), ks AS (SELECT * FROM ({C.values_sql(list(P.SIGNAL_KEY_SIGNALS.items()))}) AS t(signal_id, key_signal)),
ex AS (SELECT * FROM ({C.values_sql(P.expected_rows())}) AS t(dimension, key_signal)),
u AS (SELECT brand_id, run_id, dimension, key_signal, value, CASE WHEN seq % 3 > 0 THEN evidence || ' ' || attribute_id ELSE '' END AS evidence, 0 AS o, seq FROM (SELECT *, CAST(content_id[5:] AS BIGINT) AS seq FROM attrs) JOIN km USING (attribute_id)
 UNION ALL SELECT brand_id, run_id, dimension, key_signal, value * 10, 'signal ' || signal_id, 1, CAST(content_id[5:] AS BIGINT) FROM sig JOIN ks USING (signal_id)),
v AS (SELECT u.*, 'u' || seq % 5 AS url FROM u SEMI JOIN ex USING (dimension, key_signal)), m AS (SELECT brand_id, run_id, dimension, key_signal, avg(value) AS mean, count(*) AS n FROM v GROUP BY ALL),
e AS (SELECT brand_id, run_id, dimension, key_signal, evidence, url, min((o, seq)) AS f FROM v WHERE evidence <> '' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY brand_id, run_id, dimension, key_signal ORDER BY f, evidence, url) AS place FROM e QUALIFY place <= 3),
t AS (SELECT brand_id, run_id, dimension, key_signal, string_agg(evidence || '@' || url, '; ' ORDER BY place) AS evidence FROM p GROUP BY ALL), g AS (SELECT DISTINCT brand_id, run_id, ex.dimension, ex.key_signal FROM attrs, ex)
SELECT brand_id, run_id, dimension, key_signal, round(coalesce(mean, 0.0), 9) AS mean, coalesce(n, 0) AS n, coalesce(evidence, '') AS evidence, CASE WHEN round(mean, 9) >= 7 THEN 'pass' WHEN round(mean, 9) >= 4 THEN 'warn' ELSE 'fail' END AS status
FROM g LEFT JOIN m USING (brand_id, run_id, dimension, key_signal) LEFT JOIN t USING (brand_id, run_id, dimension, key_signal)""",
    # shares of a dimension add up to its rounded score
    "g14_contributions": f"WITH {SIGNAL_SQL}, {_dims_sql('brand_id, run_id')} SELECT brand_id, run_id, dimension, round(round(value, 9), 1) AS total FROM dims WHERE EXISTS (SELECT 1 FROM sig WHERE sig.brand_id = dims.brand_id AND sig.run_id = dims.run_id AND sig.dimension = dims.dimension)",
    "c14_broken_links": r"""WITH s AS (SELECT url, min(page_id) AS k FROM pages WHERE page_id % 2 = 0 GROUP BY url), l AS (SELECT DISTINCT 'p' || page_id AS content_id, unnest([url, 'http://a.b/c']) AS url FROM pages)
SELECT content_id, count(*) AS links, count(*) FILTER (WHERE k % 6 = 0 OR k % 10 = 0) AS broken FROM l LEFT JOIN s USING (url) GROUP BY content_id""",
    "d2_metadata": f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), b AS (SELECT *, replace(host, 'www.', '') AS bare FROM h)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'shopfeed' ELSE split_part(bare, '.', 1) END AS channel, CASE WHEN page_id % 2 = 0 AND {_part('bare', ['shop', 'store', 'buy', 'cart'])} THEN 'marketplace' WHEN page_id % 2 = 0 AND {_part('bare', ['social', 'community', 'forum'])} THEN 'social' ELSE 'owned' END AS platform_type,
 CASE WHEN page_id % 5 = 0 THEN 'video' ELSE 'text' END AS modality FROM b""",
    "g23_visual_snapshot": f"""WITH {CONTENT_SQL}, i AS (SELECT brand_id, run_id, content_id, seq, coalesce(CASE WHEN seq % 2 = 0 THEN (seq % 97) / 100.0 END, (seq * 7) % 89 / 100.0) AS score FROM content WHERE seq % 7 <> 0 AND seq % 5 <> 0)
SELECT brand_id, run_id, content_id, score, 'best' AS list, row_number() OVER (PARTITION BY brand_id, run_id ORDER BY score DESC, seq) AS rank FROM i QUALIFY rank = 1
UNION ALL SELECT brand_id, run_id, content_id, score, 'worst', row_number() OVER (PARTITION BY brand_id, run_id ORDER BY score, seq) AS rank FROM i QUALIFY rank <= 2""",
    "g15_findings": f"WITH {FINDINGS_SQL} SELECT * FROM found",
    "g15_issues": f"WITH {FINDINGS_SQL} SELECT brand_id, run_id, dimension, count(*) FILTER (WHERE kind = 'issue') AS issues, count(*) FILTER (WHERE kind = 'success') AS successes, count(DISTINCT url) FILTER (WHERE kind = 'issue') AS pages FROM found GROUP BY ALL",
    "g16_run_context": f"""WITH {CLASS_SQL}, {LONG_SQL}, m AS (SELECT brand_id, run_id, dimension, round(avg(score), 9) AS a, avg(score) AS e FROM long GROUP BY ALL),
t AS (SELECT brand_id, run_id, avg(e) AS average, array_to_string(list(dimension ORDER BY a, dimension)[1:3], ',') AS weakest, array_to_string(list(dimension ORDER BY a DESC, dimension)[1:2], ',') AS strongest FROM m GROUP BY ALL),
c AS (SELECT brand_id, run_id, count(*) FILTER (WHERE class_label = 'authentic') AS high_trust, count(*) FILTER (WHERE class_label = 'suspect') AS moderate_trust, count(*) FILTER (WHERE class_label = 'inauthentic') AS low_trust, count(DISTINCT src) AS sources, count(*) FILTER (WHERE overall < 0.6) AS low_items FROM cls GROUP BY ALL)
SELECT c.*, round(average, 9) AS average, weakest, strongest, CASE WHEN average >= 0.8 THEN 'excellent' WHEN average >= 0.6 THEN 'good' WHEN average >= 0.4 THEN 'fair' ELSE 'poor' END AS band FROM t JOIN c USING (brand_id, run_id)""",
    "g16_low_items": f"WITH {CLASS_SQL} SELECT brand_id, run_id, content_id, overall, row_number() OVER (PARTITION BY brand_id, run_id ORDER BY overall, seq) AS rank FROM cls WHERE overall < 0.6 QUALIFY rank <= 5",
    "g17_overall": f"""WITH {CLASS_SQL}, m AS (SELECT brand_id, run_id, count(*) FILTER (WHERE overall < 0.5) AS low, avg(overall) AS a FROM cls GROUP BY ALL)
SELECT brand_id, run_id, 'low trust items' AS metric, CAST(low AS DOUBLE) AS current, 0.0 AS target, '3 months' AS timeline FROM m UNION ALL SELECT brand_id, run_id, 'overall trust', round(a, 9), round(least(1.0, a + 0.04), 9), '6 months' FROM m""",
    "g16_context": f"""WITH {CLASS_SQL}, {LONG_SQL}, m AS (SELECT brand_id, run_id, dimension, avg(score) AS average, count(*) FILTER (WHERE score < 0.6) AS low_items, arg_min(content_id, (score, seq)) AS worst FROM long GROUP BY ALL)
SELECT brand_id, run_id, dimension, round(average, 9) AS average, low_items, worst, round(greatest(0.0, 0.6 - average), 9) AS gap, row_number() OVER (PARTITION BY brand_id, run_id ORDER BY round(average, 9), dimension) AS rank FROM m""",
    "g17_targets": f"WITH {CLASS_SQL}, {LONG_SQL}, m AS (SELECT brand_id, run_id, dimension, avg(score) AS a FROM long GROUP BY ALL) SELECT brand_id, run_id, dimension, round(least(1.0, a + CASE WHEN a < 0.55 THEN 0.075 WHEN a < 0.65 THEN 0.06 ELSE 0.024 END), 9) AS target, CASE WHEN a < 0.55 THEN '6 weeks' WHEN a < 0.65 THEN '3 months' ELSE '1 month' END AS timeline FROM m",
    "g24_calibration": f"WITH {TYPED_SQL} SELECT brand_id, run_id, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (WHERE score_{d} >= 0.9) / count(*), 9) AS high_{d}" for d in DIMENSIONS) + f""", round(count(*) FILTER (WHERE {_LIFTED}) / count(*), 9) AS marketing, round(avg(score_coherence), 9) AS coherence, round(avg(score_verification), 9) AS verification,
 round(avg(CASE WHEN {_LIFTED} THEN score_coherence / 1.25 ELSE score_coherence END), 9) AS base_coherence, round(avg(CASE WHEN {_LIFTED} THEN score_verification / 1.3 ELSE score_verification END), 9) AS base_verification FROM typed GROUP BY ALL""",
    "g25_examples": f"""WITH {CLASS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY brand_id, run_id, src ORDER BY seq) AS first FROM cls)
SELECT brand_id, run_id, content_id, row_number() OVER (PARTITION BY brand_id, run_id ORDER BY first > 1, CASE WHEN first = 1 THEN src END, overall DESC, seq) AS rank FROM f QUALIFY rank <= 3""",
    "g26_brand_score": f"""WITH {SIGNAL_SQL}, {_dims_sql('content_id, brand_id')}, {_trust_sql('content_id, brand_id')}, m AS (SELECT brand_id, avg(overall) AS overall, avg(confidence) AS confidence, avg(coverage) AS coverage FROM trust GROUP BY ALL),
x AS (SELECT m.brand_id, string_agg(d.signal_id, ',' ORDER BY d.signal_id) AS missing FROM m, defs AS d WHERE NOT EXISTS (SELECT 1 FROM sig WHERE sig.brand_id = m.brand_id AND sig.signal_id = d.signal_id) GROUP BY ALL)
SELECT brand_id, round(overall, 9) AS overall, round(confidence, 9) AS confidence, round(coverage, 9) AS coverage, coalesce(missing, '') AS missing FROM m LEFT JOIN x USING (brand_id)""",
    "g28_content_mix": f"WITH {TYPED_SQL} SELECT brand_id, run_id, bool_or(content_type IN ('blog', 'article', 'news')) AS has_articles, bool_or(content_type = 'landing_page') AS has_products, bool_or(content_type = 'social_post') AS has_social, count(*) AS n FROM typed GROUP BY ALL",
}
