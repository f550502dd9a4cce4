"""Queries of the run-level operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import config as C
from contentgauge.operators import assembly
from contentgauge.operators import runs as O
from contentgauge.operators import scoring as S
from contentgauge.plans.normalization import SKIP_SQL
from contentgauge.plans.reports import _TYPE, MULTIPLIERS, f24_visual_signals
from contentgauge.plans.review import CLAIM_SQL, MERGED_SQL, merged_issues, told_claims
from contentgauge.plans.scores import _BAND, CLASS_SQL, DEFS_SQL, RUN, SIGNAL_SQL, _dims_sql, _signals, _trust_sql, attributes
from contentgauge.sources.tables import CONTENT_SQL, DIMENSIONS, FACTORS, contents, scores, table


def _scored(found):
    shown = lambda path: F.get_json_object("meta", path)
    return found.select(
        "content_id", *[F.round(d, 9).alias(d) for d in DIMENSIONS], F.round("overall", 9).alias("overall"), "band", F.json_array_length(shown("$.detected_attributes")).alias("n_attributes"),
        shown("$.detected_attributes[0].attribute_id").alias("first_attribute"), shown("$.dimensions.coherence").cast("double").alias("meta_coherence"),
    )


def f13_score_content(spark, sf_dir):
    return _scored(O.score_content(contents(spark, sf_dir), attributes(spark, sf_dir), C.attribute_map(spark), C.signal_defs(spark)))


def f13_with_issues(spark, sf_dir):
    """The same from attributes with issues merged."""
    found = merged_issues(spark, sf_dir).withColumn("status", F.lit("present"))
    return _scored(O.score_content(contents(spark, sf_dir), found, C.attribute_map(spark), C.signal_defs(spark)))


def _assembled(spark, sf_dir):
    """Documents with the url of the page of their id, told claims, badges, attributes, visual signals and raw scores from their ids; some parts are missing for some."""
    n = F.col("seq")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")
    c = assembly.scorable(contents(spark, sf_dir)).join(pages.hint("shuffle_hash"), "seq", "left").withColumns({
        "author": F.when(n % 3 == 0, "Ann"), "published": F.when(n % 6 > 0, F.timestamp_seconds(F.lit(1_700_000_000) - (n % 500) * 86_400)), "has_guidelines": n % 2 == 0, "rating": F.when(n % 8 > 0, F.col("rating")), "upvotes": F.when(n % 8 > 0, F.col("upvotes")),
        "helpful_count": F.when(n % 8 > 0, F.col("helpful_count")), "src": F.when(n % 5 == 0, "amazon").when(n % 5 == 1, "reddit").otherwise(F.col("src")),
    })
    raw = scores(spark, sf_dir).filter(n % 11 > 0).select("content_id", *[F.col(f"score_{d}").alias(d) for d in DIMENSIONS])
    badges = contents(spark, sf_dir).filter(n % 6 == 0).select("content_id")
    factors = spark.createDataFrame(MULTIPLIERS, "dimension string, content_type string, multiplier double")
    as_of = F.timestamp_seconds(F.lit(1_700_000_000))
    return assembly.score_rows(c, raw, told_claims(spark, sf_dir), badges, attributes(spark, sf_dir).filter("content_id not like '%7'"), f24_visual_signals(spark, sf_dir), C.attribute_map(spark), C.signal_defs(spark), factors, as_of)


#: What f13_score_rows shows of a payload, which is parsed once.
PAYLOAD = """score_debug struct<verification: struct<multiplier: double>, coherence: struct<adjusted_score: double>>, adjusted struct<resonance: double, verification: double>,
claim_issues array<struct<suggestion: string>>, detected_attributes array<struct<attribute_id: string>>, dimensions struct<coherence: struct<level: string>>"""


def f13_score_rows(spark, sf_dir):
    """Score rows with all their parts; of the payload, what each part has put there."""
    shown = lambda path: F.col(f"_shown.{path}")
    return _assembled(spark, sf_dir).withColumn("_shown", F.from_json("meta", PAYLOAD)).select(
        "content_id", *[F.round(d, 9).alias(d) for d in DIMENSIONS], *[F.round(x, 9).alias(x) for x in ("overall", "confidence", "coverage")], "band", "content_type", "supported", "contradicted", "unverified", "n_attributes",
        shown("score_debug.verification.multiplier").alias("multiplier"), shown("score_debug.coherence.adjusted_score").alias("multiplied_coherence"), shown("adjusted.resonance").alias("moved_resonance"), shown("adjusted.verification").alias("moved_verification"),
        F.size(shown("claim_issues")).alias("n_issues"), F.get(shown("claim_issues"), 0)["suggestion"].alias("first_issue"), F.get(shown("detected_attributes"), 0)["attribute_id"].alias("first_attribute"), shown("dimensions.coherence.level").alias("coherence_level"),
    )


def f23_run_summary(spark, sf_dir):
    dims = S.aggregate_dimensions(_signals(spark, sf_dir), C.signal_defs(spark), RUN)
    found = O.run_summary(dims, S.classify(scores(spark, sf_dir)), RUN)
    return found.select(*RUN, *[F.round(d, 9).alias(d) for d in DIMENSIONS], F.round("overall", 9).alias("overall"))


def f26_visual_scope(spark, sf_dir):
    """Sources in both spellings and cases; content types by channel."""
    source = F.element_at(F.array(F.lit("Brand_Owned"), F.lit("brand-owned"), F.lit("third_party"), F.lit("user_generated"), F.lit(None).cast("string")), (F.col("seq") % 5 + 1).cast("int"))
    kind = F.when(F.col("channel") == "youtube", "LANDING_page").otherwise(F.when(F.col("seq") % 3 > 0, F.col("channel")))
    return O.in_visual_scope(contents(spark, sf_dir).withColumns({"source_type": source, "content_type": kind})).select("content_id", "source_type", "content_type")


#: Suggestions and evidence by doc_id % 14, and whether an issue that needs an explanation lists them.
SUGGESTIONS = [
    ("Tone: too formal. EXACT QUOTE: 'x'", "", True), ("'just a quote'", "", False), ("EXACT QUOTE: 'some text'", "", False), ("Change 'a' -> 'b'", "", True), ("Improve this", "", False), ("", "EXACT QUOTE: 'x'", False),
    ("The client wants to know: Change 'a' -> 'b'", "", False), ("a -> b", "", False), ("EXACT QUOTE: 'x'. Change 'x' -> 'y'", "", True), ("It would be good to say much more than this about the product and: why", "", False),
    ("Voice: what specific thing could make this even better", "", False), ("", "A long explanation without a suggestion", False), ("'Tone': plain words", "", True), ("Clarity: say it", "'x'", True),
]


def f27_suggestions(spark, sf_dir):
    """Each suggestion under an issue that needs an explanation and, of every third document, under one that does not."""
    n = F.col("seq")
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in SUGGESTIONS]), (n % 14 + 1).cast("int"))
    kind = F.when(n % 3 == 0, "missing_privacy_policy").otherwise(F.element_at(F.array(*map(F.lit, ["Improvement", "inconsistent_voice", "tone_shift", "vocabulary", "Opportunity"])), (n % 5 + 1).cast("int")))
    return contents(spark, sf_dir).select("content_id", "title", O.valid_suggestion(kind, pick(0), pick(1)).alias("valid"))


def g6_item_summary(spark, sf_dir):
    scored = S.classify(scores(spark, sf_dir)).select("content_id", "overall").join(contents(spark, sf_dir).hint("shuffle_hash"), "content_id")
    adjusted = contents(spark, sf_dir).filter("seq % 5 = 0").select("content_id", (F.col("seq") % 100).cast("double").alias("adjusted"))
    return O.item_summary(scored, adjusted).select("content_id", F.round("final_score", 9).alias("final_score"), "shown_title")


def g21_blocked(spark, sf_dir):
    return O.blocked_urls(contents(spark, sf_dir), RUN)


def _report(spark, sf_dir):
    """Documents as assets of their runs with two scores each; some have meta, screenshots or rationales of their own, some no score, one run no summary."""
    n = F.col("seq")
    c = contents(spark, sf_dir)
    meta = F.map_filter(F.create_map(F.lit("source_url"), F.when(n % 3 == 0, F.concat(F.lit("http://own/"), n)).otherwise(""), F.lit("access_denied"), F.when(n % 10 == 0, "true"), F.lit("kept"), F.lit("x")), lambda _, v: v.isNotNull())
    assets = c.select(F.col("content_id").alias("asset_id"), "seq", "run_id", F.when(n % 4 > 0, F.concat(F.lit("http://a/"), n)).alias("url"), F.when(n % 5 > 0, F.concat(F.lit("T"), n)).alias("title"), F.when(n % 6 == 0, "shot.png").alias("screenshot_path"), F.when(n % 7 > 0, meta).alias("meta"))
    rationale = F.when(n % 2 == 0, F.concat(F.lit('{"detected_attributes": [{"id": '), n, F.lit('}], "screenshot_path": "r.png"}'))).when(n % 3 == 0, "{broken")
    score = c.filter(n % 8 > 0).select(F.col("content_id").alias("asset_id"), F.explode(F.array(n * 2 + 1, n * 2)).alias("score_id"), "seq", rationale.alias("rationale")).withColumn("overall", F.when(n % 9 > 0, (F.col("score_id") % 100) / 100.0)).drop("seq")
    runs = c.groupBy("run_id").agg(F.count("*").alias("assets"))
    summary = c.filter("run_id <> 'run_3'").groupBy("run_id").agg(F.avg("rating").alias("avg_provenance"), F.avg(F.when(F.col("run_id") == "run_1", F.col("rating"))).alias("avg_coherence"))
    return O.report_data(runs, assets, score, summary)


def g22_report_data(spark, sf_dir):
    m = F.col("meta")
    return _report(spark, sf_dir).select(
        "asset_id", "run_id", "assets", "score_id", F.round("final_score", 9).alias("final_score"), "screenshot_path", m["source_url"].alias("source_url"), m["title"].alias("title"), m["kept"].alias("kept"),
        m["detected_attributes"].alias("detected"), F.round("avg_provenance", 9).alias("avg_provenance"), F.round("avg_coherence", 9).alias("avg_coherence"),
    )


def g21_denied(spark, sf_dir):
    return O.denied_pages(_report(spark, sf_dir))


QUERIES = {f.__name__: f for f in (f13_score_content, f13_with_issues, f13_score_rows, f23_run_summary, f26_visual_scope, f27_suggestions, g6_item_summary, g21_blocked, g21_denied, g22_report_data)}

_pivot = lambda src: ", ".join(f"max(value / 10) FILTER (WHERE dimension = '{d}') AS {d}" for d in DIMENSIONS)
_rounded = ", ".join(f"round({d}, 9) AS {d}" for d in DIMENSIONS)


def _scored_sql(source: str) -> str:
    return f"""{_dims_sql('content_id')}, {_trust_sql('content_id')}, w AS (SELECT content_id, {_pivot('dims')} FROM dims GROUP BY content_id),
na AS (SELECT content_id, count(*) AS n_attributes, min(attribute_id) AS first_attribute FROM {source} GROUP BY content_id)
SELECT content_id, {_rounded}, round(overall, 9) AS overall, {_BAND('round(overall, 9)')} AS band, n_attributes, first_attribute, round(coherence, 9) AS meta_coherence
FROM content JOIN w USING (content_id) JOIN trust USING (content_id) JOIN na USING (content_id) WHERE {SKIP_SQL} IS NULL"""


# engagement of an item, and what moves a dimension's score, by the definitions
_ENGAGED = "least(1.0, greatest(0.0, 0.5 + CASE WHEN seq % 8 = 0 THEN 0 WHEN seq % 5 = 0 THEN (rating - 3) * 0.1 WHEN seq % 5 = 1 THEN (rating - 0.5) * 0.2 ELSE 0 END + CASE WHEN seq % 8 = 0 THEN 0 ELSE log10(greatest(1.0, upvotes)) / 3 * 0.1 + least(helpful_count / 20, 1.0) * 0.1 END))"
_moved = lambda d: f"CASE WHEN mv.{d} IS NULL THEN b.{d} ELSE least(100.0, greatest(0.0, 70 * b.{d} + 0.3 * least(100.0, greatest(0.0, b.{d} * 100 + mv.{d})))) / 100 END"
_raw = lambda d: f"CASE WHEN seq % 11 > 0 THEN score_{d} ELSE 0.5 END"
_move = lambda d: f"sum((value - 5.5) * 9 * confidence) FILTER (WHERE dimension = '{d}') / sum(confidence) FILTER (WHERE dimension = '{d}') AS {d}"
_AGED = "CASE WHEN seq % 6 = 0 THEN 0.5 WHEN seq % 500 < 30 THEN 1.0 WHEN seq % 500 < 90 THEN 0.9 WHEN seq % 500 < 180 THEN 0.8 WHEN seq % 500 < 365 THEN 0.6 ELSE 0.4 END"
_BASE_ROWS = [
    ("prov_source_clarity", "provenance", 0.2, "b.provenance", "CASE WHEN size < 200 THEN 0.6 ELSE 1.0 END"), ("prov_date_freshness", "provenance", 0.2, _AGED, "1.0"),
    ("ver_fact_accuracy", "verification", 0.4, "b.verification", "CASE WHEN n_claims < 3 THEN 0.7 ELSE 1.0 END"), ("trans_disclosures", "transparency", 0.4, "b.transparency", "CASE WHEN size < 300 THEN 0.7 ELSE 1.0 END"),
    ("coh_voice_consistency", "coherence", 0.4, "b.coherence", "CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.6 END"), ("res_cultural_fit", "resonance", 0.4, "b.resonance", "CASE WHEN seq % 8 = 0 THEN 0.5 ELSE 1.0 END"),
]
_COUNTED = "count(*) FILTER (WHERE status = 'supported') + CAST(max(CASE WHEN seq % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS supported, count(*) FILTER (WHERE status = 'CONTRADICTED') AS contradicted, count(*) FILTER (WHERE status NOT IN ('supported', 'CONTRADICTED')) AS unverified"
ROWS_SQL = f"""{SIGNAL_SQL}, {CLAIM_SQL}, sc AS (SELECT content_id, {', '.join(f'(seq * {FACTORS[d]} % 101) / 100.0 AS score_{d}' for d in DIMENSIONS)} FROM content),
nc AS (SELECT content_id, {_COUNTED} FROM clm GROUP BY content_id),
it AS (SELECT c.*, {_TYPE} AS content_type FROM content AS c LEFT JOIN (SELECT page_id, url FROM pages) ON page_id = seq WHERE {SKIP_SQL} IS NULL),
b0 AS (SELECT it.content_id, it.seq, length(body) AS size, content_type, supported, contradicted, unverified, supported + contradicted + unverified AS n_claims, least(1.0, greatest(0.0, 0.5 + 0.1 * supported - 0.2 * contradicted - 0.05 * unverified)) AS claim,
 CASE content_type WHEN 'other' THEN 1.3 ELSE 1.0 END AS multiplier, {_raw('provenance')} AS provenance, {_raw('transparency')} AS transparency, least(1.0, {_raw('coherence')} * CASE content_type WHEN 'landing_page' THEN 1.2 ELSE 1.1 END) AS coherence,
 least(1.0, greatest(0.0, 0.7 * ({_raw('resonance')}) + 0.3 * {_ENGAGED})) AS resonance FROM it JOIN sc USING (content_id) JOIN nc USING (content_id)),
b AS (SELECT *, CASE WHEN multiplier = 1 THEN claim ELSE least(1.0, claim * multiplier) END AS verification FROM b0),
sg AS ({' UNION ALL '.join(f"SELECT content_id, '{k}' AS signal_id, '{d}' AS dimension, {w} AS weight, {v} AS value, {c} AS confidence, 'present' AS status FROM b" for k, d, w, v, c in _BASE_ROWS)}
 UNION ALL SELECT content_id, signal_id, dimension, weight, value, confidence, status FROM sig JOIN it USING (content_id) WHERE content_id NOT LIKE '%7' AND NOT (it.seq % 2 = 0 AND signal_id = 'coh_voice_consistency')
 UNION ALL SELECT content_id, 'vis_design_quality', 'coherence', 0.15, (seq % 101) / 100.0, 0.7, 'present' FROM it WHERE seq % 7 <> 0 AND seq % 5 <> 0 UNION ALL SELECT content_id, 'vis_clutter_score', 'coherence', 0.10, 0.5, 0.5, 'present' FROM it WHERE seq % 7 <> 0 AND seq % 5 <> 0),
mv AS (SELECT content_id, {', '.join(map(_move, DIMENSIONS))} FROM attrs WHERE content_id NOT LIKE '%7' AND NOT (evidence LIKE 'LLM:%' AND value < 5.5) GROUP BY content_id),
na AS (SELECT content_id, count(*) AS n_attributes, min(attribute_id) AS first_attribute FROM attrs WHERE content_id NOT LIKE '%7' GROUP BY content_id),
ni AS (SELECT content_id, count(*) AS n_issues, arg_min(suggestion, claim_no) AS first_issue FROM cis GROUP BY content_id),
{_dims_sql('content_id', 'sg')}, {_trust_sql('content_id')}, w AS (SELECT content_id, {_pivot('dims')}, max(level) FILTER (WHERE dimension = 'coherence') AS coherence_level FROM dims GROUP BY content_id)"""

ORACLES = {
    "f13_score_rows": f"""WITH {ROWS_SQL} SELECT b.content_id, {', '.join(f'round(w.{d}, 9) AS {d}' for d in DIMENSIONS)}, round(overall, 9) AS overall, round(trust.confidence, 9) AS confidence, round(coverage, 9) AS coverage, {_BAND('round(overall, 9)')} AS band, content_type, supported, contradicted, unverified,
 coalesce(n_attributes, 0) AS n_attributes, multiplier, round(b.coherence, 9) AS multiplied_coherence, round({_moved('resonance')}, 9) AS moved_resonance, round({_moved('verification')}, 9) AS moved_verification, coalesce(n_issues, 0) AS n_issues, first_issue, first_attribute, coherence_level
 FROM b JOIN w USING (content_id) JOIN trust USING (content_id) LEFT JOIN mv USING (content_id) LEFT JOIN na USING (content_id) LEFT JOIN ni USING (content_id)""",
    "f13_score_content": f"WITH {SIGNAL_SQL}, {_scored_sql('attrs')}",
    "f13_with_issues": f"WITH {MERGED_SQL}, {DEFS_SQL}, sig AS (SELECT content_id, signal_id, d.dimension, d.weight, least(1.0, greatest(0.0, value / 10)) AS value, confidence, 'present' AS status FROM merged JOIN amap USING (attribute_id) JOIN defs AS d USING (signal_id)), {_scored_sql('merged')}",
    "f23_run_summary": f"WITH {SIGNAL_SQL}, {_dims_sql('brand_id, run_id')}, {_trust_sql('brand_id, run_id')}, w AS (SELECT brand_id, run_id, {_pivot('dims')} FROM dims GROUP BY brand_id, run_id) SELECT brand_id, run_id, {_rounded}, round(overall / 100, 9) AS overall FROM w JOIN trust USING (brand_id, run_id)",
    "f26_visual_scope": f"WITH {CONTENT_SQL}, c AS (SELECT content_id, ['Brand_Owned', 'brand-owned', 'third_party', 'user_generated', NULL][seq % 5 + 1] AS source_type, CASE WHEN channel = 'youtube' THEN 'LANDING_page' WHEN seq % 3 > 0 THEN channel END AS content_type, seq FROM content) SELECT content_id, source_type, content_type FROM c WHERE seq % 5 < 2 OR content_type = 'LANDING_page'",
    "f27_suggestions": f"WITH {CONTENT_SQL} SELECT content_id, title, seq % 3 = 0 OR seq % 14 IN (0, 3, 8, 12, 13) AS valid FROM content",
    "g6_item_summary": f"WITH {CLASS_SQL} SELECT content_id, round(CASE WHEN cls.seq % 5 = 0 THEN cls.seq % 100 ELSE overall * 100 END, 9) AS final_score, CASE WHEN trim(title) <> '' THEN title ELSE substr(body, 1, 60) || '...' END AS shown_title FROM cls JOIN content USING (content_id)",
    "g21_blocked": f"WITH {CONTENT_SQL}, s AS (SELECT *, {SKIP_SQL} AS skip_reason FROM content) SELECT brand_id, run_id, skip_reason, count(*) AS n, min(content_id) AS first FROM s WHERE skip_reason IN ('error_page', 'login_wall') GROUP BY ALL",
    "g22_report_data": f"""WITH {CONTENT_SQL}, v AS (SELECT run_id, avg(rating) AS p, coalesce(avg(rating) FILTER (WHERE run_id = 'run_1'), 0.0) AS c FROM content WHERE run_id <> 'run_3' GROUP BY ALL), r AS (SELECT run_id, count(*) AS assets FROM content GROUP BY ALL)
SELECT content_id AS asset_id, run_id, assets, CASE WHEN seq % 8 > 0 THEN seq * 2 END AS score_id, round(CASE WHEN seq % 8 > 0 THEN CASE WHEN seq % 9 > 0 THEN (seq * 2 % 100) / 100.0 ELSE 0.0 END * 100 END, 9) AS final_score,
 CASE WHEN seq % 6 = 0 THEN 'shot.png' WHEN seq % 8 > 0 AND seq % 2 = 0 THEN 'r.png' END AS screenshot_path, CASE WHEN seq % 7 > 0 AND seq % 3 = 0 THEN 'http://own/' || seq WHEN seq % 4 > 0 THEN 'http://a/' || seq END AS source_url, CASE WHEN seq % 5 > 0 THEN 'T' || seq END AS title,
 CASE WHEN seq % 7 > 0 THEN 'x' END AS kept, CASE WHEN seq % 8 > 0 AND seq % 2 = 0 THEN '[{{"id":' || seq || '}}]' END AS detected, round(p, 9) AS avg_provenance, round(c, 9) AS avg_coherence FROM content JOIN r USING (run_id) LEFT JOIN v USING (run_id)""",
    "g21_denied": f"""WITH {CONTENT_SQL} SELECT run_id, content_id AS asset_id, CASE WHEN seq % 3 = 0 THEN 'http://own/' || seq WHEN seq % 4 > 0 THEN 'http://a/' || seq ELSE 'Unknown URL' END AS url, CASE WHEN seq % 5 > 0 THEN 'T' || seq ELSE 'Access Denied' END AS title,
 'Anti-bot protection (Access Denied)' AS reason FROM content WHERE seq % 10 = 0 AND seq % 7 > 0""",
}
