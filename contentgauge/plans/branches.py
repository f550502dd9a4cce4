"""Every branch of the attribute detectors: content rows with text and metadata by document id, and what they must give by the same ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.operators import detectors as O
from contentgauge.sources.tables import contents


def _case(n: int, *texts: tuple[int, str]):
    """The text of the first remainder of seq by n that fits, else null."""
    out = F.lit(None).cast("string")
    for k, text in texts[::-1]:
        out = F.when(F.col("seq") % n == k, F.lit(text)).otherwise(out)
    return out


def _meta(**columns):
    """A map of the columns that are not null."""
    entries = F.array(*[F.struct(F.lit(k.replace("__", "-")).alias("k"), c.alias("v")) for k, c in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def _or(column, text):
    return F.coalesce(column, F.lit(text))


def e_provenance_branches(spark, sf_dir):
    url = F.concat(_or(_case(14, (1, "https://instagram.com/p/")), "https://site.example/p/"), F.col("seq").cast("string"))
    host = F.substring_index(url, "/", 3)
    n = F.col("seq")
    canonical = F.when(n % 6 == 1, F.concat(url, F.lit("/"))).when(n % 6 == 2, F.replace(url, F.lit("https://"), F.lit("https://www."))).when(n % 6 == 3, F.concat(host, F.lit("/other"))).when(n % 6 == 4, F.lit("https://elsewhere.example/p"))
    phrase = _or(_case(6, (1, "Written by a human."), (2, "Generated by AI."), (4, "As an AI language model I write.")), "Plain.")
    body = F.when(n % 11 == 7, F.concat(F.lit("About us. "), phrase, F.repeat(F.lit(" words"), 60))).when(n % 11 == 8, phrase).otherwise(F.concat(phrase, F.repeat(F.lit(" words"), 60)))
    meta = _meta(
        author=_case(11, (1, "Jo")), has_c2pa_manifest=_case(5, (0, "true")), ai__generated=_case(7, (0, "true")), c2pa_manifest=_case(5, (0, "m")), c2pa_valid=_case(10, (0, "false")),
        schema_org=F.coalesce(_case(22, (20, '{"author": "", "creator": {"@type": "Organization"}}'), (9, '{"author": {"@type": "Robot"}, "creator": {"@type": "Person"}}')), _case(11, (2, '{"json_ld": [[1, {"@graph": [{"@type": "Page"}, {"author": [{"@type": "Person", "name": "Jo"}]}]}]]}'), (3, '[{"author": "Anonymous", "publisher": "P"}]'))), team=_case(11, (4, "Core")), about_url=_case(11, (5, "/about")), has_global_author_info=_case(11, (6, "true")),
        whois_age_years=_case(9, (1, "12"), (2, "6.5"), (3, "2"), (4, "1"), (5, "0.5"), (6, "0.2"), (7, "x"), (8, "10")), whois_private=_case(4, (2, "true")), whois_org=_case(4, (3, "Org")),
        has_significant_visuals=_case(2, (0, "true")), canonical_url=canonical, fingerprint=_case(7, (3, "f")), exif_data=_case(8, (0, "e"), (1, "e"), (2, "e"), (3, "e")), exif_status=_case(8, (1, "stripped"), (2, "changed")),
        ssl_valid=_case(12, (1, "false"), (8, "true")), privacy=_case(12, (2, ""), (9, "/privacy")), has_privacy_policy=_case(12, (3, "false")), domain_age_days=_case(12, (4, "20"), (10, "400"), (11, "100")),
        malware_detected=_case(12, (5, "true")), spam_score=_case(17, (1, "7.5"), (2, "7"), (3, "none")), domain=_case(12, (6, "city.gov"), (7, "nytimes.com")), badge_verified=_case(14, (0, "true")),
    )
    c = contents(spark, sf_dir).withColumns(
        {"url": url, "author": _case(11, (0, "Ann Lee"), (1, "admin")), "src": _or(_case(13, (0, "reddit"), (1, "amazon"), (2, "youtube")), "web"), "meta": meta, "body": body, "title": F.lit("T"), "footer_text": _or(_case(6, (3, "Human-led newsroom")), ""), "main_text": _case(10, (3, "Plain."), (7, ""))}
    )
    return O.detect_attributes(c, ["content_id"], dimensions=("provenance",))


def e_coherence_branches(spark, sf_dir):
    n = F.col("seq")
    links = F.repeat(F.lit("http://a.example/x "), F.when(n % 4 == 0, F.when(n % 8 == 4, 2).otherwise(0)).when(n % 4 == 1, 3).when(n % 4 == 2, 25).otherwise(12).cast("int"))
    body = F.concat(F.lit("Plain words "), _or(_case(3, (0, " lol ")), ""), _or(_case(9, (0, "always this, never that ")), ""), links)
    meta = _meta(broken_links=_case(4, (0, "1"), (1, "0"), (2, "1"), (3, "1")), landing_page_match=_case(12, (1, "false")))
    c = contents(spark, sf_dir).withColumns(
        {"body": body, "title": F.lit("T"), "meta": meta, "channel": _or(_case(6, (0, "reddit"), (1, "email")), "web"), "platform_type": _case(5, (0, "owned")), "source_type": F.lit("brand_owned"), "url": _or(_case(7, (1, "https://jobs.example.com/1")), "https://x.example/1")}
    )
    return O.detect_attributes(c, ["content_id"], dimensions=("coherence",))


def e_transparency_branches(spark, sf_dir):
    said = [_case(5, (2, "cookie policy")), _case(4, (1, "machine learning")), _case(8, (1, "how this works")), _case(6, (1, "ai-assisted")), _case(3, (1, "50% of them")), _case(9, (1, "[1]")), _case(10, (2, "write to a@b.co"), (3, "contact us"))]
    meta = _meta(
        privacy_url=_case(5, (3, "/p")), uses_ai=_case(4, (2, "true")), ai_generated=_case(6, (2, "true")), has_global_ai_disclosure=_case(6, (3, "true")), has_captions=_case(14, (0, "true")), email=_case(10, (1, "a@b.co")),
    )
    c = contents(spark, sf_dir).withColumns(
        {"body": F.concat_ws(" ", F.lit("Plain words"), *said), "title": F.lit("T"), "meta": meta, "src": _or(_case(7, (0, "youtube")), "web"), "platform_type": _case(5, (4, "owned")), "url": _or(_case(5, (1, "https://x.example/privacy"), (4, "https://x.example/about")), "https://x.example/1")}
    )
    return O.detect_attributes(c, ["content_id"], dimensions=("transparency",))


def e_verification_branches(spark, sf_dir):
    said = [_case(5, (1, "buy now")), _case(10, (1, "sponsored")), _case(3, (1, "see the reviews")), _case(6, (1, "4.5 out of 5")), _case(4, (2, "a study found so")), _case(8, (2, "cited by others"))]
    meta = _meta(influencer_verified=_case(6, (0, "true")), verified_purchase=_case(14, (0, "true")), safety_guardrails=_case(10, (0, "false")))
    c = contents(spark, sf_dir).withColumns(
        {"body": F.concat_ws(" ", F.lit("Plain words"), *said), "title": F.lit("T"), "meta": meta, "src": _or(_case(7, (0, "amazon")), "web"), "modality": _or(_case(5, (0, "agent")), "text"), "channel": F.lit("web"), "url": _or(_case(4, (0, "https://x.example/blog/1")), "https://x.example/1")}
    )
    return O.detect_attributes(c, ["content_id"], dimensions=("verification",))


def e_discovery_branches(spark, sf_dir):
    n = F.col("seq")
    meta = _meta(
        json_ld=_case(3, (0, "[]")), schema_valid=_case(6, (0, "false")), published_at=_case(2, (0, "2020-01-01")), tags=_case(4, (1, "t")), og_title=_case(5, (0, "o")), robots=_case(7, (0, "NOINDEX"), (1, "nofollow")),
        in_sitemap=_case(4, (0, "true")), has_sitemap=_case(9, (0, "true")), robots_txt_allowed=_case(8, (3, "false")), canonical=_case(6, (1, "https://x.example/1/"), (2, "https://x.example/2")), robots_txt=_case(10, (1, "User-agent: GPTBot")),
        copyright=_case(10, (2, "c")),
    )
    c = contents(spark, sf_dir).withColumns({"body": F.when(n % 3 == 1, "short").otherwise(F.repeat(F.lit("words "), 30)), "title": F.when(n % 5 == 4, " ").otherwise("T"), "author": _case(7, (3, "Ann")), "meta": meta, "url": F.lit("https://x.example/1")})
    return O.detect_attributes(c, ["content_id"], dimensions=("discovery",))


QUERIES = {f.__name__: f for f in (e_provenance_branches, e_coherence_branches, e_transparency_branches, e_verification_branches, e_discovery_branches)}


def _sql(dimension: str | None, *rows: tuple[str, ...]) -> str:
    """attribute, value, confidence and, if not always present, status; or with the dimension behind them."""
    one = "SELECT 'doc_' || n AS content_id, '{0}' AS attribute_id, '{4}' AS dimension, CAST({1} AS DOUBLE) AS value, CAST({2} AS DOUBLE) AS confidence, {3} AS status FROM d"
    filled = [(*r, *["'present'"] * (4 - len(r)), dimension)[:5] if dimension else (r[0], r[1], r[2], "'present'", r[3]) for r in rows]
    return "WITH d AS (SELECT doc_id AS n, doc_id % 400 AS votes, (doc_id % 50) / 10.0 AS rating, doc_id % 23 AS helpful FROM documents) SELECT * FROM (" + " UNION ALL ".join(one.format(*r) for r in filled) + ") WHERE value IS NOT NULL"


# of the structured authors only the list with a Person has a kind; main text, where there is some, stands for the body
_SAID = "(CASE WHEN n % 11 = 2 OR n % 11 = 9 AND n % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN n % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN n % 11 = 1 THEN 2 ELSE 0 END + CASE WHEN n % 7 = 0 THEN 5 ELSE 0 END + CASE WHEN n % 6 IN (1, 2) AND n % 10 <> 3 THEN 3 WHEN n % 6 = 3 THEN 4 ELSE 0 END)"
_FLAGGED = "(n % 12 IN (1, 2, 3, 4, 5) OR n % 17 = 1)"
_CITED = "CASE WHEN n % 3 = 1 THEN CASE WHEN n % 9 = 1 THEN 10 ELSE 2 END END"
_STUDY = "CASE WHEN n % 4 = 2 THEN CASE WHEN n % 8 = 2 THEN 10 ELSE 2 END END"
_NOINDEX, _ALLOWED, _MAPPED = "n % 7 = 0", "n % 8 <> 3", "(n % 4 = 0 OR n % 9 = 0)"
ORACLES = {
    "e_provenance_branches": _sql(
        "provenance",
        ("ai_vs_human_labeling_clarity", f"CASE WHEN {_SAID} >= 4 THEN least(10, greatest(5, {_SAID})) WHEN n % 6 = 4 AND n % 10 <> 3 THEN 1 END", f"CASE WHEN {_SAID} >= 4 THEN least(1.0, {_SAID} / 10 + 0.2) ELSE 0.9 END", f"CASE WHEN {_SAID} >= 4 THEN 'present' ELSE 'absent' END"),
        ("author_brand_identity_verified", "[10, 7, 8, 7, 6, 6, 8, 5, 1, 1, 1][n % 11 + 1]", "[0.9, 0.9, 0.95, 0.9, 0.85, 0.8, 0.85, 0.5, 0.5, 0.8, 0.8][n % 11 + 1]", "CASE WHEN n % 11 = 7 THEN 'partial' WHEN n % 11 = 8 THEN 'unknown' WHEN n % 11 > 8 THEN 'absent' ELSE 'present' END"),
        ("domain_age", "CASE WHEN n % 13 > 2 THEN [NULL, 10, 8, 6, 4, 3, 2, NULL, 10][n % 9 + 1] END", "0.9"),
        ("whois_privacy", "CASE WHEN n % 13 > 2 THEN CASE n % 4 WHEN 2 THEN 4 WHEN 3 THEN 8 END END", "CASE WHEN n % 4 = 2 THEN 0.85 ELSE 0.9 END"),
        ("c2pa_cai_manifest_present", "CASE WHEN n % 10 = 0 THEN 5 WHEN n % 5 = 0 THEN 10 WHEN n % 3 > 0 OR n % 2 = 0 THEN 1 END", "1"),
        ("canonical_url_matches_declared_source", "[NULL, 10, 10, 5, 1, NULL][n % 6 + 1]", "1", "CASE WHEN n % 6 = 4 THEN 'absent' ELSE 'present' END"),
        ("digital_watermark_fingerprint_detected", "CASE WHEN n % 7 = 3 THEN 10 END", "1"), ("exif_metadata_integrity", "[10, 5, 1, 10, NULL, NULL, NULL, NULL][n % 8 + 1]", "1"),
        ("source_domain_trust_baseline", f"CASE WHEN {_FLAGGED} THEN 2 WHEN n % 13 = 1 THEN 8 WHEN n % 13 < 3 THEN 7 WHEN n % 12 IN (6, 7) THEN 9 WHEN n % 12 IN (8, 9, 10) THEN 6 WHEN n % 12 = 11 THEN 5.5 ELSE 5 END", f"CASE WHEN {_FLAGGED} THEN 0.9 WHEN n % 13 < 3 OR n % 12 IN (6, 7) THEN 0.8 ELSE 0.7 END"),
        ("verified_platform_account", "CASE n % 14 WHEN 0 THEN 10 WHEN 1 THEN 3 END", "CASE n % 14 WHEN 0 THEN 1 ELSE 0.7 END"),
    ),
    "e_coherence_branches": _sql(
        "coherence",
        ("brand_voice_consistency_score", "CASE WHEN n % 3 = 0 THEN 4 ELSE 10 END", "CASE WHEN n % 3 = 0 THEN 0.7 ELSE 0.6 END"), ("broken_link_rate", "CASE WHEN n % 8 = 4 THEN 1 ELSE [NULL, 10, 7, 4][n % 4 + 1] END", "0.8"),
        ("engagement_to_trust_correlation", "CASE WHEN n % 6 = 0 OR n % 5 <> 0 AND n % 7 <> 1 THEN CASE WHEN votes > 50 AND rating > 4 THEN 10 WHEN votes > 10 AND rating > 3 THEN 7 WHEN votes > 5 OR rating > 2 THEN 6 WHEN rating > 0 THEN 3 END END", "0.6"),
        ("claim_consistency_across_pages", "CASE WHEN n % 9 = 0 THEN 3 END", "0.6"), ("email_asset_consistency_check", "CASE WHEN n % 12 = 1 THEN 2 END", "0.9"),
    ),
    "e_transparency_branches": _sql(
        "transparency",
        ("privacy_policy_link_availability_clarity", "[NULL, 10, 10, 10, 2][n % 5 + 1]", "[0, 0.95, 0.9, 0.9, 0.7][n % 5 + 1]"),
        ("ai_explainability_disclosure", "CASE WHEN n % 8 = 1 THEN 10 WHEN n % 4 IN (1, 2) THEN 2 END", "CASE WHEN n % 8 = 1 THEN 0.9 ELSE 0.8 END"),
        ("ai_generated_assisted_disclosure_present", "CASE n % 6 WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 8 ELSE 1 END", "CASE WHEN n % 6 = 3 THEN 0.9 ELSE 1 END"),
        ("caption_subtitle_availability_accuracy", "CASE WHEN n % 14 = 0 THEN 10 WHEN n % 7 = 0 THEN 1 END", "1"), ("data_source_citations_for_claims", _CITED, "CASE WHEN n % 9 = 1 THEN 0.85 ELSE 0.8 END"),
        ("contact_info_availability", "CASE WHEN n % 10 IN (1, 2, 3) THEN 10 ELSE 2 END", "CASE WHEN n % 10 IN (1, 2, 3) THEN 0.9 ELSE 0.7 END"),
    ),
    "e_verification_branches": _sql(
        "verification",
        ("claim_to_source_traceability", _STUDY, "CASE WHEN n % 8 = 2 THEN 0.85 ELSE 0.8 END"), ("ad_sponsored_label_consistency", "CASE WHEN n % 10 = 6 THEN 1 END", "0.8"),
        ("engagement_authenticity_ratio", "CASE WHEN n % 4 = 0 THEN CASE WHEN votes > 100 OR helpful > 10 THEN 9 WHEN votes > 10 THEN 7 ELSE 5 END END", "0.6"), ("influencer_partner_identity_verified", "CASE WHEN n % 6 = 0 THEN 10 END", "1"),
        ("review_authenticity_confidence", "CASE WHEN n % 7 = 0 THEN CASE WHEN n % 14 > 0 THEN 5 WHEN helpful > 5 THEN 10 ELSE 8 END WHEN n % 6 = 1 THEN 8 WHEN n % 3 = 1 THEN 6 END", "CASE WHEN n % 7 = 0 THEN 0.7 WHEN n % 6 = 1 THEN 0.6 ELSE 0.5 END"),
        ("verified_purchaser_review_rate", "CASE WHEN n % 14 = 0 THEN 10 WHEN n % 7 = 0 THEN 3 END", "1"), ("agent_safety_guardrail_presence", "CASE WHEN n % 10 = 0 THEN 1 END", "1"),
    ),
    "e_discovery_branches": _sql(
        None,
        ("schema_compliance", "CASE WHEN n % 6 = 0 THEN 7 WHEN n % 3 = 0 THEN 10 ELSE 1 END", "0.9", "coherence"),
        ("metadata_completeness", "1 + ((n % 5 < 4)::INT + (n % 3 <> 1)::INT + (n % 7 = 3)::INT + (n % 2 = 0)::INT + (n % 4 = 1)::INT + (n % 5 = 0)::INT) / 5 * 9.0", "0.9", "provenance"),
        ("llm_retrievability", f"CASE WHEN {_NOINDEX} THEN 1 WHEN n % 7 = 1 THEN 5 WHEN n % 4 = 0 THEN 10 ELSE 8 END", "0.9", "resonance"), ("canonical_linking", "CASE n % 6 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 1 END", "0.9", "provenance"),
        ("indexing_visibility", f"CASE WHEN {_NOINDEX} THEN 1 WHEN {_ALLOWED} AND {_MAPPED} THEN 10 WHEN {_ALLOWED} THEN 7 ELSE 3 END", "0.9", "resonance"),
        ("ethical_training_signals", "CASE n % 10 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 1 END", "0.9", "transparency"),
    ),
}
