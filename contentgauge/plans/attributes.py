"""Queries of the attribute detectors over documents, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import detect as D
from contentgauge.operators import detectors as O
from contentgauge.sources.tables import CONTENT_SQL, contents

_RULES = ("coherence", "transparency", "verification")


def e_attributes(spark, sf_dir):
    """Coherence, transparency and verification attributes of every document."""
    return O.detect_attributes(contents(spark, sf_dir), ["content_id"], dimensions=_RULES)


def e_provenance(spark, sf_dir):
    return O.detect_attributes(contents(spark, sf_dir), ["content_id"], dimensions=("provenance",))


def e12_readability(spark, sf_dir):
    return O.detect_attributes(contents(spark, sf_dir), ["content_id"], dimensions=("resonance",))


def e_discovery(spark, sf_dir):
    """Markup and indexing attributes, with robots and sitemap entries by id."""
    n = F.col("seq")
    meta = F.create_map(F.lit("robots"), F.when(n % 3 == 0, "noindex").when(n % 3 == 1, "nofollow").otherwise(""), F.lit("in_sitemap"), F.when(n % 2 == 0, "true").otherwise(""), F.lit("rights"), F.when(n % 5 == 0, "r").otherwise(""))
    return O.detect_attributes(contents(spark, sf_dir).withColumn("meta", meta), ["content_id"], dimensions=("discovery",))


QUERIES = {f.__name__: f for f in (e_attributes, e_provenance, e12_readability, e_discovery)}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_any = lambda x, parts: "(" + " OR ".join(f"contains({x}, {_q(p)})" for p in parts) + ")"
_re = lambda x, ps: f"regexp_matches({x}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in ps))})".replace(r"\w", r"[\p{L}\p{N}_]").replace(r"[[\p{L}\p{N}_]\s]", r"[\p{L}\p{N}_\s]")
_row = lambda a, d, v, c: f"SELECT content_id, '{a}' AS attribute_id, '{d}' AS dimension, CAST({v} AS DOUBLE) AS value, CAST({c} AS DOUBLE) AS confidence, 'present' AS status FROM t"
_CLAIM, _CITED = _re("body", D.CLAIMS), _re("body", D.CITATIONS)
_CITE = f"CASE WHEN {_CLAIM} THEN CASE WHEN {_CITED} THEN 10 ELSE 2 END END"
_CITE_C = f"CASE WHEN {_CITED} THEN 0.85 ELSE 0.8 END"
_SLANG = _any("low", [f" {w} " for w in D.SLANG])
_CLASH = " OR ".join(f"(instr(b, {_q(x)}) > 0 AND instr(b, {_q(y)}) > 0 AND abs(instr(b, {_q(x)}) - instr(b, {_q(y)})) < 100)" for x, y in D.CONTRADICTIONS)
_CONTACT = rf"(regexp_matches(low, '[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+\.[\p{{L}}\p{{N}}_]+') OR {_any('low', D.CONTACT)})"
_STARS = r"regexp_matches(low, '[0-9](\.[0-9])?\s*(out of|/)\s*5')"
_REVIEWS = "contains(low, 'reviews')"
_LINKS = "len(regexp_extract_all(low, 'https?://[!$-_a-z]+'))"
_T = f"WITH {CONTENT_SQL}, t AS (SELECT *, lower(body) AS b, lower(body || ' ' || title) AS low FROM content), r AS ("
_ROWS = [
    _row("brand_voice_consistency_score", "coherence", f"CASE WHEN {_SLANG} THEN 4 ELSE 10 END", f"CASE WHEN {_SLANG} THEN 0.7 ELSE 0.6 END"),
    _row("broken_link_rate", "coherence", f"CASE WHEN {_LINKS} > 0 THEN 10 END", "0.8"),
    _row("engagement_to_trust_correlation", "coherence", "CASE WHEN upvotes > 50 AND rating > 4 THEN 10 WHEN upvotes > 10 AND rating > 3 THEN 7 WHEN upvotes > 5 OR rating > 2 THEN 6 WHEN rating < 2 AND rating > 0 THEN 3 END", "0.6"),
    _row("privacy_policy_link_availability_clarity", "transparency", f"CASE WHEN {_any('low', D.PRIVACY)} THEN 10 END", "0.9"),
    _row("engagement_authenticity_ratio", "verification", "CASE WHEN channel = 'reddit' THEN CASE WHEN upvotes > 100 OR helpful_count > 10 THEN 9 WHEN upvotes > 10 THEN 7 ELSE 5 END END", "0.6"),
    _row("claim_consistency_across_pages", "coherence", f"CASE WHEN {_CLASH} THEN 3 END", "0.6"),
    _row("ai_explainability_disclosure", "transparency", f"CASE WHEN {_any('low', D.AI_FEATURES)} THEN CASE WHEN {_any('low', D.EXPLAINED)} THEN 10 ELSE 2 END END", f"CASE WHEN {_any('low', D.EXPLAINED)} THEN 0.9 ELSE 0.8 END"),
    _row("ai_generated_assisted_disclosure_present", "transparency", f"CASE WHEN {_any('low', D.AI_DISCLOSED)} THEN 10 ELSE 1 END", "1.0"),
    _row("data_source_citations_for_claims", "transparency", _CITE, _CITE_C),
    _row("contact_info_availability", "transparency", f"CASE WHEN {_CONTACT} THEN 10 ELSE 2 END", f"CASE WHEN {_CONTACT} THEN 0.9 ELSE 0.7 END"),
    _row("claim_to_source_traceability", "verification", _CITE, _CITE_C),
    _row("ad_sponsored_label_consistency", "verification", f"CASE WHEN {_any('low', D.COMMERCIAL)} AND NOT {_any('low', D.AD_LABELS)} THEN 1 END", "0.8"),
    _row("review_authenticity_confidence", "verification", f"CASE WHEN {_REVIEWS} AND {_STARS} THEN 8 WHEN {_REVIEWS} THEN 6 END", f"CASE WHEN {_STARS} THEN 0.6 ELSE 0.5 END"),
]
_HUMAN = "coalesce(" + ", ".join(f"CASE WHEN contains(b, {_q(p)}) THEN 3 END" for p in D.HUMAN) + ", 0)"
_MADE = "coalesce(" + ", ".join(f"CASE WHEN contains(b, {_q(p)}) THEN 3 END" for p in D.AI_MADE) + ", 0)"
_LABEL = f"""SELECT content_id, 'ai_vs_human_labeling_clarity' AS attribute_id, 'provenance' AS dimension, CAST(CASE WHEN s >= 4 THEN greatest(5, s) ELSE 1 END AS DOUBLE) AS value,
 CAST(CASE WHEN s >= 4 THEN least(1.0, s / 10 + 0.2) ELSE 0.9 END AS DOUBLE) AS confidence, CASE WHEN s >= 4 THEN 'present' ELSE 'absent' END AS status
 FROM (SELECT *, {_HUMAN} + {_MADE} AS s FROM t) WHERE s >= 4 OR {_any('b', D.AI_TRACES)}"""
_AUTHOR = """SELECT content_id, 'author_brand_identity_verified' AS attribute_id, 'provenance' AS dimension, CAST(CASE WHEN contains(substr(b, 1, 500), 'about') THEN 5 ELSE 1 END AS DOUBLE) AS value,
 CAST(CASE WHEN contains(substr(b, 1, 500), 'about') OR length(b) < 200 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence, CASE WHEN contains(substr(b, 1, 500), 'about') THEN 'partial' WHEN length(b) < 200 THEN 'unknown' ELSE 'absent' END AS status FROM t"""
_FILLED = "(CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END + CASE WHEN length(trim(body)) > 100 THEN 1 ELSE 0 END)"
_DISCOVERY = [
    _row("schema_compliance", "coherence", "1", "0.9"), _row("metadata_completeness", "provenance", f"1 + {_FILLED} / 5 * 9.0", "0.9"), _row("canonical_linking", "provenance", "1", "0.9"),
    _row("llm_retrievability", "resonance", "CASE WHEN seq % 3 = 0 THEN 1 WHEN seq % 3 = 1 THEN 5 WHEN seq % 2 = 0 THEN 10 ELSE 8 END", "0.9"),
    _row("indexing_visibility", "resonance", "CASE WHEN seq % 3 = 0 THEN 1 WHEN seq % 2 = 0 THEN 10 ELSE 7 END", "0.9"), _row("ethical_training_signals", "transparency", "CASE WHEN seq % 5 = 0 THEN 5 ELSE 1 END", "0.9"),
]
ORACLES = {
    "e_discovery": _T + " UNION ALL ".join(_DISCOVERY) + ") SELECT * FROM r",
    "e_attributes": _T + " UNION ALL ".join(_ROWS) + ") SELECT * FROM r WHERE value IS NOT NULL",
    "e_provenance": _T + " UNION ALL ".join([_LABEL, _AUTHOR, _row("c2pa_cai_manifest_present", "provenance", "CASE WHEN modality <> 'text' THEN 1 END", "1.0"), _row("source_domain_trust_baseline", "provenance", "5", "0.7")]) + ") SELECT * FROM r WHERE value IS NOT NULL",
}
