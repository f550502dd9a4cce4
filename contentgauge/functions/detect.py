"""Attribute detectors: each is one nullable struct column over a content row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentgauge.functions.pages import author_kinds, names_in
from contentgauge.functions.urls import location, path

# fixed values: phrases of the rules
HUMAN = ["human-led", "written by a human", "no ai was used", "human-created content"]
AI_MADE = ["generated by ai", "ai-generated content", "created with the assistance of ai", "ai supports the work", "assisted by artificial intelligence"]
AI_TRACES = ["as an ai language model", "i am a machine learning model", "generated by chatgpt"]
SLANG = ["gonna", "wanna", "lol", "lmao", "omg", "thx", "u", "ur", "cuz"]
CONTRADICTIONS = [("always", "never"), ("100%", "some"), ("free", "paid"), ("guaranteed", "estimated")]
AI_FEATURES = [
    "artificial intelligence", "machine learning", "ai-powered", "ai powered", "personalized", "personalisation", "recommendation", "smart", "intelligent", "automated", "chatbot", "virtual assistant",
    "predicted", "prediction", "algorithm",
]
EXPLAINED = ["why you're seeing this", "how this works", "how we recommend", "how we personalize", "learn more about our recommendations", "about our algorithm", "transparency", "explain"]
AI_DISCLOSED = ["ai-generated", "ai generated", "ai-assisted", "ai assisted", "generated by ai", "created with ai"]
CONTACT = ["contact us", "get in touch", "customer support", "help center", "contact support"]
COMMERCIAL = ["buy now", "limited time offer", "discount code", "affiliate link"]
AD_LABELS = ["ad", "sponsored", "paid partnership", "promoted"]
CLAIMS = [
    r"\d+%", r"\$[\d,]+", r"\d+\s*million", r"\d+\s*billion", r"\d+\s*thousand", r"study\s+(found|shows|revealed)", r"research\s+(found|shows|revealed)", r"survey\s+(found|shows|revealed)",
    r"statistics?\s+(show|indicate)", r"data\s+(show|indicate)", r"according\s+to\s+(a\s+)?(study|research|survey|report)", r"findings?\s+(from|of)", r"results?\s+(from|of)",
]
CITATIONS = [
    r"\[\d+\]", r"\(\w+,? \d{4}\)", r"according to\s+[\w\s]+(university|institute|organization|agency|department)", r"source:\s*[\w\s]+", "cited by", "study by", "research by", "report by",
]
PRIVACY = [
    "privacy policy", "privacy notice", "privacy statement", "data protection", "privacy & terms", "privacy and terms", "cookie policy", "privacy center", "your privacy", "legal", "terms of use",
    "terms of service", "cookie preferences", "cookie settings", "personal information", "data privacy", "/privacy", "/terms",
]
LANDING = ["/about", "/home", "/product/", "/service/", "/solution/"]
SOCIAL_CHANNELS = ["reddit", "twitter", "facebook", "instagram"]
ENGAGED_CHANNELS = ["amazon", "etsy", "facebook", "instagram", "reddit", "tiktok", "tripadvisor", "twitter", "yelp", "youtube"]
JOB_PARTS = ["careers.", "jobs.", "/careers/", "/jobs/", "apply.", "greenhouse.io", "lever.co", "workday.com", "taleo.net", "jobvite.com", "indeed.com", "linkedin.com/jobs"]
DOC_PARTS = ["docs.", "/docs/", "/documentation/", "developer.", "/api/", "help.", "/help/", "support.", "/kb/", "wiki.", ".gov", ".edu", ".mil"]
DISCUSSED = ["/reviews/", "/community/", "/forum/", "/comments/"]
SOCIAL = ["instagram.com", "linkedin.com", "twitter.com", "x.com", "facebook.com", "tiktok.com"]
TRUSTED_SOURCES = {"amazon": 8.0, "reddit": 7.0, "youtube": 7.0}
TRUSTED_SUFFIXES = [".gov", ".edu", ".org", "nytimes.com", "wsj.com", "bbc.com", "reuters.com"]


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def matches_any(text: Column, patterns: list[str], starts: str) -> Column:
    """Case-insensitive and Unicode-aware, in one pass; starts is the class of characters with which some pattern begins, so that most places are left at once."""
    return text.rlike(f"(?iU)(?={starts})(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def meta(key: str) -> Column:
    return F.try_element_at("meta", F.lit(key))


def has_key(*keys: str) -> Column:
    return F.coalesce(reduce(or_, [F.map_contains_key("meta", k) for k in keys]), F.lit(False))


def is_true(key: str) -> Column:
    return F.coalesce(meta(key) == "true", F.lit(False))


def found(attribute: str, dimension: str, value: Column, confidence: Column | float, status: Column | str = "present") -> Column:
    """The struct of a detected attribute; null where value is."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    row = F.struct(F.lit(attribute).alias("attribute_id"), F.lit(dimension).alias("dimension"), value.cast("double").alias("value"), lit(confidence).cast("double").alias("confidence"), lit(status).alias("status"))
    return F.when(value.isNotNull(), row)


def low_text() -> Column:
    """body and title, lower-cased; made once by with_text."""
    return F.col("_low")


def marks() -> dict[str, Column]:
    """What is looked for in whole texts, as columns: a detector uses a mark in value, confidence and status, but the text is searched once.

    Costly patterns are tried only where they matter: citations with a claim, addresses with an @, stars with reviews.
    """
    low, body, text = low_text(), F.col("_body"), F.coalesce("body", F.lit(""))
    clash = reduce(or_, [(F.instr(body, a) > 0) & (F.instr(body, b) > 0) & (F.abs(F.instr(body, a) - F.instr(body, b)) < 100) for a, b in CONTRADICTIONS])
    claims = matches_any(text, CLAIMS, r"[\d$srdaf]")
    reviews = low.contains("reviews")
    return {
        "_slang": contains_any(low, [f" {w} " for w in SLANG]), "_clash": clash,
        "_links": F.when(low.contains("://"), F.size(F.regexp_extract_all(low, F.lit("(https?://[!$-_a-z]+)"), 1))).otherwise(0),
        "_uses": contains_any(low, AI_FEATURES), "_explained": contains_any(low, EXPLAINED), "_disclosed": contains_any(low, AI_DISCLOSED), "_private": contains_any(low, PRIVACY),
        "_contact": contains_any(low, CONTACT) | (low.contains("@") & low.rlike(r"(?U)[\w.-]+@[\w.-]+\.\w+")), "_hidden": contains_any(low, COMMERCIAL) & ~contains_any(low, AD_LABELS),
        # 0 without a claim, 1 with one, 2 with a citation too
        "_cited": F.when(claims, F.when(matches_any(text, CITATIONS, r"[\[(ascr]"), 2).otherwise(1)).otherwise(0),
        # 0 without reviews, 1 with, 2 with stars too
        "_reviews": F.when(reviews, F.when(low.rlike(r"[0-9](\.[0-9])?\s*(out of|/)\s*5"), 2).otherwise(1)).otherwise(0),
    }


def content_type() -> Column:
    """blog, news, article or landing_page by url; else the type in meta or in schema.org; else by channel."""
    low, kind = F.col("_url"), F.lower(F.coalesce(meta("type"), F.lit("")))
    schema = F.coalesce(F.regexp_extract(F.coalesce(meta("schema_org"), F.lit("")), r'"@type"\s*:\s*"(\w*(?:Article|BlogPosting))"', 1), F.lit(""))
    return (
        F.when(low.contains("/blog/"), "blog").when(contains_any(low, ["/news/", "/story/"]), "news").when(contains_any(low, ["/article/", "/post/"]), "article")
        .when(low.endswith("/") | contains_any(low, LANDING), "landing_page").when(kind.isin("article", "blog", "news", "blogposting", "newsarticle"), kind)
        .when(schema.contains("Blog"), "blog").when(schema.contains("Article"), "article").when(F.col("channel").isin(SOCIAL_CHANNELS), "social_post").when(F.col("channel").isin("youtube", "tiktok"), "video").otherwise("other")
    )


def is_engaging() -> Column:
    """Whether votes and ratings are to be expected."""
    low, kind = F.col("_url"), F.lower(F.coalesce("platform_type", F.lit("")))
    owned = (kind == "owned") & (F.lower(F.coalesce("source_type", F.lit(""))) == "brand_owned") & ~contains_any(low, DISCUSSED)
    return F.lower(F.coalesce("channel", F.lit(""))).isin(ENGAGED_CHANNELS) | kind.isin("social", "marketplace") | ~(contains_any(low, JOB_PARTS) | owned | contains_any(low, DOC_PARTS))


def readability() -> Column:
    """By the median of words per sentence; the words of each sentence come from with_sentences."""
    n = F.size("_counts")
    at = lambda k: F.try_element_at(F.col("_counts"), k.cast("int"))
    median = F.when(n % 2 == 1, at((n + 1) / 2).cast("double")).otherwise((at(n / 2) + at(n / 2 + 1)) / 2)
    return F.when(median.between(12, 22), 10.0).when(median.between(8, 30), 7.0).when(median.isNotNull(), 4.0)


def provenance() -> list[Column]:
    score = F.lit(0)
    # the first phrase that occurs counts, more in header or footer than in the text
    says = lambda parts: F.coalesce(*[F.when(F.col("_margin").contains(p), 4).when(F.col("_main").contains(p), 3) for p in parts], F.lit(0))
    by_kind = F.coalesce(F.exists(author_kinds(F.coalesce(meta("schema_org"), F.lit(""))), lambda k: k.isin("Person", "Organization")), F.lit(False))
    parts = [F.when(by_kind, 4).otherwise(0), F.when(is_true("has_c2pa_manifest"), 5).otherwise(0), F.when(F.coalesce(meta("author"), F.lit("")) != "", 2).otherwise(0), F.when(is_true("ai-generated"), 5).otherwise(0), says(HUMAN), says(AI_MADE)]
    for p in parts:
        score = score + p
    label = F.when(score >= 4, F.least(F.lit(10.0), F.greatest(F.lit(5.0), score.cast("double")))).when(contains_any(F.col("_main"), AI_TRACES), 1.0)
    manifest = F.when(has_key("c2pa_manifest", "cai_manifest", "content_credentials"), F.when(F.coalesce(meta("c2pa_valid"), F.lit("")) == "false", 5.0).otherwise(10.0)).when(
        (F.col("modality") != "text") | is_true("has_significant_visuals"), 1.0
    )
    canonical, source = meta("canonical_url"), F.coalesce(meta("url"), F.col("url"))
    bare = lambda u: F.replace(location(u), F.lit("www."), F.lit(""))
    same_page = F.rtrim(canonical, F.lit("/")) == F.rtrim(source, F.lit("/"))
    match = F.when(F.coalesce(canonical, F.lit("")).__ne__("") & F.coalesce(source, F.lit("")).__ne__(""), F.when(same_page | ((bare(canonical) == bare(source)) & (path(canonical) == path(source))), 10.0).when(bare(canonical) == bare(source), 5.0).otherwise(1.0))
    age = F.try_to_number(meta("domain_age_days"), F.lit("999999"))
    signs = [meta("ssl_valid") == "false", F.map_contains_key("meta", "privacy") & (meta("privacy") == ""), meta("has_privacy_policy") == "false", age < 30, meta("malware_detected") == "true", meta("spam_score").try_cast("double") > 7]
    flags = reduce(or_, [F.coalesce(f, F.lit(False)) for f in signs])
    trusted = reduce(lambda c, kv: c.when(F.lower("src") == kv[0], kv[1]), list(TRUSTED_SOURCES.items())[1:], F.when(F.lower("src") == "amazon", 8.0))
    domain = F.coalesce(meta("domain"), F.lit(""))
    institution = reduce(or_, [domain.endswith(s) for s in TRUSTED_SUFFIXES])
    hygiene = 5.0 + is_true("ssl_valid").cast("double") + (F.coalesce(meta("privacy"), F.lit("")) != "").cast("double") + F.when(age > 365, 1.0).when(age > 90, 0.5).otherwise(0.0)
    trust = F.when(flags, 2.0).otherwise(F.coalesce(trusted, F.when(institution, 9.0), F.least(F.lit(8.0), hygiene)))
    trust_confidence = F.when(flags, 0.9).when(trusted.isNotNull() | institution, 0.8).otherwise(0.7)
    value_of = lambda *keys: F.coalesce(*[F.when(F.coalesce(meta(k), F.lit("")) != "", meta(k)) for k in keys])
    named = F.trim(F.coalesce("author", F.lit("")))
    byline = (F.length(named) > 2) & ~F.lower(named).isin("admin", "editor", "staff", "unknown")
    schema = F.coalesce(meta("schema_org"), F.lit(""))
    in_schema = lambda key: F.size(names_in(schema, key)) > 0
    signed = F.exists(names_in(schema, "author"), lambda x: ~F.lower(x).isin("unknown", "anonymous"))
    writer = F.lower(F.coalesce(value_of("author"), F.lit("unknown")))
    short, about = F.length("_body") < 200, F.substring("_body", 1, 500).contains("about")
    # value, confidence, status of the first kind of attribution there is
    ladder = [
        (byline, 10.0, 0.9, "present"), (signed, 8.0, 0.95, "present"), (~writer.isin("unknown", "anonymous"), 7.0, 0.9, "present"),
        (in_schema("publisher") | in_schema("contributor"), 7.0, 0.9, "present"), (value_of("maintained_by", "content_by", "team", "department").isNotNull(), 6.0, 0.85, "present"),
        (value_of("about_url", "credits_url", "team_url").isNotNull(), 6.0, 0.8, "present"), (is_true("has_global_author_info"), 8.0, 0.85, "present"), (about, 5.0, 0.5, "partial"), (short, 1.0, 0.5, "unknown"),
    ]
    first = lambda k, last: reduce(lambda rest, row: F.when(row[0], row[k]).otherwise(rest), ladder[::-1], F.lit(last))
    years = F.try_to_number(meta("whois_age_years"), F.lit("9999.9")).cast("double")
    social = F.lower(F.coalesce("src", F.lit(""))).isin("amazon", "facebook", "instagram", "reddit", "tiktok", "twitter", "youtube")
    aged = F.when(years >= 10, 10.0).when(years >= 5, 8.0).when(years >= 2, 6.0).when(years >= 1, 4.0).when(years >= 0.5, 3.0).when(years.isNotNull(), 2.0)
    hidden = is_true("whois_private")
    exif = F.coalesce(meta("exif_status"), F.lit("intact"))
    return [
        found("ai_vs_human_labeling_clarity", "provenance", label, F.when(score >= 4, F.least(F.lit(1.0), score / 10 + 0.2)).otherwise(0.9), F.when(score >= 4, "present").otherwise("absent")),
        found("author_brand_identity_verified", "provenance", first(1, 1.0), first(2, 0.8), first(3, "absent")),
        found("domain_age", "provenance", F.when(~social, aged), 0.9),
        found("whois_privacy", "provenance", F.when(~social, F.when(hidden, 4.0).when(value_of("whois_org").isNotNull(), 8.0)), F.when(hidden, 0.85).otherwise(0.9)),
        found("c2pa_cai_manifest_present", "provenance", manifest, 1.0),
        found("canonical_url_matches_declared_source", "provenance", match, 1.0, F.when(match > 1, "present").otherwise("absent")),
        found("digital_watermark_fingerprint_detected", "provenance", F.when(has_key("watermark", "fingerprint", "digital_signature"), 10.0), 1.0),
        found("exif_metadata_integrity", "provenance", F.when(has_key("exif_data"), F.when(exif == "intact", 10.0).when(exif == "stripped", 5.0).otherwise(1.0)), 1.0),
        found("source_domain_trust_baseline", "provenance", trust, trust_confidence),
        found("verified_platform_account", "provenance", F.when(is_true("badge_verified"), 10.0).when(contains_any(F.lower(F.coalesce("url", F.lit(""))), SOCIAL), 3.0), F.when(is_true("badge_verified"), 1.0).otherwise(0.7)),
    ]


def resonance() -> list[Column]:
    lang = F.coalesce(meta("language"), F.lit("en"))
    return [found("language_locale_match", "resonance", F.when(lang.isin("en", ""), 10.0).otherwise(1.0), 0.9), found("readability_grade_level_fit", "resonance", readability(), 0.7)]


def coherence() -> list[Column]:
    slang, clash, links = F.col("_slang"), F.col("_clash"), F.col("_links")
    rate = F.coalesce(F.try_to_number(meta("broken_links"), F.lit("999999")).cast("double"), F.lit(0.0)) / links
    broken = F.when(links > 0, F.when(rate < 0.01, 10.0).when(rate < 0.05, 7.0).when(rate < 0.1, 4.0).otherwise(1.0))
    votes, rating = F.coalesce("upvotes", F.lit(0)), F.coalesce("rating", F.lit(0.0))
    trust = F.when((votes > 50) & (rating > 4), 10.0).when((votes > 10) & (rating > 3), 7.0).when((votes > 5) | (rating > 2), 6.0).when((rating < 2) & (rating > 0), 3.0)
    mail = F.when((F.col("channel") == "email") & (F.coalesce(meta("landing_page_match"), F.lit("")) == "false"), 2.0)
    return [
        found("brand_voice_consistency_score", "coherence", F.when(slang, 4.0).otherwise(10.0), F.when(slang, 0.7).otherwise(0.6)), found("broken_link_rate", "coherence", broken, 0.8),
        found("engagement_to_trust_correlation", "coherence", F.when(is_engaging(), trust), 0.6),
        found("claim_consistency_across_pages", "coherence", F.when(clash, 3.0), 0.6), found("email_asset_consistency_check", "coherence", mail, 0.9),
    ]


def citations() -> tuple[Column, Column]:
    cited = F.col("_cited")
    return F.when(cited > 0, F.when(cited == 2, 10.0).otherwise(2.0)), F.when(cited == 2, 0.85).otherwise(0.8)


def transparency() -> list[Column]:
    uses = F.col("_uses") | is_true("uses_ai") | is_true("has_recommendations")
    explained = F.col("_explained")
    disclosed, site = F.col("_disclosed") | is_true("ai_generated"), is_true("has_global_ai_disclosure")
    contact = has_key("contact_url", "email", "phone", "address") | F.col("_contact")
    value, confidence = citations()
    policy = contains_any(F.col("_url"), ["privacy", "legal", "terms"])
    linked = has_key("privacy_policy_url", "privacy_url", "privacy_policy_link") | F.col("_private")
    missed = content_type().isin("landing_page", "other") & (F.lower(F.coalesce("platform_type", F.lit(""))) == "owned")
    return [
        found("privacy_policy_link_availability_clarity", "transparency", F.when(policy | linked, 10.0).when(missed, 2.0), F.when(policy, 0.95).when(linked, 0.9).otherwise(0.7)),
        found("ai_explainability_disclosure", "transparency", F.when(uses, F.when(explained, 10.0).otherwise(2.0)), F.when(explained, 0.9).otherwise(0.8)),
        found("ai_generated_assisted_disclosure_present", "transparency", F.when(disclosed, 10.0).when(site, 8.0).otherwise(1.0), F.when(~disclosed & site, 0.9).otherwise(1.0)),
        found("caption_subtitle_availability_accuracy", "transparency", F.when(F.col("src") == "youtube", F.when(is_true("has_captions"), 10.0).otherwise(1.0)), 1.0),
        found("data_source_citations_for_claims", "transparency", value, confidence),
        found("contact_info_availability", "transparency", F.when(contact, 10.0).otherwise(2.0), F.when(contact, 0.9).otherwise(0.7)),
    ]


def verification() -> list[Column]:
    value, confidence = citations()
    hidden = F.col("_hidden")
    verified, amazon, helpful = is_true("verified_purchase"), F.col("src") == "amazon", F.coalesce("helpful_count", F.lit(0.0))
    votes = F.coalesce("upvotes", F.lit(0))
    engaged = F.when(content_type().isin("blog", "article", "news", "social_post"), F.when((votes > 100) | (helpful > 10), 9.0).when(votes > 10, 7.0).otherwise(5.0))
    reviews, stars = F.col("_reviews") > 0, F.col("_reviews") == 2
    review = F.when(amazon, F.when(verified & (helpful > 5), 10.0).when(verified, 8.0).otherwise(5.0)).when(reviews & stars, 8.0).when(reviews, 6.0)
    return [
        found("claim_to_source_traceability", "verification", value, confidence), found("ad_sponsored_label_consistency", "verification", F.when(hidden, 1.0), 0.8),
        found("engagement_authenticity_ratio", "verification", engaged, 0.6), found("influencer_partner_identity_verified", "verification", F.when(is_true("influencer_verified") | is_true("verified"), 10.0), 1.0),
        found("review_authenticity_confidence", "verification", review, F.when(amazon, 0.7).when(stars, 0.6).otherwise(0.5)),
        found("verified_purchaser_review_rate", "verification", F.when(amazon, F.when(verified, 10.0).otherwise(3.0)), 1.0),
        found("agent_safety_guardrail_presence", "verification", F.when((F.col("modality") == "agent") & (F.coalesce(meta("safety_guardrails"), F.lit("")) == "false"), 1.0), 1.0),
    ]


def discovery() -> list[Column]:
    """Markup and indexing attributes; not among the default dimensions."""
    text = lambda k: F.coalesce(meta(k), F.lit(""))
    schema = has_key("schema_org", "json_ld", "microdata", "rdfa")
    filled = [F.trim(F.coalesce("title", F.lit(""))) != "", F.length(F.trim(F.coalesce("body", F.lit("")))) > 100, F.trim(F.coalesce("author", F.lit(""))) != "", text("published_at") != "", (text("keywords") != "") | (text("tags") != "")]
    og = F.exists(F.coalesce(F.map_keys("meta"), F.array().cast("array<string>")), lambda k: k.startswith("og_"))
    n = reduce(lambda a, b: a + b, [f.cast("int") for f in [*filled, og]])
    robots, own = F.lower(text("robots")), F.rtrim(F.coalesce("url", F.lit("")), F.lit("/"))
    canonical = F.coalesce(F.when(text("canonical_url") != "", text("canonical_url")), F.when(text("canonical") != "", text("canonical")))
    closed, allowed = robots.contains("noindex"), text("robots_txt_allowed") != "false"
    mapped = is_true("has_sitemap") | is_true("in_sitemap")
    directive = has_key("tdm_reservation", "ai_training_optout", "robots_tdm") | contains_any(F.lower(text("robots_txt")), ["gptbot", "ccbot", "anthropic-ai", "claude-web"])
    return [
        found("schema_compliance", "coherence", F.when(schema & (text("schema_valid") != "false"), 10.0).when(schema, 7.0).otherwise(1.0), 0.9), found("metadata_completeness", "provenance", 1 + n / 5 * 9.0, 0.9),
        found("llm_retrievability", "resonance", F.when(closed, 1.0).when(robots.contains("nofollow"), 5.0).when(is_true("in_sitemap"), 10.0).otherwise(8.0), 0.9),
        found("canonical_linking", "provenance", F.when(canonical.isNull(), 1.0).when(F.rtrim(canonical, F.lit("/")) == own, 10.0).otherwise(5.0), 0.9),
        found("indexing_visibility", "resonance", F.when(mapped & allowed & ~closed, 10.0).when(allowed & ~closed, 7.0).when(closed, 1.0).otherwise(3.0), 0.9),
        found("ethical_training_signals", "transparency", F.when(directive, 10.0).when((text("copyright") != "") | (text("rights") != ""), 5.0).otherwise(1.0), 0.9),
    ]
