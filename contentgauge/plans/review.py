"""Queries of the review operators, with their SQL twins; their inputs come from documents and orders by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import config as C
from contentgauge.operators import review as V
from contentgauge.operators import scoring as S
from contentgauge.plans.scores import ATTR_SQL, CLASS_SQL, attributes
from contentgauge.sources.tables import CONTENT_SQL, DIMENSIONS, contents, scores, table

STATUSES = ["supported", "CONTRADICTED", "unverified", "unclear"]
TYPES = {"broken_links": "coherence", "inconsistent_voice": "coherence", "unclear_authorship": "provenance", "missing_privacy_policy": "transparency"}
RULES = [("long", "bonus", 5.0, ["words"], ">=", 40.0), ("short", "penalty", 8.0, ["words"], "<", 10.0), ("named", "bonus", 3.0, ["author", "editor"], None, None)]


def claims(spark, sf_dir, **more):
    """Claims of each document, with more columns of it."""
    n = F.col("seq")
    rows = contents(spark, sf_dir).select("content_id", n.alias("_n"), *[c.alias(k) for k, c in more.items()], F.posexplode(F.sequence(F.lit(0), (n % 7).cast("int"))).alias("claim_no", "k"))
    return rows.select("content_id", "claim_no", *more, F.element_at(F.array(*map(F.lit, STATUSES)), ((F.col("_n") + F.col("k")) % 4 + 1).cast("int")).alias("status"))


def issues(spark, sf_dir):
    """Of every document: its first words as a quote, or a quote that it does not have."""
    n = F.col("seq")
    kinds = list(TYPES)
    said = F.when(n % 2 == 0, F.substring("body", 3, 30)).otherwise(F.lit("words that are not there"))
    return contents(spark, sf_dir).select(
        "content_id", F.element_at(F.array(*map(F.lit, kinds)), (n % 4 + 1).cast("int")).alias("type"), F.element_at(F.array(*[F.lit(TYPES[k]) for k in kinds]), (n % 4 + 1).cast("int")).alias("dimension"),
        F.when(n % 5 != 0, (n % 10) / 10.0).alias("confidence"), F.lit(None).cast("string").alias("severity"), F.concat(F.lit("EXACT QUOTE: '"), F.regexp_replace(said, "'", ""), F.lit("'")).alias("evidence"),
        F.when(n % 11 != 0, "Change 'tiny' -> 'small'").alias("suggestion"),
    )


def f4_confidences(spark, sf_dir):
    c = contents(spark, sf_dir).withColumns({"author": F.lit(None).cast("string"), "n_sources": F.col("seq") % 5, "has_guidelines": F.col("seq") % 2 == 0})
    return V.confidences(c)


def f6_claims(spark, sf_dir):
    found = V.verify_claims(claims(spark, sf_dir), contents(spark, sf_dir).filter("seq % 6 = 0"))
    return found.withColumn("score", F.round("score", 9))


def told_claims(spark, sf_dir):
    """The same claims in words, with the first words of the document as their reasons; some have no confidence or reason."""
    n = F.col("seq")
    c = claims(spark, sf_dir, words=F.substring("body", 1, 40), seq=n)
    return c.select("content_id", "claim_no", "status", F.concat(F.lit("claim "), "claim_no").alias("claim"), F.when(n % 3 > 0, (n % 10) / 10.0).alias("confidence"), F.when(n % 4 > 0, F.col("words")).alias("reasoning"))


def f6_issues(spark, sf_dir):
    return V.claim_issues(told_claims(spark, sf_dir))


def f7_filter_issues(spark, sf_dir):
    return V.filter_issues(issues(spark, sf_dir)).select("content_id", "type", "confidence", "severity")


def f8_quotes(spark, sf_dir):
    return V.verify_quotes(issues(spark, sf_dir), contents(spark, sf_dir)).select("content_id", "type", "valid")


def merged_issues(spark, sf_dir):
    """Filtered issues, and two more of some documents: one of a known type and one of an unknown; every ninth document has four broken links."""
    n = F.col("seq")
    first = V.filter_issues(issues(spark, sf_dir)).withColumn("issue_no", F.lit(1)).withColumn("evidence", F.concat(F.lit("issue of "), "type"))
    more = lambda no, kind, keep: contents(spark, sf_dir).filter(keep).select(
        "content_id", F.lit(kind).alias("type"), F.lit("coherence").alias("dimension"), F.lit(0.9).alias("confidence"), F.lit("medium").alias("severity"), F.when(n % 4 == 0, "tone").alias("evidence"), F.concat(F.lit("better "), n).alias("suggestion"), F.lit(no).alias("issue_no")
    )
    rows = first.unionByName(more(2, "tone_shift", n % 6 == 0)).unionByName(more(3, "vocabulary", n % 12 == 0)).unionByName(more(4, "no such type", n % 5 == 0))
    broken = contents(spark, sf_dir).filter(n % 9 == 0).select("content_id", F.array(*[F.lit(f"http://x/{k}") for k in range(4)]).alias("urls"))
    return V.merge_issues(attributes(spark, sf_dir), rows, broken, C.issue_map(spark))


def f9_merge_issues(spark, sf_dir):
    return merged_issues(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))


def f17_rubric(spark, sf_dir):
    meta = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("content_id"), F.create_map(F.lit("words"), (F.col("doc_id") % 60).cast("string"), F.lit("editor"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise("")).alias("meta"))
    rules = spark.createDataFrame([(k, *r) for k, r in enumerate(RULES)], "rule_no int, rule_id string, effect string, points double, keys array<string>, op string, threshold double")
    found = V.rubric_scores(scores(spark, sf_dir).join(meta.hint("shuffle_hash"), "content_id"), rules, C.DIMENSION_WEIGHTS)
    return found.select("content_id", F.round("base", 9).alias("base"), F.array_join("applied", ",").alias("applied"), F.round("final", 9).alias("final"), "label")


def f19_merge_labels(spark, sf_dir):
    n = F.col("seq")
    ext = contents(spark, sf_dir).filter(n % 4 == 1).select("content_id", F.when(n % 3 == 0, "authentic").when(n % 3 == 1, "suspect").otherwise("inauthentic").alias("label"), ((n % 6) / 5.0).alias("confidence"))
    base = S.classify(scores(spark, sf_dir)).withColumn("base", S.clamp(F.col("overall") * 100 + n % 9 - 4, 0.0, 100.0))
    found = V.merge_labels(base, ext, C.DIMENSION_WEIGHTS)
    return found.select("content_id", "class_label", "is_authentic", F.round("final", 9).alias("final"), *[F.round(f"score_{d}", 9).alias(d) for d in DIMENSIONS])


def f19_fallback_labels(spark, sf_dir):
    return V.fallback_labels(S.classify(scores(spark, sf_dir)).withColumn("final", F.col("overall") * 100))


def f25_whois(spark, sf_dir):
    """Orders as domains: created on the order's date, expiring by its key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    registry = o.select(
        F.concat(F.lit("d"), k.cast("string")).alias("domain"), F.to_date("o_orderdate").alias("created"), F.date_add(F.to_date(F.lit("1998-12-01")), (k % 800 - 50).cast("int")).alias("expires"), (k % 3 == 0).alias("private"),
        F.when(k % 2 == 0, "Org").alias("org"), F.when(k % 5 == 0, "GoDaddy Inc").when(k % 5 == 1, "Other").alias("registrar"),
    )
    return V.whois_signals(registry, F.to_date(F.lit("1998-12-01"))).drop("trust", "age_years")


def d11_text_stats(spark, sf_dir):
    t = V.text_stats(contents(spark, sf_dir))
    return t.select("content_id", F.size("passive").alias("n_passive"), F.array_join("weak_words", ",").alias("weak_words"), F.round("reading_ease", 6).alias("reading_ease"), F.round("grade", 6).alias("grade"))


def d12_chunks(spark, sf_dir):
    return V.chunk_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (f4_confidences, f6_claims, f6_issues, f7_filter_issues, f8_quotes, f9_merge_issues, f17_rubric, f19_merge_labels, f19_fallback_labels, f25_whois, d11_text_stats, d12_chunks)}

_KINDS, _DIMS = str(list(TYPES)), str(list(TYPES.values()))
ISSUE_SQL = f"""iss AS (SELECT content_id, title, body, {_KINDS}[seq % 4 + 1] AS type, {_DIMS}[seq % 4 + 1] AS dimension, CASE WHEN seq % 5 <> 0 THEN (seq % 10) / 10.0 END AS confidence,
 replace(CASE WHEN seq % 2 = 0 THEN substr(body, 3, 30) ELSE 'words that are not there' END, '''', '') AS quote, CASE WHEN seq % 11 <> 0 THEN 1 END AS suggestion FROM content),
good AS (SELECT content_id, type, coalesce(confidence, 0.8) AS confidence, 'medium' AS severity FROM iss WHERE suggestion IS NOT NULL AND (dimension <> 'coherence' OR coalesce(confidence, 0.8) >= 0.7))"""
_move = lambda d: f"round(least(1.0, greatest(0.0, score_{d} + CASE WHEN conf > 0 AND label = 'authentic' THEN 1 WHEN conf > 0 AND label = 'inauthentic' THEN -1 ELSE 0 END * coalesce(conf - 0.5, 0) * 0.2)), 9) AS {d}"
_total = lambda name: "100 * (" + " + ".join(f"{name(d)} * {w}" for d, w in C.DIMENSION_WEIGHTS.items()) + ")"
# the twin writes the text of each case out: an issue of the first kind, then of tone, then of vocabulary
MERGED_SQL = f"""{ATTR_SQL}, {ISSUE_SQL}, im AS (SELECT * FROM ({C.values_sql(list(C.ISSUE_ATTRIBUTES.items()))}) AS t(type, attribute_id)),
al AS (SELECT content_id, 1 AS no, type, dimension, confidence, CASE WHEN type = 'broken_links' THEN 'Verified broken links: http://x/0, http://x/1, http://x/2' ELSE 'issue of ' || type END AS evidence, replace('Change "tiny" -> "small"', '"', chr(39)) AS suggestion
  FROM (SELECT g.*, iss.dimension, CAST(g.content_id[5:] AS BIGINT) AS seq FROM good AS g JOIN iss USING (content_id)) WHERE type <> 'broken_links' OR seq % 9 = 0
 UNION ALL SELECT content_id, 2, 'tone_shift', 'coherence', 0.9, CASE WHEN seq % 4 = 0 THEN 'tone' END, 'better ' || seq FROM content WHERE seq % 6 = 0
 UNION ALL SELECT content_id, 3, 'vocabulary', 'coherence', 0.9, CASE WHEN seq % 4 = 0 THEN 'tone' END, 'better ' || seq FROM content WHERE seq % 12 = 0),
mp AS (SELECT al.*, attribute_id FROM al JOIN im USING (type)),
gr AS (SELECT content_id, attribute_id, count(*) AS agree, arg_max(suggestion, no) AS suggestion, coalesce(string_agg(DISTINCT ' | LLM Note: ' || evidence, '' ORDER BY ' | LLM Note: ' || evidence), '') AS added FROM mp GROUP BY ALL),
merged AS (SELECT content_id, attribute_id, dimension, value, least(1.0, confidence * pow(1.2, coalesce(agree, 0))) AS confidence, evidence || coalesce(added, '') AS evidence, CAST(NULL AS VARCHAR) AS label, suggestion, CASE WHEN agree > 0 THEN 'both' ELSE 'rule' END AS origin FROM attrs LEFT JOIN gr USING (content_id, attribute_id)
 UNION ALL SELECT content_id, attribute_id, dimension, 5.0, confidence, coalesce(evidence, 'Detected by AI analysis'), array_to_string(list_transform(string_split(type, '_'), lambda w: upper(w[1]) || w[2:]), ' '), suggestion, 'issue' FROM mp ANTI JOIN attrs USING (content_id, attribute_id))"""
CLAIM_SQL = f"""clm AS (SELECT content_id, seq, k AS claim_no, {STATUSES}[(seq + k) % 4 + 1] AS status, CASE WHEN seq % 3 > 0 THEN (seq % 10) / 10.0 END AS confidence, CASE WHEN seq % 4 > 0 THEN substr(body, 1, 40) ELSE '' END AS reason FROM (SELECT content_id, seq, body, unnest(generate_series(0, least(seq % 7, 4))) AS k FROM content)),
cis AS (SELECT content_id, claim_no, 'unverified_claims' AS type, CASE WHEN status = 'CONTRADICTED' THEN 'high' ELSE 'medium' END AS severity, CASE WHEN status = 'CONTRADICTED' THEN coalesce(confidence, 0.8) ELSE 0.8 END AS confidence,
 'Claim: ' || chr(39) || 'claim ' || claim_no || chr(39) || chr(10) || 'Verdict: ' || CASE WHEN status = 'CONTRADICTED' THEN status ELSE 'UNVERIFIED' END || chr(10) || reason AS evidence,
 CASE WHEN status = 'CONTRADICTED' THEN 'Remove or correct this claim: ' || reason ELSE 'Add a citation or source for this claim.' END AS suggestion FROM clm WHERE status <> 'supported')"""
_W = r"[\p{L}\p{N}_]"
ORACLES = {
    # RE2 knows words of ASCII letters only, so their borders are written out
    "d11_text_stats": rf"""WITH {CONTENT_SQL}, s AS (SELECT content_id, body, lower(body) AS low, list_filter(list_transform(string_split_regex(body, '[.!?]+'), lambda x: trim(x, E' \t\n\r\x0b\x0c')), lambda x: x <> '') AS ss FROM content),
k AS (SELECT *, greatest(len(regexp_extract_all(body, '{_W}+')), 1) AS words, greatest(len(ss), 1) AS n, greatest(len(regexp_extract_all(low, '[aeiouyáàâäãéèêëíìîïóòôöõúùûü]+')), 1) AS syllables FROM s)
SELECT content_id, CAST(least(5, len(list_filter(ss, lambda x: regexp_matches(x, '(?i)(^|[^\p{{L}}\p{{N}}_])(am|is|are|was|were|be|been|being)\s+{_W}+(ed|en)($|[^\p{{L}}\p{{N}}_])')))) AS INTEGER) AS n_passive,
 array_to_string(list_filter({V.WEAK}, lambda w: contains(low, ' ' || w || ' ')), ',') AS weak_words, round(206.835 - 1.015 * words / n - 84.6 * syllables / words, 6) AS reading_ease, round(0.39 * words / n + 11.8 * syllables / words - 15.59, 6) AS grade FROM k""",
    "f6_issues": f"WITH {CONTENT_SQL}, {CLAIM_SQL} SELECT * FROM cis",
    "f4_confidences": f"""WITH {CONTENT_SQL} SELECT content_id, CASE WHEN length(body) < 200 THEN 0.6 ELSE 1.0 END AS provenance, CASE WHEN seq % 5 = 0 THEN 0.3 WHEN seq % 5 < 3 THEN 0.7 ELSE 1.0 END AS verification,
 CASE WHEN length(body) < 300 THEN 0.7 ELSE 1.0 END AS transparency, CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.6 END AS coherence, 1.0 AS resonance FROM content""",
    "f6_claims": f"""WITH {CONTENT_SQL}, c AS (SELECT content_id, upper({STATUSES}[(seq + k) % 4 + 1]) AS s FROM (SELECT content_id, seq, unnest(generate_series(0, least(seq % 7, 4))) AS k FROM content) UNION ALL SELECT content_id, 'SUPPORTED' FROM content WHERE seq % 6 = 0),
n AS (SELECT content_id, count(*) FILTER (WHERE s = 'SUPPORTED') AS supported, count(*) FILTER (WHERE s = 'CONTRADICTED') AS contradicted, count(*) FILTER (WHERE s NOT IN ('SUPPORTED', 'CONTRADICTED')) AS unverified FROM c GROUP BY ALL)
SELECT *, round(least(1.0, greatest(0.0, 0.5 + 0.1 * supported - 0.2 * contradicted - 0.05 * unverified)), 9) AS score FROM n""",
    "f7_filter_issues": f"WITH {CONTENT_SQL}, {ISSUE_SQL} SELECT * FROM good",
    "f8_quotes": f"""WITH {CONTENT_SQL}, {ISSUE_SQL}, q AS (SELECT content_id, type, lower(trim(quote)) AS q, lower(title || ' ' || body) AS t FROM iss)
SELECT content_id, type, length(q) < 10 OR contains(t, q) OR contains(trim(regexp_replace(t, '\\s+', ' ', 'g')), trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS valid FROM q""",
    "f9_merge_issues": f"WITH {MERGED_SQL} SELECT * REPLACE (round(confidence, 9) AS confidence) FROM merged",
    "f17_rubric": f"""WITH {CLASS_SQL}, b AS (SELECT content_id, seq, 100 * ({' + '.join(f'score_{d} * {w}' for d, w in C.DIMENSION_WEIGHTS.items())}) AS base FROM scores),
f AS (SELECT content_id, base, array_to_string(list_filter([CASE WHEN seq % 60 >= 40 THEN 'long' END, CASE WHEN seq % 60 < 10 THEN 'short' END, CASE WHEN seq % 4 = 0 THEN 'named' END], lambda x: x IS NOT NULL), ',') AS applied,
 least(100.0, greatest(0.0, base + CASE WHEN seq % 60 >= 40 THEN 5 ELSE 0 END - CASE WHEN seq % 60 < 10 THEN 8 ELSE 0 END + CASE WHEN seq % 4 = 0 THEN 3 ELSE 0 END)) AS final FROM b)
SELECT content_id, round(base, 9) AS base, applied, round(final, 9) AS final, CASE WHEN round(final, 9) >= 75 THEN 'authentic' WHEN round(final, 9) >= 40 THEN 'suspect' ELSE 'inauthentic' END AS label FROM f""",
    "f19_merge_labels": f"""WITH {CLASS_SQL}, e AS (SELECT *, CASE WHEN seq % 4 = 1 THEN CASE seq % 3 WHEN 0 THEN 'authentic' WHEN 1 THEN 'suspect' ELSE 'inauthentic' END END AS label, CASE WHEN seq % 4 = 1 THEN (seq % 6) / 5.0 END AS conf, least(100.0, greatest(0.0, overall * 100 + seq % 9 - 4)) AS base FROM cls),
m AS (SELECT content_id, base, coalesce(conf, 0) > 0 AND label <> 'suspect' AS hit, {_total(lambda d: 'score_' + d)} AS before, coalesce(label, class_label) AS class_label, coalesce(label, class_label) = 'authentic' AS is_authentic, {', '.join(map(_move, DIMENSIONS))} FROM e)
SELECT content_id, class_label, is_authentic, round(CASE WHEN hit THEN least(100.0, greatest(0.0, {_total(str)} + base - before)) ELSE base END, 9) AS final, {', '.join(DIMENSIONS)} FROM m""",
    "f19_fallback_labels": f"WITH {CLASS_SQL} SELECT content_id, CASE WHEN overall >= 0.75 THEN 'authentic' WHEN overall >= 0.4 THEN 'suspect' ELSE 'inauthentic' END AS label, CASE WHEN overall >= 0.4 AND overall < 0.75 THEN 0.6 ELSE 0.7 END AS confidence FROM cls",
    "f25_whois": """WITH o AS (SELECT o_orderkey AS k, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') / 365.25 AS y, o_orderkey % 800 - 50 AS days FROM orders), r AS (SELECT *, round(y, 1) AS years FROM o)
SELECT 'd' || k AS domain, CASE WHEN years >= 10 THEN 10.0 WHEN years >= 5 THEN 8.0 WHEN years >= 2 THEN 6.0 WHEN years >= 1 THEN 4.0 WHEN years >= 0.5 THEN 3.0 ELSE 2.0 END AS age_score,
 CASE WHEN k % 3 = 0 THEN 4.0 WHEN k % 2 = 0 THEN 8.0 ELSE 6.0 END AS privacy_score, CASE WHEN days < 0 THEN 1.0 WHEN days < 30 THEN 2.0 WHEN days < 90 THEN 5.0 WHEN days < 365 THEN 7.0 ELSE 9.0 END AS expiry_score,
 CASE WHEN k % 5 = 0 THEN 8.0 WHEN k % 5 = 1 THEN 6.0 END AS registrar_score FROM r""",
}
