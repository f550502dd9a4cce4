"""Claims, issues, external labels, rubric rules, domain registry and text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentgauge.operators.scoring import clamp
from contentgauge.sources.tables import DIMENSIONS

# fixed values: words that weaken a statement
WEAK = ["maybe", "perhaps", "sort of", "kind of", "basically", "literally", "actually", "honestly", "believe", "think"]
PASSIVE = r"(?iU)\b(am|is|are|was|were|be|been|being)\s+(\w+ed|\w+en)\b"
# fixed values: registrars taken as reputable
REGISTRARS = ["markmonitor", "godaddy", "namecheap", "cloudflare", "google", "amazon", "gandi", "name.com", "hover", "tucows", "enom", "network solutions", "verisign"]


def with_badges(claims: DataFrame, badges: DataFrame | None = None) -> DataFrame:
    """claims(content_id, claim_no, status and, where known, claim, confidence, reasoning) with status settled; a badge is a supported claim without a number."""
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    given = lambda c, kind: F.col(c).cast(kind) if c in claims.columns else F.lit(None).cast(kind).alias(c)
    more = [given(c, kind) for c, kind in (("claim", "string"), ("confidence", "double"), ("reasoning", "string"))]
    rows = claims.select("content_id", "claim_no", F.when(status.isin("SUPPORTED", "CONTRADICTED"), status).otherwise("UNVERIFIED").alias("status"), *more)
    return rows if badges is None else rows.unionByName(badges.select("content_id", F.lit("SUPPORTED").alias("status")), allowMissingColumns=True)


def first_claims(claims: DataFrame, most: int = 5) -> DataFrame:
    """The first claims of each item, up to most, and its badges."""
    badge = F.col("claim_no").isNull()
    place = F.row_number().over(Window.partitionBy("content_id", badge).orderBy("claim_no"))
    return claims.withColumn("_n", place).filter(badge | (F.col("_n") <= most)).drop("_n")


def claim_issue() -> Column:
    """What is to be said about a claim: null for a supported one."""
    why = F.coalesce("reasoning", F.lit(""))
    said = F.concat(F.lit("Claim: '"), F.coalesce("claim", F.lit("")), F.lit("'\nVerdict: "), F.col("status"), F.lit("\n"), why)
    row = lambda severity, confidence, suggestion: F.struct(F.lit("unverified_claims").alias("type"), F.lit(severity).alias("severity"), confidence.alias("confidence"), said.alias("evidence"), suggestion.alias("suggestion"))
    wrong = row("high", F.coalesce("confidence", F.lit(0.8)), F.concat(F.lit("Remove or correct this claim: "), why))
    return F.when(F.col("status") == "CONTRADICTED", wrong).when(F.col("status") == "UNVERIFIED", row("medium", F.lit(0.8), F.lit("Add a citation or source for this claim.")))


def claim_issues(claims: DataFrame, most: int = 5) -> DataFrame:
    """A row for each of an item's first claims that is contradicted or unverified: type, severity, confidence, evidence, suggestion."""
    rows = first_claims(with_badges(claims), most).withColumn("_issue", claim_issue()).filter("_issue is not null")
    return rows.select("content_id", "claim_no", "_issue.*")


def claim_results(claims: DataFrame, most: int = 5) -> DataFrame:
    """Counts, claim_score and claim_issues of each item from rows of with_badges."""
    n = lambda s: F.count_if(F.col("status") == s)
    issues = F.array_sort(F.collect_list(F.when(claim_issue().isNotNull(), F.struct("claim_no", claim_issue().alias("i")))))
    counts = [n("SUPPORTED").alias("supported"), n("CONTRADICTED").alias("contradicted"), n("UNVERIFIED").alias("unverified")]
    found = first_claims(claims, most).groupBy("content_id").agg(*counts, F.transform(issues, lambda x: x["i"]).alias("claim_issues"))
    return found.withColumn("claim_score", clamp(0.5 + 0.1 * F.col("supported") - 0.2 * F.col("contradicted") - 0.05 * F.col("unverified")))


def verify_claims(claims: DataFrame, badges: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Score of each item's claims: 0.5, 0.1 more for each supported, 0.2 less for each contradicted, 0.05 less for each unverified.

    The first claims of an item count, up to most; a badge is one supported claim more. Other statuses are unverified.
    """
    return claim_results(with_badges(claims, badges), most).select("content_id", "supported", "contradicted", "unverified", F.col("claim_score").alias("score"))


def confidence_columns() -> dict[str, Column]:
    """Confidence of each dimension's score from what is known of the item; n_sources counts the pages that verify it, n_body the characters of its body."""
    size = F.col("n_body")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = F.coalesce(F.col("rating").isNull() & F.col("upvotes").isNull() & F.col("helpful_count").isNull(), F.lit(False))
    return {
        "provenance": F.when(size < 200, 0.6).otherwise(1.0) * F.when(empty("author") & empty("src"), 0.8).otherwise(1.0), "verification": F.when(F.col("n_sources") == 0, 0.3).when(F.col("n_sources") < 3, 0.7).otherwise(1.0),
        "transparency": F.when(size < 300, 0.7).otherwise(1.0), "coherence": F.when(F.col("has_guidelines"), 1.0).otherwise(0.6), "resonance": F.when(none, 0.5).otherwise(1.0),
    }


def confidences(content: DataFrame) -> DataFrame:
    sized = content.withColumn("n_body", F.length(F.coalesce("body", F.lit(""))))
    return sized.select("content_id", *[c.alias(d) for d, c in confidence_columns().items()])


def quotes(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("'([^']+)'"), 1)


def filter_issues(issues: DataFrame) -> DataFrame:
    """Issues with type, evidence and suggestion; confidence and severity filled. Coherence issues need 0.7, and a voice issue two different quotes."""
    rows = issues.filter("type is not null and evidence is not null and suggestion is not null")
    rows = rows.withColumns({"confidence": F.coalesce("confidence", F.lit(0.8)), "severity": F.coalesce("severity", F.lit("medium"))})
    own = F.transform(quotes(F.col("evidence")), lambda q: F.lower(F.trim(q)))
    twice = (F.col("type") == "inconsistent_voice") & F.coalesce(F.try_element_at(own, F.lit(1)) == F.try_element_at(own, F.lit(2)), F.lit(False))
    return rows.filter((F.col("dimension") != "coherence") | ((F.col("confidence") >= 0.7) & ~twice))


def verify_quotes(issues: DataFrame, content: DataFrame) -> DataFrame:
    """issues with valid: every quote of ten characters or more, of the evidence or of what a suggestion changes, is in the item's text."""
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    text = content.select("content_id", F.lower(F.concat("title", F.lit(" "), "body")).alias("_text")).withColumn("_flat", squeezed(F.col("_text")))
    changed = F.regexp_extract_all(F.coalesce("suggestion", F.lit("")), F.lit("Change '([^']*)'"), 1)
    said = F.filter(F.transform(F.concat(quotes(F.col("evidence")), changed), lambda q: F.lower(F.trim(q))), lambda q: F.length(q) >= 10)
    joined = issues.withColumn("_quotes", said).join(text.hint("shuffle_hash"), "content_id")
    return joined.withColumn("valid", F.forall("_quotes", lambda q: F.col("_text").contains(q) | F.col("_flat").contains(squeezed(q)))).drop("_quotes", "_text", "_flat")


def merge_issues(attributes: DataFrame, issues: DataFrame, broken: DataFrame, type_map: DataFrame) -> DataFrame:
    """Attributes with the issues found in the same item beside them, and the issues that no attribute has as attributes of value 5.

    issues(content_id, issue_no, type, dimension, confidence, evidence, suggestion), broken(content_id, urls). Issues of
    links need a broken link in their item, whose first three are then the evidence; issues of unknown types go. Each
    agreement lifts an attribute's confidence by a fifth, to 1 at most, adds its evidence if it is new, and the last
    suggestion stays. Equal notes of an item meet as one row before they are put into its text.
    """
    by, links = ["content_id", "attribute_id"], F.col("type").isin("broken_links", "outdated_links")
    found = issues.join(broken.select("content_id", F.array_join(F.slice("urls", 1, 3), ", ").alias("_links")).hint("shuffle_hash"), "content_id", "left").filter(~links | (F.col("_links") != ""))
    mapped = found.withColumn("evidence", F.when(links, F.concat(F.lit("Verified broken links: "), "_links")).otherwise(F.col("evidence"))).drop("_links").join(F.broadcast(type_map), "type")
    last = F.max(F.when(F.col("suggestion") != "", F.struct("issue_no", "suggestion"))).alias("last")
    notes = mapped.groupBy(*by, "evidence").agg(F.count("*").alias("n"), F.min("issue_no").alias("first"), last)
    said = notes.groupBy(*by).agg(F.sum("n").alias("_agree"), F.max("last")["suggestion"].alias("suggestion"), F.array_sort(F.collect_list(F.struct("first", "evidence"))).alias("_notes"))
    both = attributes.join(said.hint("shuffle_hash"), by, "left")
    add_note = lambda text, x: F.when((F.coalesce(x["evidence"], F.lit("")) == "") | text.contains(x["evidence"]), text).otherwise(F.concat(text, F.lit(" | LLM Note: "), x["evidence"]))
    text = F.aggregate(F.coalesce("_notes", F.array().cast("array<struct<first:bigint,evidence:string>>")), F.coalesce("evidence", F.lit("")), add_note)
    lifted = F.least(F.lit(1.0), F.col("confidence") * F.pow(F.lit(1.2), F.coalesce("_agree", F.lit(0))))
    old = both.select(*by, "dimension", "value", lifted.alias("confidence"), text.alias("evidence"), F.lit(None).cast("string").alias("label"), "suggestion", F.when(F.col("_agree") > 0, "both").otherwise("rule").alias("origin"))
    new = mapped.join(attributes.select(*by).distinct().hint("shuffle_hash"), by, "left_anti").select(
        *by, "dimension", F.lit(5.0).alias("value"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.coalesce("evidence", F.lit("Detected by AI analysis")).alias("evidence"),
        F.initcap(F.replace("type", F.lit("_"), F.lit(" "))).alias("label"), "suggestion", F.lit("issue").alias("origin"),
    )
    return old.unionByName(new)


def rubric_scores(scores: DataFrame, rules: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted dimensions x 100, moved by the rules that the item's meta triggers, in 0 to 100; label by 75 and 40.

    rules(rule_id, effect, points, keys, op, threshold) is small: a rule with a threshold compares the first of its
    keys whose number satisfies it, one without is triggered by any key with a value. applied is in the order of
    rule_no, if rules have one, or else of rule_id, however the rules are dealt over partitions.
    """
    base = 100 * reduce(add, [F.col(f"score_{d}") * w for d, w in weights.items()]) / sum(weights.values())
    items = scores.select("content_id", base.alias("base"), "meta")
    place = "rule_no" if "rule_no" in rules.columns else "rule_id"
    table = F.broadcast(rules.agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), *[c for c in rules.columns if c != "rule_no"]))).alias("rules")))
    joined = items.join(table, F.lit(True))
    value = lambda k: F.try_element_at("meta", k)
    number = lambda k: value(k).try_cast("double")
    compare = lambda r, k: F.when(r["op"] == ">=", number(k) >= r["threshold"]).when(r["op"] == "<=", number(k) <= r["threshold"]).when(r["op"] == ">", number(k) > r["threshold"]).otherwise(number(k) < r["threshold"])
    hit = lambda r: F.exists(r["keys"], lambda k: F.coalesce(F.when(r["threshold"].isNotNull(), compare(r, k)).otherwise(value(k) != ""), F.lit(False)))
    applied = F.filter("rules", hit)
    moved = F.aggregate(applied, F.lit(0.0), lambda a, r: a + F.when(r["effect"] == "penalty", -F.abs(r["points"])).otherwise(r["points"]))
    out = joined.select("content_id", "base", F.transform(applied, lambda r: r["rule_id"]).alias("applied"), moved.alias("moved")).withColumn("final", clamp(F.col("base") + F.col("moved"), 0.0, 100.0))
    return out.withColumn("label", F.when(F.round("final", 9) >= 75, "authentic").when(F.round("final", 9) >= 40, "suspect").otherwise("inauthentic"))


def merge_labels(scores: DataFrame, labels: DataFrame, weights: dict[str, float], scale: float = 20.0) -> DataFrame:
    """External labels override the class; a confident authentic or inauthentic one moves all dimensions by (confidence - 0.5) * scale / 100.

    final is then the weighted mean of the moved dimensions x 100 with what base (0 to 100, the score with rules) had
    beyond that of the old ones, in 0 to 100; without a move it is base.
    """
    total = lambda: 100 * reduce(add, [F.col(f"score_{d}") * w for d, w in weights.items()])
    joined = scores.join(labels.withColumnsRenamed({"label": "_label", "confidence": "_confidence"}).hint("shuffle_hash"), "content_id", "left").withColumn("_before", total())
    sign = F.when(F.col("_confidence") > 0, F.when(F.col("_label") == "authentic", 1.0).when(F.col("_label") == "inauthentic", -1.0))
    delta = F.coalesce(sign * (F.col("_confidence") - 0.5) * scale / 100, F.lit(0.0))
    moved = joined.withColumn("_moved", sign.isNotNull()).withColumns({f"score_{d}": clamp(F.col(f"score_{d}") + delta) for d in DIMENSIONS})
    final = F.when(F.col("_moved"), clamp(total() + F.col("base") - F.col("_before"), 0.0, 100.0)).otherwise(F.col("base"))
    out = moved.withColumns({"final": final, "class_label": F.coalesce("_label", "class_label")})
    return out.withColumn("is_authentic", F.col("class_label") == "authentic").drop("_label", "_confidence", "_before", "_moved")


def fallback_labels(scores: DataFrame) -> DataFrame:
    """Labels by final score where no external one is at hand: authentic from 75, suspect from 40; null counts as 0."""
    final = F.round(F.coalesce("final", F.lit(0.0)), 9)
    label = F.when(final >= 75, "authentic").when(final >= 40, "suspect").otherwise("inauthentic")
    return scores.select("content_id", label.alias("label"), F.when(label == "suspect", 0.6).otherwise(0.7).alias("confidence"))


def whois_signals(registry: DataFrame, as_of: Column) -> DataFrame:
    """Age, privacy, expiry and registrar scores of each domain and their weighted mean over those that are known."""
    days = F.datediff(as_of, "created")
    years = F.round(days / 365.25, 1)
    left = F.datediff(F.col("expires"), as_of)
    age = F.when(years >= 10, 10.0).when(years >= 5, 8.0).when(years >= 2, 6.0).when(years >= 1, 4.0).when(years >= 0.5, 3.0).when(years.isNotNull(), 2.0)
    privacy = F.when(F.col("private"), 4.0).when(F.coalesce("org", F.lit("")) != "", 8.0).otherwise(6.0)
    expiry = F.when(left < 0, 1.0).when(left < 30, 2.0).when(left < 90, 5.0).when(left < 365, 7.0).when(left.isNotNull(), 9.0)
    name = F.lower(F.coalesce("registrar", F.lit("")))
    registrar = F.when(reduce(lambda a, b: a | b, [name.contains(r) for r in REGISTRARS]), 8.0).when(name != "", 6.0)
    parts = [(age, 0.4), (privacy, 0.2), (expiry, 0.2), (registrar, 0.2)]
    total = reduce(add, [F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts])
    mean = reduce(add, [F.coalesce(p * w, F.lit(0.0)) for p, w in parts]) / total
    return registry.select("domain", years.alias("age_years"), age.alias("age_score"), privacy.alias("privacy_score"), expiry.alias("expiry_score"), registrar.alias("registrar_score"), F.bround(F.round(mean, 9), 1).alias("trust"))


def text_stats(content: DataFrame) -> DataFrame:
    """Passive sentences (the first five), weak words, reading ease and grade by a vowel-group estimate of syllables, and seconds of reading at 14.69 ms a character."""
    body = F.coalesce("body", F.lit(""))
    sentences = F.filter(F.transform(F.split(body, "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c"))), lambda s: s != "")
    low = F.lower(body)
    weak = F.filter(F.array(*map(F.lit, WEAK)), lambda w: low.contains(F.concat(F.lit(" "), w, F.lit(" "))))
    words = F.greatest(F.regexp_count(body, F.lit(r"(?U)\w+")), F.lit(1))
    n = F.greatest(F.size(sentences), F.lit(1))
    syllables = F.greatest(F.regexp_count(low, F.lit(r"(?U)[aeiouyáàâäãéèêëíìîïóòôöõúùûü]+")), F.lit(1))
    return content.select(
        "content_id", F.slice(F.filter(sentences, lambda s: s.rlike(PASSIVE)), 1, 5).alias("passive"), weak.alias("weak_words"),
        (206.835 - 1.015 * words / n - 84.6 * syllables / words).alias("reading_ease"), (0.39 * words / n + 11.8 * syllables / words - 15.59).alias("grade"),
        F.round(F.length(F.regexp_replace(body, r"(?U)\s+", "")) * 14.69 / 1000, 2).alias("reading_time"),
    )


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of chunks; an end moves back to behind a sentence's end, by 200 characters at most."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            end = next((i + 1 for i in range(end, max(start, end - 200), -1) if text[i] in ".!?\n"), end)
        out.append((start, min(end, len(text))))
        start = end - overlap if end < len(text) else end
    return out


def chunk_documents(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_no, start, end and text of overlapping chunks; each cut depends on the one before, so it is made in Python by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                kept = [(s, e, part) for s, e in chunk_bounds(text or "", size, overlap) if (part := (text or "")[s:e].strip())]
                rows += [{"doc_id": doc, "chunk_no": k, "start": s, "end": e, "text": part} for k, (s, e, part) in enumerate(kept)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk_no int, start int, end int, text string")
