"""Normalisation of content rows: cleaning, dedup, length bounds, gates and triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentgauge.functions import text as T

MAX_LENGTH, MIN_LENGTH = 10_000, 10


def clean_content(df: DataFrame) -> DataFrame:
    """title and body cleaned; rows with neither go. A filter on cleaned columns would be pushed below them and clean each text twice, so the rows come out of an explode."""
    cleaned = F.struct(T.clean_text(F.col("title")).alias("title"), T.clean_text(F.col("body")).alias("body"))
    kept = F.filter(F.array(cleaned), lambda c: (c["title"] != "") | (c["body"] != ""))
    rows = df.select("*", F.explode_outer(kept).alias("_cleaned")).where("_cleaned is not null")
    return rows.withColumns({"title": F.col("_cleaned.title"), "body": F.col("_cleaned.body")}).drop("_cleaned")


def engagement():
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return value("rating") * 10 + value("upvotes") + value("helpful_count") * 2


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", T.fingerprint(T.text_of("title"), T.text_of("body")))


def with_length(df: DataFrame) -> DataFrame:
    """n_text, the characters of title and body; validate_length takes it where the texts are left behind."""
    return df.withColumn("n_text", F.length(T.text_of("title")) + F.length(T.text_of("body")))


def dedup_content(df: DataFrame, order_col: str = "seq") -> DataFrame:
    """The row of most engagement of each fingerprint, the first seen of equals.

    A fingerprint's best row is an aggregate with map-side minima, so one that very many rows share is reduced where
    they are; the narrow table of best rows meets the content again by fingerprint and order. Rows with equal order
    and fingerprint all stay. Both sides need the fingerprint, so where df is costly to make, a written table of it with
    its fingerprint (with_fingerprint) is better.
    """
    keyed = df if "fingerprint" in df.columns else with_fingerprint(df)
    best = F.struct((-engagement()).alias("e"), F.col(order_col).alias("o"))
    first = keyed.groupBy("fingerprint").agg(F.min(best).alias("best")).select("fingerprint", F.col("best.o").alias(order_col))
    return keyed.join(first.hint("shuffle_hash"), ["fingerprint", order_col], "left_semi")


def validate_length(df: DataFrame, most: int = MAX_LENGTH, least: int = MIN_LENGTH) -> DataFrame:
    sized = df if "n_text" in df.columns else with_length(df)
    kept = sized.filter(F.col("n_text").between(least, most))
    return kept.select(*df.columns)


def normalization_stats(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    a = before.groupBy(*by).agg(F.count("*").alias("original_count"))
    b = after.groupBy(*by).agg(F.count("*").alias("final_count"))
    n = F.coalesce("final_count", F.lit(0)).cast("bigint")
    joined = a.join(b, by, "left").withColumn("final_count", n)
    return joined.withColumn("removed_count", F.col("original_count") - F.col("final_count")).withColumn("retention_rate", F.col("final_count") / F.col("original_count"))


def with_skip_reason(df: DataFrame) -> DataFrame:
    """Too little content is no reason where there is a screenshot to judge."""
    reason = T.skip_reason(F.col("title"), F.col("body"))
    if "screenshot_path" in df.columns:
        reason = F.when((reason == "insufficient_content") & F.col("screenshot_path").isNotNull(), None).otherwise(reason)
    return df.withColumn("skip_reason", reason)


def with_language(df: DataFrame) -> DataFrame:
    """language, its name, and whether the text is in another one than English; text without a language is not."""
    lang = df.withColumn("language", T.language(F.col("body")))
    return lang.withColumns({"language_name": T.language_name(F.col("language")), "non_english": ~F.col("language").isin("en", "unknown")})


def with_triage(df: DataFrame) -> DataFrame:
    return df.withColumn("triage", T.triage(F.col("title"), F.col("body"))).select("*", "triage.*").drop("triage")


def triage_split(df: DataFrame, keywords: list[str], promote: float = 0.6) -> DataFrame:
    scored = df.withColumn("triage_score", T.triage_score(F.col("title"), F.col("body"), keywords))
    return scored.withColumn("promoted", F.round("triage_score", 9) >= promote)


def filter_keywords(df: DataFrame, keywords: list[str]) -> DataFrame:
    low = F.lower(F.concat(T.text_of("title"), F.lit(" "), T.text_of("body")))
    return df.filter(T.has_any(low, [k.lower() for k in keywords]))


def reuse_recent(assets: DataFrame, runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Assets with content of a brand's runs that started within the hours before as_of and did not fail."""
    fresh = runs.filter((F.col("started_at") >= F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("status") != "failed"))
    return assets.filter(F.coalesce(F.trim("raw_content"), F.lit("")) != "").join(fresh.select("run_id", "brand_id"), "run_id")


def reused_by_query(reused: DataFrame) -> DataFrame:
    """Assets that are used again, by the query they were found with; those of no query don't count."""
    return reused.filter(F.coalesce("query", F.lit("")) != "").groupBy("query").agg(F.count("*").alias("reused"))


def exclude_known(candidates: DataFrame, reused: DataFrame) -> DataFrame:
    """Candidates whose url no reused asset has; candidates without a url stay, repeated ones too."""
    return candidates.join(reused.filter("url <> ''").select("url").distinct().hint("shuffle_hash"), "url", "left_anti")


def remaining_quota(queries: DataFrame, reused: DataFrame, limit: int) -> DataFrame:
    """What each query may still collect; queries with nothing left are dropped."""
    have = reused.groupBy("query").agg(F.count("*").alias("have"))
    left = F.greatest(F.lit(0), F.lit(limit) - F.coalesce("have", F.lit(0))).cast("bigint")
    return queries.join(have, "query", "left").select("query", left.alias("remaining")).filter("remaining > 0")


def summarize(content: DataFrame, sentences: int = 2, most: int = 240) -> DataFrame:
    """summary of each content row: its description if that has 30 characters, else the cleaned text if short, else its weightiest different sentences in their order.

    A sentence weighs the sum over its different words of 1 / sqrt(frequency), times a tenth of its words, at most 1.5.
    A null or empty body gives the empty summary; a null description is none. Nothing is shuffled.
    """
    df = content.withColumn("_clean", T.without_interface(F.coalesce("body", F.lit(""))))
    split = F.transform(F.split("_clean", r"(?<=[.!?])(?U:\s+)"), F.trim)
    df = df.withColumn("_parts", F.when(F.length("_clean") > most, F.filter(split, lambda s: F.length(s) > 10)).otherwise(F.array().cast("array<string>")))
    words = F.transform("_parts", lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"(?U)(\w+)"), 1))
    rare = lambda ws: F.aggregate(F.array_distinct(ws), F.lit(0.0), lambda acc, w: acc + 1 / F.sqrt(F.size(F.filter(ws, lambda x: x == w))))
    weights = F.transform(words, lambda ws: F.round(rare(ws) * F.least(F.lit(1.5), F.size(ws) / 10), 6))
    order = F.array_sort(F.transform(F.arrays_zip("_parts", weights.alias("w")), lambda z, i: F.struct((-z["w"]).alias("w"), i.alias("i"), z["_parts"].alias("s"))))
    df = df.withColumn("_top", F.transform(F.slice(order, 1, 3 * sentences), lambda r: r["s"]))
    # columns that a lambda needs are used outside of it too, so that they are made once and not once for each element
    df = df.withColumn("_chosen", F.slice(F.filter("_top", lambda s, i: ~F.exists(F.slice("_top", F.lit(1), i), lambda x: F.lower(x) == F.lower(s))), 1, sentences))
    picked = F.when(F.size("_chosen") > 0, F.filter("_parts", lambda s: F.array_contains("_chosen", s)))
    df = df.withColumn("_long", F.when(F.size("_parts") == 0, F.col("_clean")).when(F.size("_parts") <= sentences, F.array_join("_parts", " ")).otherwise(F.array_join(F.slice(picked, 1, sentences), " ")))
    described = F.trim(F.coalesce("description", F.lit("")))
    short = F.when(F.length(described) >= 30, T.shortened(described, most)).when(F.length("_clean") <= most, F.col("_clean")).otherwise(T.shortened(F.col("_long"), most))
    return df.withColumn("summary", F.when(F.coalesce("body", F.lit("")) == "", "").otherwise(short)).drop("_clean", "_parts", "_top", "_chosen", "_long")
