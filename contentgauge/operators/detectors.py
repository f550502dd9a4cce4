"""The attribute detection job: content rows to long rows of detected attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgauge.functions import detect as D

_WHITE = " \t\n\r\x0b\x0c"
BY_DIMENSION = {"provenance": D.provenance, "resonance": D.resonance, "coherence": D.coherence, "transparency": D.transparency, "verification": D.verification}
OPTIONAL = {"discovery": D.discovery}


def _words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_WHITE))


def with_text(df: DataFrame) -> DataFrame:
    """Lower-cased text once for all detectors: _body, _main (the page's main text, else the body), _low (body and title), _margin (footer and header), _url; columns that are not there are null."""
    part = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    meta = {} if "meta" in df.columns else {"meta": F.create_map().cast("map<string,string>")}
    kinds = {"url": "string", "author": "string", "platform_type": "string", "source_type": "string", "upvotes": "int", "rating": "double", "helpful_count": "double"}
    more = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in df.columns}
    return df.withColumns(meta | more).withColumns(
        {"_url": F.lower(F.coalesce("url", F.lit(""))), "_body": F.lower(part("body")), "_main": F.lower(F.coalesce(F.nullif(part("main_text"), F.lit("")), part("body"))), "_low": F.lower(F.concat(part("body"), F.lit(" "), part("title"))), "_margin": F.lower(F.concat(part("footer_text"), F.lit(" "), part("header_text")))}
    )


def with_sentences(df: DataFrame) -> DataFrame:
    """_counts: sorted words per sentence, or null for text that is short or looks like a list or navigation."""
    body = F.coalesce("body", F.lit(""))
    lines_of = lambda x: F.transform(F.split(x, "\n"), _strip)
    some = lambda xs: F.filter(xs, lambda x: x != "")
    df = df.withColumn("_sentences", some(F.transform(F.split(body, r"(?U)(?<=[.!?])\s+"), _strip))).withColumn("_lines", F.filter(lines_of(body), lambda x: F.length(x) > 10)).withColumn("_n", _words(body))
    # a long sentence over several lines is a list
    parts = F.flatten(F.transform("_sentences", lambda s: F.when((_words(s) > 50) & s.contains("\n"), some(lines_of(s))).otherwise(F.array(s))))
    df = df.withColumn("_parts", F.filter(parts, lambda s: (_words(s) >= 5) | s.rlike("[.!?]$")))
    line_words = F.transform("_lines", _words)
    mean = F.try_divide(F.aggregate(line_words, F.lit(0), lambda a, x: a + x), F.size("_lines"))
    few = (F.size("_parts") < 3) & (F.col("_n") > 100)
    df = df.withColumn("_list", few & (F.size("_lines") > 3) & (mean < 10)).withColumn("_parts", F.when(few & (F.size("_lines") > F.size("_parts")), F.col("_lines")).otherwise(F.col("_parts")))
    breaks = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    skip = (F.length(body) < 50) | F.coalesce("_list", F.lit(False)) | ((F.size("_parts") <= 1) & (F.col("_n") > 20) & (breaks > F.col("_n") / 10)) | (F.size("_parts") == 0)
    return df.withColumn("_counts", F.when(~skip, F.array_sort(F.transform("_parts", _words)))).drop("_sentences", "_lines", "_n", "_parts", "_list")


def detect_attributes(content: DataFrame, keys: list[str], enabled: list[str] | None = None, dimensions: tuple[str, ...] = tuple(BY_DIMENSION)) -> DataFrame:
    """A row for each content row (keys) and attribute found: attribute_id, dimension, value (1 to 10), confidence, status.

    content has body, title, src, modality, channel and, where known, url, meta, platform_type, source_type, upvotes,
    rating, helpful_count, footer_text and header_text. Rules are columns of one projection over text lower-cased and searched once; nothing is shuffled.
    """
    df = with_text(content).withColumns(D.marks())
    if "resonance" in dimensions:
        df = with_sentences(df)
    found = F.array_compact(F.concat(*[F.array(*(BY_DIMENSION | OPTIONAL)[d]()) for d in dimensions]))
    rows = df.select(*keys, F.explode(found).alias("a")).select(*keys, "a.*")
    return rows.filter(F.col("attribute_id").isin(enabled)) if enabled is not None else rows


# fixed values: what the urls of a site's global pages hold
GLOBAL_PAGES = {
    "about": ["/about", "/our-story", "/team", "/founders"],
    "contact": ["/contact", "/support", "/help"],
    "policies": ["/privacy", "/terms", "/legal", "/standards", "/editorial"],
}
# fixed values: phrases of a site's AI disclosure, and words of pages about its people, which are case-sensitive
SITE_AI = ["ai-generated", "artificial intelligence", "generated by ai", "assisted by ai"]
PEOPLE = ["Team", "Founders", "Our Story"]


def site_signals(assets: DataFrame, keys: list[str]) -> DataFrame:
    """For each site whether its about or policy pages disclose AI, whether its about pages speak of people, and how many global pages it has.

    A page counts once for each kind it belongs to. Assets without url or text tell nothing; repeated rows count again.
    """
    url, text = F.lower(F.coalesce("url", F.lit(""))), F.coalesce("body", F.lit(""))
    kind = {k: D.contains_any(url, parts) for k, parts in GLOBAL_PAGES.items()}
    return assets.groupBy(*keys).agg(
        F.bool_or((kind["about"] | kind["policies"]) & D.contains_any(F.lower(text), SITE_AI)).alias("has_global_ai_disclosure"),
        F.bool_or(kind["about"] & D.contains_any(text, PEOPLE)).alias("has_global_author_info"), F.sum(sum(k.cast("int") for k in kind.values())).alias("global_pages"),
    )
