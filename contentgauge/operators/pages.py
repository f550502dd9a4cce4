"""The page extraction job and what is joined to content from it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgauge.functions import pages as P
from contentgauge.functions import urls as U
from contentgauge.functions.urls import host


def extract_pages(pages: DataFrame) -> DataFrame:
    """Metadata of every page; one row each, nothing shuffled."""
    h, u = F.col("html"), F.col("url")
    return pages.select(
        "page_id", "url", P.title(h).alias("title"), P.canonical(h).alias("canonical"), P.open_graph(h).alias("og"), P.meta_tags(h).alias("tags"), F.size(P.json_ld(h)).alias("json_ld_blocks"),
        P.published(h).alias("published_at"), P.has_visuals(h).alias("has_visuals"), P.manifest(h).alias("c2pa_manifest"), P.microdata_types(h).alias("microdata_types"), P.has_rdfa(h).alias("has_rdfa"), P.channel(u, F.lit(None).cast("string")).alias("c"),
        P.modality(u, F.lit(""), F.lit(""), h).alias("modality"), P.region(h, "footer").alias("footer_text"), P.region(h, "header").alias("header_text"),
    ).select("*", "c.*").drop("c")


def policy_links(pages: DataFrame) -> DataFrame:
    """The first terms and privacy link of each page, absolute: of its first footer if that has links, else of the whole page; empty without one."""
    h = F.col("html")
    inside = P.anchors(F.regexp_extract(F.coalesce(h, F.lit("")), r"(?is)<footer\b[^>]*>(.*?)</footer>", 1))
    linked = lambda xs: F.filter(xs, lambda a: a["href"] != "")
    some = F.when(F.size(linked(inside)) > 0, linked(inside)).otherwise(linked(P.anchors(h)))
    low = lambda a, part, words: F.lower(a["href"]).contains(part) | reduce(or_, [F.lower(a["label"]).contains(w) for w in words])
    first = lambda part, words: F.coalesce(U.resolve(F.col("url"), F.try_element_at(F.filter(F.col("_links"), lambda a: low(a, part, words)), F.lit(1))["href"]), F.lit(""))
    return pages.select("page_id", "url", some.alias("_links")).select("page_id", first("term", ["term", "conditions"]).alias("terms"), first("privacy", ["privacy", "cookie"]).alias("privacy"), F.size("_links").alias("links"))


def footer_seen(pages: DataFrame) -> DataFrame:
    """Whether a page's host has shown the same footer on a page before."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), P.footer_fingerprint(F.col("html")).alias("footer")).filter("footer is not null")
    first = rows.groupBy("host", "footer").agg(F.min("page_id").alias("first"))
    return rows.join(first.hint("shuffle_hash"), ["host", "footer"]).select("page_id", "host", "footer", (F.col("page_id") > F.col("first")).alias("seen_before"))


def page_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(P.anchors(F.col("html"))).alias("pos", "a")).select("page_id", "page_url", "pos", F.col("a.href").alias("href"), F.col("a.label").alias("label"))


def enrich(content: DataFrame, features: DataFrame) -> DataFrame:
    """Content rows with the features of their page by url.

    Empty titles and bodies take the page's title and main_text (null where features have none); meta gets the page's
    OpenGraph, tags, canonical url, publication date, manifest and visuals under keys it does not have yet. Of several
    pages with one url the first title counts. A null url has no page; repeated rows stay.
    """
    main = F.col("main_text") if "main_text" in features.columns else F.lit(None).cast("string")
    one = F.struct(F.col("title").alias("_title"), main.alias("_main"), "canonical", "og", "tags", "published_at", "c2pa_manifest", "has_visuals")
    pages = features.filter("url is not null").groupBy("url").agg(F.min_by(one, F.struct("title", "page_id")).alias("_page"))
    none = F.create_map().cast("map<string,string>")
    more = F.array(
        F.struct(F.lit("canonical").alias("k"), F.nullif("_page.canonical", F.lit("")).alias("v")), F.struct(F.lit("published_at").alias("k"), F.col("_page.published_at").alias("v")), F.struct(F.lit("c2pa_manifest").alias("k"), F.col("_page.c2pa_manifest").alias("v")),
        F.struct(F.lit("has_c2pa_manifest").alias("k"), F.when(F.col("_page.c2pa_manifest").isNotNull(), "true").alias("v")), F.struct(F.lit("has_significant_visuals").alias("k"), F.when(F.col("_page.has_visuals"), "true").alias("v")),
    )
    extra = F.map_concat(F.coalesce("_page.og", none), F.coalesce("_page.tags", none), F.map_from_entries(F.filter(more, lambda e: e["v"].isNotNull())))
    meta = F.map_zip_with(F.coalesce("meta", none), extra, lambda _, a, b: F.coalesce(a, b))
    filled = lambda c, other: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", other).otherwise(F.col(c))
    joined = content.join(pages.hint("shuffle_hash"), "url", "left")
    return joined.withColumns({"title": filled("title", F.col("_page._title")), "body": filled("body", F.col("_page._main")), "meta": meta}).drop("_page")
