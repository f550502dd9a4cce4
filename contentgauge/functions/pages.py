"""Page metadata by native expressions: title, canonical url, OpenGraph, meta tags, JSON-LD, dates, links, visuals, channel, modality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentgauge.functions.urls import any_part, location

# fixed values: channels by parts of a host, in order, with their kind of platform
CHANNELS = [
    ("youtube", ["youtube.com", "youtu.be"], "social"), ("reddit", ["reddit.com"], "social"), ("instagram", ["instagram.com"], "social"), ("tiktok", ["tiktok.com"], "social"),
    ("facebook", ["facebook.com", "fb.com"], "social"), ("twitter", ["twitter.com", "x.com"], "social"), ("amazon", ["amazon.com", "amazon.co.uk", "amazon.de"], "marketplace"),
    ("etsy", ["etsy.com"], "marketplace"), ("ebay", ["ebay.com"], "marketplace"),
]
# fixed values: parts of urls by modality
VIDEO = [".mp4", ".webm", ".mov", ".avi", ".mkv", "youtube.com", "youtu.be", "vimeo.com"]
IMAGE = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg"]
AUDIO = [".mp3", ".wav", ".ogg", ".m4a", "spotify.com", "soundcloud.com"]
DATED = ["Article", "NewsArticle", "BlogPosting", "Report", "ScholarlyArticle", "TechArticle"]


def channel(url: Column, src: Column) -> Column:
    """channel and platform_type."""
    host = F.replace(location(F.coalesce(url, F.lit(""))), F.lit("www."), F.lit(""))
    hint = F.coalesce(src, F.lit(""))
    guess = F.when(any_part(host, ["shop", "store", "buy", "cart"]), "marketplace").when(any_part(host, ["social", "community", "forum"]), "social").otherwise("owned")
    other = F.when(hint != "", F.struct(hint.alias("channel"), guess.alias("platform_type"))).otherwise(F.struct(F.substring_index(host, ".", 1).alias("channel"), F.lit("owned").alias("platform_type")))
    known = reduce(lambda rest, c: F.when(any_part(host, c[1]), F.struct(F.lit(c[0]).alias("channel"), F.lit(c[2]).alias("platform_type"))).otherwise(rest), CHANNELS[::-1], other)
    return F.when(F.coalesce(url, F.lit("")) == "", F.struct(F.when(hint != "", hint).otherwise("unknown").alias("channel"), F.lit("unknown").alias("platform_type"))).otherwise(known)


def modality(url: Column, src: Column, content_type: Column, html: Column) -> Column:
    low, kind = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    og = F.lower(F.coalesce(F.try_element_at(open_graph(html), F.lit("og_type")), F.lit("")))
    by = lambda x: F.when(x.contains("video"), "video").when(x.contains("image"), "image").when(x.contains("audio"), "audio")
    post = F.when(any_part(low, IMAGE[:5]), "image").when(any_part(low, VIDEO[:3]), "video").otherwise("text")
    rest = F.coalesce(F.when(any_part(low, VIDEO), "video").when(any_part(low, IMAGE), "image").when(any_part(low, AUDIO), "audio"), by(kind), by(og), F.lit("text"))
    return F.when(src == "youtube", "video").when(src == "reddit", post).when(src == "amazon", "text").otherwise(rest)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value from the text of a tag; empty if there is none."""
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|[^\s"'>]+)""", 1)


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)(<{name}\b[^>]*>)"), 1)


def title(html: Column) -> Column:
    """The title, else that of OpenGraph or a card."""
    own = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    named = lambda key: F.try_element_at(F.filter(F.transform(tags(html, "meta"), lambda t: F.when(F.lower(t).contains(key), attribute(t, "content"))), lambda x: x.isNotNull() & (x != "")), F.lit(1))
    return F.coalesce(F.when(own != "", own), named("og:title"), named("twitter:title"), F.lit(""))


def canonical(html: Column) -> Column:
    links = F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    return F.coalesce(attribute(F.try_element_at(links, F.lit(1)), "href"), F.lit(""))


def _pairs(html: Column, key: str, prefix: str, keep) -> Column:
    pair = lambda t: F.struct(F.lower(attribute(t, key)).alias("k"), attribute(t, "content").alias("v"))
    rows = F.filter(F.transform(tags(html, "meta"), pair), lambda p: keep(p["k"]) & (p["v"] != ""))
    named = F.transform(rows, lambda p: F.struct(F.concat(F.lit(prefix), F.regexp_replace(p["k"], "^og:", "")).alias("k"), p["v"].alias("v")))
    # the last of a name counts
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(F.transform(named, lambda q: q["k"]), i + 2, F.size(named)), lambda k: k == p["k"]))
    return F.map_from_entries(last)


def open_graph(html: Column) -> Column:
    """og_<name> to content, for names with content."""
    return _pairs(html, "property", "og_", lambda k: k.startswith("og:"))


def meta_tags(html: Column) -> Column:
    return _pairs(html, "name", "", lambda k: k.isin("description", "keywords", "author", "robots"))


def json_ld(html: Column) -> Column:
    """Valid JSON-LD blocks as text."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), 1)
    return F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())


def flat_json_ld(value: Column) -> Column:
    """The objects of a JSON-LD variant: lists, @graph and json_ld are opened, four deep; what is no object is left out."""

    def opened(x):
        inside = lambda key: F.coalesce(F.try_variant_get(x, f"$['{key}']", "array<variant>"), F.when(F.try_variant_get(x, f"$['{key}']", "variant").isNotNull(), F.array(F.try_variant_get(x, f"$['{key}']", "variant"))))
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), inside("@graph"), inside("json_ld"), F.array(x))

    items = F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<variant>"))
    for _ in range(4):
        items = F.flatten(F.transform(items, opened))
    return F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def names_in(schema: Column, key: str) -> Column:
    """Names that the objects of a JSON-LD text give under key: a text, an object with a name, or the first of a list of these."""
    objects = flat_json_ld(F.try_parse_json(schema))

    def name(o):
        text = lambda at: F.when(F.schema_of_variant(F.try_variant_get(o, at, "variant")) == "STRING", F.try_variant_get(o, at, "string"))
        return F.coalesce(text(f"$.{key}"), text(f"$.{key}.name"), text(f"$.{key}[0]"), text(f"$.{key}[0].name"))

    return F.filter(F.transform(objects, name), lambda x: F.coalesce(x, F.lit("")) != "")


def author_kinds(schema: Column) -> Column:
    """@type of every author that the objects of a JSON-LD text have, or of their creators where there is no author."""
    part = lambda o, at: F.try_variant_get(o, at, "variant")
    kind = lambda v: F.schema_of_variant(v)
    given = lambda v: F.when(v.isNotNull() & ~kind(v).isin("VOID", "ARRAY<VOID>") & (F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")) != ""), v)
    writer = lambda o: F.coalesce(given(part(o, "$.author")), given(part(o, "$.creator")))
    each = lambda v: F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    named = lambda v: F.when(kind(part(v, "$['@type']")) == "STRING", F.try_variant_get(v, "$['@type']", "string"))
    writers = F.filter(F.transform(flat_json_ld(F.try_parse_json(schema)), writer), lambda v: v.isNotNull())
    return F.transform(F.flatten(F.transform(writers, each)), named)


def microdata_types(html: Column) -> Column:
    """itemtype of every element that has one."""
    marked = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<[a-z][^>]*\bitemtype\s*=[^>]*>)"), 1)
    return F.transform(marked, lambda t: attribute(t, "itemtype"))


def has_rdfa(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).rlike(r"(?is)<[a-z][^>]*\btypeof\s*=")


def manifest(html: Column) -> Column:
    """Where the page's content credentials are: a c2pa-manifest or cai-manifest link, a meta tag, a script's source or inline_blob for its text; else null."""
    first = lambda name, key, value, held: F.try_element_at(F.filter(F.transform(tags(html, name), lambda t: F.when(F.lower(attribute(t, key)) == value, attribute(t, held))), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1))
    script = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<script[^>]*application/c2pa-manifest\+json[^>]*>(.*?)</script>""", 1)
    inline = F.when(F.trim(script) != "", "inline_blob")
    return F.coalesce(first("link", "rel", "c2pa-manifest", "href"), first("link", "rel", "cai-manifest", "href"), first("meta", "name", "c2pa-manifest", "content"), first("script", "type", "application/c2pa-manifest+json", "src"), inline)


def published(html: Column) -> Column:
    """Publication date: article:published_time, JSON-LD of an article, itemprop, meta names, og:updated_time."""
    value = lambda key, wanted: F.try_element_at(F.filter(F.transform(tags(html, "meta"), lambda t: F.when(F.lower(attribute(t, key)).isin(wanted), attribute(t, "content"))), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1))
    dated = F.filter(json_ld(html), lambda b: F.get_json_object(b, "$['@type']").isin(DATED))
    schema = F.try_element_at(F.transform(dated, lambda b: F.coalesce(F.get_json_object(b, "$.datePublished"), F.get_json_object(b, "$.dateCreated"))), F.lit(1))
    item = value("itemprop", ["datepublished"])
    return F.coalesce(value("property", ["article:published_time"]), schema, item, value("name", ["date", "publishdate", "pubdate", "publish-date", "dc.date"]), value("property", ["og:updated_time"]))


def has_visuals(html: Column) -> Column:
    """A large image that is no logo or icon, an image named hero or banner, a video, or an embedded player."""
    decor = "(?i)logo|icon|avatar|user|brand|footer|nav|social"
    side = lambda t, n: F.coalesce(F.regexp_extract(attribute(t, n), r"^(\d+)(?:px)?$", 1).try_cast("int"), F.lit(0))

    def counts(t):
        name = F.concat(attribute(t, "class"), attribute(t, "id"))
        large = ((side(t, "width") > 250) | (side(t, "height") > 250)) & ~F.concat(name, attribute(t, "src"), attribute(t, "alt")).rlike(decor)
        hero = name.rlike("(?i)hero|banner|featured|cover|main-image|post-image") & ~name.rlike(decor)
        return ~F.lower(attribute(t, "class")).rlike("tracking|pixel") & (large | hero)

    players = F.exists(tags(html, "iframe"), lambda t: F.lower(attribute(t, "src")).rlike("youtube|vimeo"))
    return F.exists(tags(html, "img"), counts) | (F.size(tags(html, "video")) > 0) | players


def anchors(html: Column) -> Column:
    """href and text of every link, in page order."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), 1)
    return F.transform(blocks, lambda a: F.struct(attribute(F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1), "href").alias("href"), F.trim(F.regexp_replace(a, "(?s)<[^>]*>", "")).alias("label")))


def region(html: Column, tag: str) -> Column:
    """The text of the page's last element of a name, without tags."""
    last = F.try_element_at(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1), F.lit(-1))
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(last, F.lit("")), "(?s)<[^>]*>", " "), r"(?U)\s+", " "))


def footer_fingerprint(html: Column) -> Column:
    """MD5 of the footer's text without white space, if it has more than 50 characters."""
    bare = F.regexp_replace(region(html, "footer"), r"(?U)\s", "")
    return F.when(F.length(bare) > 50, F.md5(bare))
