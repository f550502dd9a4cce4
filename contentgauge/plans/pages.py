"""Queries of the page extraction operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import pages as P
from contentgauge.operators import pages as O
from contentgauge.operators import urls as U
from contentgauge.sources.tables import table


def b_extract_pages(spark, sf_dir):
    """Title, channel, modality, canonical url and counts of every page."""
    f = O.extract_pages(table(spark, sf_dir, "pages"))
    return f.select("page_id", "title", "channel", "platform_type", "modality", "canonical", F.size("og").alias("n_og"), F.size("tags").alias("n_tags"), "json_ld_blocks", "has_visuals", "footer_text")


#: Links added to the end of the footers of pages, by page_id % 5.
LINKS = [
    '<a href="/privacy">Our rules</a><a href="../terms.html?x=1#a">T</a>', '<a href="https://other.example/p">Cookies here</a><a href="sub/./x">X</a>', '<a href="//cdn.example/t">Conditions of use</a><a href="#top">Up</a>',
    '<a href="javascript:void(0)">J</a><a href="/search?q=1">S</a><a href="?p=2">Next</a>', '<a href="mailto:a@b.example">Terms by mail</a><a href="https://other.example/privacy">P</a>',
]


def linked_pages(spark, sf_dir):
    added = F.element_at(F.array(*map(F.lit, LINKS)), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("</footer>"), F.concat(added, F.lit("</footer>"))))


def b12_policy_links(spark, sf_dir):
    return O.policy_links(linked_pages(spark, sf_dir)).drop("links")


def b13_page_links(spark, sf_dir):
    return U.internal_links(O.page_links(linked_pages(spark, sf_dir)), 100).select("page_id", "target", "rank")


#: Markup added to the end of the heads of pages, by page_id % 8, each with what must be found: canonical, n_og, n_tags, json_ld_blocks, published_at, has_visuals, manifest, microdata, rdfa.
MARKUP = [
    ('<link rel="canonical" href="https://c.example/a"><meta property="og:type" content="article"><meta property="og:title" content="T"><meta property="og:image" content="">', ("https://c.example/a", 2, 0, 0, None, False, None, "", False)),
    ('<meta name="description" content="D"><meta name="Author" content="A"><meta name="robots" content="noindex"><meta name="viewport" content="v"><meta property="article:published_time" content="2020-01-02">', ("", 0, 3, 0, "2020-01-02", False, None, "", False)),
    ('<script type="application/ld+json">{"@type":"Article","datePublished":"2021-03-04"}</script><script type="application/ld+json">{bad</script>', ("", 0, 0, 1, "2021-03-04", False, None, "", False)),
    ('<link rel="c2pa-manifest" href="/m.c2pa"><link rel="cai-manifest" href="/no"><div itemscope itemtype="https://s.example/Product"></div><p itemtype="https://s.example/Offer">', ("", 0, 0, 0, None, False, "/m.c2pa", "https://s.example/Product,https://s.example/Offer", False)),
    ('<link rel="cai-manifest" href="/m.cai"><span typeof="schema:Person"></span><meta property="og:updated_time" content="2022-05-06">', ("", 1, 0, 0, "2022-05-06", False, "/m.cai", "", True)),
    ('<meta name="c2pa-manifest" content="m5"><img src="/x.jpg" width="800">', ("", 0, 0, 0, None, True, "m5", "", False)),
    ('<script type="application/c2pa-manifest+json">{"a":1}</script><img src="/logo.png" width="800" class="logo"><img src="/h.jpg" class="hero">', ("", 0, 0, 0, None, True, "inline_blob", "", False)),
    ('<script type="application/c2pa-manifest+json" src="/m7"></script><img src="/p.gif" class="tracking" width="900">', ("", 0, 0, 0, None, False, "/m7", "", False)),
]


def marked_pages(spark, sf_dir):
    added = F.element_at(F.array(*[F.lit(m) for m, _ in MARKUP]), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("</head>"), F.concat(added, F.lit("</head>"))))


def b3_markup(spark, sf_dir):
    """Structured data, canonical url, OpenGraph, meta tags, dates, manifests and visuals of pages that have them."""
    f = O.extract_pages(marked_pages(spark, sf_dir))
    return f.select("page_id", "canonical", F.size("og").alias("n_og"), F.size("tags").alias("n_tags"), "json_ld_blocks", "published_at", "has_visuals", F.col("c2pa_manifest").alias("manifest"), F.array_join("microdata_types", ",").alias("microdata"), F.col("has_rdfa").alias("rdfa"))


def b11_enrich(spark, sf_dir):
    """Content rows for every page, some without title, body or url, with the page's features."""
    marked = marked_pages(spark, sf_dir).withColumn("url", F.concat("url", F.lit("#"), "page_id"))
    features = O.extract_pages(marked).withColumn("main_text", F.concat(F.lit("Text of "), "page_id"))
    n = F.col("page_id")
    content = marked.select("page_id", F.when(n % 3 > 0, F.col("url")).alias("url"), F.when(n % 5 == 0, "Own").otherwise("").alias("title"), F.when(n % 7 == 0, "Own text").otherwise(" ").alias("body"), F.when(n % 2 == 0, F.create_map(F.lit("canonical"), F.lit("mine"))).alias("meta"))
    rows = O.enrich(content, features)
    return rows.select("page_id", "title", "body", F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("meta"))


def b15_footers(spark, sf_dir):
    return O.footer_seen(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (b_extract_pages, b12_policy_links, b13_page_links, b15_footers, b3_markup, b11_enrich)}

_q = lambda s: "'" + s + "'"
_part = lambda x, xs: "(" + " OR ".join(f"contains({x}, {_q(s)})" for s in xs) + ")"
_HOST = r"replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'www.', '')"
_CHANNEL = "CASE " + " ".join(f"WHEN {_part('host', d)} THEN '{c}'" for c, d, _ in P.CHANNELS) + " ELSE split_part(host, '.', 1) END"
_KIND = "CASE " + " ".join(f"WHEN {_part('host', d)} THEN '{k}'" for _, d, k in P.CHANNELS) + " ELSE 'owned' END"
_MODALITY = f"CASE WHEN {_part('lower(url)', P.VIDEO)} THEN 'video' WHEN {_part('lower(url)', P.IMAGE)} THEN 'image' WHEN {_part('lower(url)', P.AUDIO)} THEN 'audio' ELSE 'text' END"
_FOOTER = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<footer\b[^>]*>(.*?)</footer>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_ANCHORS = r"""a AS (SELECT page_id, url, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS a FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS x FROM pages)),
l AS (SELECT page_id, url, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS label FROM a)"""
def _pick(k: int) -> str:
    """What is expected in the k-th place, by page_id % 8."""
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {one(want[k])}" for i, (_, want) in enumerate(MARKUP)) + " END"


_ORIGIN, _PATH = "regexp_extract(url, '^([^:]*://[^/?#]*)', 1)", "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_DIR = f"coalesce(nullif(regexp_replace({_PATH}, '[^/]*$', ''), ''), '/')"
ORACLES = {
    "b_extract_pages": rf"""WITH p AS (SELECT *, {_HOST} AS host FROM pages) SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, {_CHANNEL} AS channel, {_KIND} AS platform_type,
 {_MODALITY} AS modality, '' AS canonical, 0 AS n_og, 0 AS n_tags, 0 AS json_ld_blocks, false AS has_visuals, {_FOOTER} AS footer_text FROM p""",
    # what each kind of link comes to, seen from the page; the pages' own links begin with a slash
    "b12_policy_links": rf"""WITH p AS (SELECT page_id, {_ORIGIN} AS origin, {_DIR} AS dir, split_part(url, '://', 1) AS scheme FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN origin || regexp_replace(dir, '[^/]+/$', '') || 'terms.html?x=1#a' WHEN 2 THEN scheme || '://cdn.example/t' WHEN 4 THEN 'mailto:a@b.example' ELSE '' END AS terms,
 CASE page_id % 5 WHEN 0 THEN origin || '/privacy' WHEN 1 THEN 'https://other.example/p' WHEN 4 THEN 'https://other.example/privacy' ELSE '' END AS privacy FROM p""",
    "b13_page_links": rf"""WITH {_ANCHORS}, t AS (SELECT page_id, {_ORIGIN} || href AS target, min(pos) AS pos FROM l WHERE starts_with(href, '/') GROUP BY ALL),
m AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN {_ORIGIN} || regexp_replace({_DIR}, '[^/]+/$', '') || 'terms.html?x=1#a' WHEN 1 THEN {_ORIGIN} || {_DIR} || 'sub/x' WHEN 3 THEN {_ORIGIN} || {_PATH} || '?p=2' END AS target, 1000000 AS pos FROM pages),
z AS (SELECT * FROM t UNION ALL SELECT * FROM m WHERE target IS NOT NULL AND page_id % 5 > 0)
SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM z QUALIFY rank <= 100""",
    "b3_markup": "SELECT page_id, " + ", ".join(f"{_pick(k)} AS {name}" for k, name in enumerate(("canonical", "n_og", "n_tags", "json_ld_blocks", "published_at", "has_visuals", "manifest", "microdata", "rdfa"))) + " FROM pages",
    "b11_enrich": r"""WITH p AS (SELECT page_id, page_id % 8 AS k, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages),
m AS (SELECT *, CASE WHEN page_id % 3 > 0 THEN CASE k WHEN 0 THEN ['og_title=T', 'og_type=article'] WHEN 1 THEN ['author=A', 'description=D', 'published_at=2020-01-02', 'robots=noindex'] WHEN 2 THEN ['published_at=2021-03-04'] WHEN 3 THEN ['c2pa_manifest=/m.c2pa', 'has_c2pa_manifest=true']
 WHEN 4 THEN ['c2pa_manifest=/m.cai', 'has_c2pa_manifest=true', 'og_updated_time=2022-05-06', 'published_at=2022-05-06'] WHEN 5 THEN ['c2pa_manifest=m5', 'has_c2pa_manifest=true', 'has_significant_visuals=true']
 WHEN 6 THEN ['c2pa_manifest=inline_blob', 'has_c2pa_manifest=true', 'has_significant_visuals=true'] ELSE ['c2pa_manifest=/m7', 'has_c2pa_manifest=true'] END ELSE [] END AS got FROM p)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Own' WHEN page_id % 3 > 0 THEN t END AS title, CASE WHEN page_id % 7 = 0 THEN 'Own text' WHEN page_id % 3 > 0 THEN 'Text of ' || page_id END AS body,
 array_to_string(list_sort(list_concat(got, CASE WHEN page_id % 2 = 0 THEN ['canonical=mine'] WHEN page_id % 3 > 0 AND k = 0 THEN ['canonical=https://c.example/a'] ELSE [] END)), ';') AS meta FROM m""",
    "b15_footers": rf"""WITH f AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_replace({_FOOTER}, '\s', '', 'g') AS t FROM pages), h AS (SELECT page_id, host, md5(t) AS footer FROM f WHERE length(t) > 50)
SELECT page_id, host, footer, page_id > min(page_id) OVER (PARTITION BY host, footer) AS seen_before FROM h""",
}
