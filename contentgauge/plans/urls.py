"""Queries of the URL operators over the pages table, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import urls as U
from contentgauge.operators import urls as O
from contentgauge.sources.tables import table

# brand, domains, subdomains, handles
BRANDS = [
    ("brand_0", ["example.com", "shop.example.org"], ["blog.tionsh.example.net"], ["@brandzero"]),
    ("brand_1", ["casino-win.com"], ["blog.thertion.example.org"], ["brandone"]),
    ("brand_2", ["unknown.co.uk"], [], []),
]


def brands(spark):
    return spark.createDataFrame(BRANDS, "brand_id string, brand_domains array<string>, brand_subdomains array<string>, brand_handles array<string>")


#: Urls in place of those of the pages whose id leaves so much of 20, with the id in them, and whether they are login pages.
VARIED = [
    (0, "https://login.example.com/in/", "", True), (1, "https://www.example.org/x/sign-in/", "", True), (2, "https://shop.example.com/x/", "/account.aspx", True), (3, "https://www.brand0.com/p/", "?action=login", True),
    (4, "https://www.brand1.com/p/", "?next=%2Fhome", True), (5, "https://brand2.com/", "#/register", True), (6, "https://unknown.co.uk/about-us/", "?id=4#team", False), (7, "https://www.unknown.co.uk/deals/", "", False),
    (8, "https://nytimes.com/a/", "", False), (9, "https://twitter.com/@brandzero/", "", False), (10, "https://brand1.com.au/stories/", "", False), (11, "https://g2.com/r/", "", False),
    (12, "https://gartner.com:8080/", "", False), (13, "https://blog.example.com/", "", False),
]


def urls(spark, sf_dir, varied=False):
    p = table(spark, sf_dir, "pages")
    if varied:
        other = F.lit(None).cast("string")
        for k, before, after, _ in VARIED:
            other = F.when(F.col("page_id") % 20 == k, F.concat(F.lit(before), F.col("page_id"), F.lit(after))).otherwise(other)
        # some titles of error pages, and some pages without much text
        title = F.when(F.col("page_id") % 17 == 3, "<title>401 Unauthorised").when(F.col("page_id") % 17 == 5, "<title>Entry denied").when(F.col("page_id") % 17 == 7, "<title>Access Denied").otherwise(F.col("html"))
        p = p.withColumns({"url": F.coalesce(other, F.col("url")), "html": F.when(F.col("page_id") % 17 == 9, F.substring("html", 1, 100)).otherwise(F.when(title == F.col("html"), title).otherwise(F.concat(title, F.col("html"))))})
    title = F.coalesce(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(""))
    return p.select(F.col("page_id"), "url", F.concat(F.lit("brand_"), (F.col("page_id") % 3).cast("string")).alias("brand_id"), title.alias("title"), F.length("html").alias("body_length"))


def _q(x: str) -> str:
    return "'" + x + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]::VARCHAR[]"


_LOC = r"lower(regexp_extract(url, '://([^/?#]*)', 1))"
_HOST = rf"regexp_replace(regexp_replace({_LOC}, '^.*@', ''), ':[0-9]*$', '')"
_PATH = r"regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_start = lambda x, xs: "(" + " OR ".join(f"starts_with({x}, {_q(s)})" for s in xs) + ")"
_end = lambda x, xs: "(" + " OR ".join(f"ends_with({x}, {_q(s)})" for s in xs) + ")"
_part = lambda x, xs: "(" + " OR ".join(f"contains({x}, {_q(s)})" for s in xs) + ")"
_in = lambda x, xs: f"{x} IN ({', '.join(map(_q, xs))})"
_LABEL = lambda d: f"split_part(replace({d}, 'www.', ''), '.', 1)"

URLS_SQL = f"""u AS (SELECT page_id, url, 'brand_' || page_id % 3 AS brand_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, length(html) AS body_length, {_HOST} AS host, {_PATH} AS path,
 string_split({_LOC}, '.') AS labels FROM pages),
k AS (SELECT *, CASE WHEN len(labels) >= 3 AND length(labels[-1]) = 2 AND {_in('labels[-2]', U.SECOND_LEVEL)} THEN 3 ELSE least(len(labels), 2) END AS keep FROM u),
parts AS (SELECT *, array_to_string(labels[len(labels) - keep + 1:], '.') AS domain, array_to_string(labels[1:len(labels) - keep], '.') AS subdomain FROM k)"""
_PAGES = "(SELECT page_id, CASE page_id % 20 " + " ".join(f"WHEN {k} THEN '{a}' || page_id || '{b}'" for k, a, b, _ in VARIED) + """ ELSE url END AS url,
 CASE page_id % 17 WHEN 3 THEN '<title>401 Unauthorised' || html WHEN 5 THEN '<title>Entry denied' || html WHEN 7 THEN '<title>Access Denied' || html WHEN 9 THEN substr(html, 1, 100) ELSE html END AS html FROM pages)"""
VARIED_SQL = URLS_SQL.replace("FROM pages", f"FROM {_PAGES}")
BRAND_SQL = "brand AS (" + " UNION ALL ".join(f"SELECT {_q(b)} AS brand_id, {_list(d)} AS domains, {_list(s)} AS subs, {_list(h)} AS handles" for b, d, s, h in BRANDS) + ")"
CLASSIFIED_SQL = f"""WITH {VARIED_SQL}, {BRAND_SQL},
o AS (SELECT *, list_contains(domains, domain) OR list_contains(subs, CASE WHEN subdomain = '' THEN domain ELSE subdomain || '.' || domain END)
 OR list_contains(list_transform(domains, lambda d: {_LABEL('d')}), {_LABEL('domain')})
 OR (subdomain <> '' AND len(list_filter(subs, lambda s: len(string_split(s, '.')) >= 3 AND split_part(s, '.', 1) = subdomain AND {_LABEL("regexp_replace(s, '^[^.]*[.]', '')")} = {_LABEL('domain')})) > 0) AS owned,
 domain = 'twitter.com' AND brand_id = 'brand_0' AND starts_with(path, '/@brandzero/') AS official FROM parts JOIN brand USING (brand_id)),
c AS (SELECT *, CASE WHEN owned OR official THEN 'brand_owned' ELSE 'third_party' END AS source_type,
 CASE WHEN owned THEN CASE WHEN subdomain IN ('', 'www') AND (path IN ('', '/') OR {_start('path', ['/about', '/products'])}) THEN 'primary_website' WHEN {_in('subdomain', U.HUB)} OR {_start('path', U.HUB_PATHS)} THEN 'content_hub'
  WHEN {_in('subdomain', U.SHOP)} OR {_start('path', U.SHOP_PATHS)} THEN 'direct_to_consumer' ELSE 'primary_website' END
 WHEN official THEN 'brand_social' WHEN {_in('domain', U.KNOWN['social'])} THEN 'user_generated' WHEN {_in('domain', U.KNOWN['news_media'])} THEN 'news_media' WHEN {_in('domain', U.KNOWN['review'])} THEN 'user_generated'
 WHEN {_in('domain', U.KNOWN['marketplace'])} THEN 'marketplace' WHEN {_in('domain', U.KNOWN['expert'])} OR {_end('domain', ['.edu', '.gov', '.org'])} THEN 'expert_professional' ELSE 'user_generated' END AS tier FROM o)"""
_LOGIN = "page_id % 20 IN (" + ", ".join(str(k) for k, _, _, login in VARIED if login) + ")"
_PROMO = f"({_start('lower(path)', U.PROMOTIONAL)} OR {_part('lower(path)', U.PROMOTIONAL_WORDS)})"


def c1_domain_parts(spark, sf_dir):
    return O.with_domain_parts(urls(spark, sf_dir)).select("page_id", "domain", "subdomain", "path")


def _classified(spark, sf_dir):
    return O.classify_urls(urls(spark, sf_dir, True), brands(spark))


def c2_classify_urls(spark, sf_dir):
    return _classified(spark, sf_dir).select("page_id", "source_type", "tier")


def c3_enforce_ratio(spark, sf_dir):
    return O.enforce_ratio(_classified(spark, sf_dir), ["brand_id"], "page_id", 25).select("brand_id", "page_id", "source_type", "place")


def c4_collect_quota(spark, sf_dir):
    return O.collect_quota(_classified(spark, sf_dir), ["brand_id"], "page_id", 20).select("brand_id", "page_id", "reason")


def c3_ratio_stats(spark, sf_dir):
    """What the ratio took of each brand's pools, once with small and once with large targets."""
    c = _classified(spark, sf_dir)
    some = lambda n: O.ratio_stats(c, O.enforce_ratio(c, ["brand_id"], "page_id", n), ["brand_id"], n).withColumn("n", F.lit(n))
    found = some(25).unionByName(some(90))
    return found.withColumns({c: F.round(c, 9) for c in ("owned_share", "third_share")})


def c4_quota_counts(spark, sf_dir):
    return O.quota_counts(O.collect_quota(_classified(spark, sf_dir), ["brand_id"], "page_id", 20, 0.8), ["brand_id"])


def c5_login_pages(spark, sf_dir):
    return urls(spark, sf_dir, True).select("page_id", U.is_login(F.col("url")).alias("login"))


def c6_brand_pages(spark, sf_dir):
    u = urls(spark, sf_dir, True).join(F.broadcast(brands(spark)), "brand_id")
    return u.select("page_id", U.brand_page_kind(F.col("url"), F.col("brand_id"), F.col("brand_domains")).alias("kind"), U.is_core_domain(F.col("url"), F.col("brand_domains")).alias("core"))


def c7_locale(spark, sf_dir):
    h = U.host(F.col("url"))
    return urls(spark, sf_dir).select("page_id", U.any_end(h, U.ENGLISH_SUFFIXES).alias("english"), U.any_end(h, U.USA_SUFFIXES).alias("usa"))


def c7_main_urls(spark, sf_dir):
    return O.main_urls(urls(spark, sf_dir), "page_id")


def c8_promotional(spark, sf_dir):
    return O.promo_quota(urls(spark, sf_dir, True), ["brand_id"], 40)


def c11_brand_owned(spark, sf_dir):
    """Ownership of urls of brands of which some have no domains."""
    bare = brands(spark).withColumn("brand_domains", F.when(F.col("brand_id") == "brand_1", F.array().cast("array<string>")).otherwise(F.col("brand_domains"))).withColumn("brand_id", F.replace("brand_id", F.lit("_"), F.lit("")))
    u = urls(spark, sf_dir, True).withColumn("brand_id", F.replace("brand_id", F.lit("_"), F.lit("")))
    return O.detect_brand_owned(u, bare).filter("brand_id = 'brand1'").select("page_id", "source_type", "tier")


def c12_assemble(spark, sf_dir):
    return O.assemble_urls(urls(spark, sf_dir, True), brands(spark), "page_id")


def c12_strategies(spark, sf_dir):
    """The same with either strategy."""
    some = lambda s: O.assemble_urls(urls(spark, sf_dir, True), brands(spark), "page_id", s).withColumn("strategy", F.lit(s))
    return some("brand_controlled").unionByName(some("third_party")).select("strategy", "brand_id", "url", "rank")


def c15_subpages(spark, sf_dir):
    u = urls(spark, sf_dir)
    return O.add_primary_subpages(u, O.main_urls(u, "page_id"))


QUERIES = {f.__name__: f for f in (c1_domain_parts, c2_classify_urls, c3_enforce_ratio, c3_ratio_stats, c4_collect_quota, c4_quota_counts, c5_login_pages, c6_brand_pages, c7_locale, c7_main_urls, c8_promotional, c11_brand_owned, c12_assemble, c12_strategies, c15_subpages)}

_BARE = "regexp_replace(host, '^www[.]', '')"
_CORE = f"len(list_filter(domains, lambda d: d = {_BARE} OR (len(string_split(d, '.')) >= 2 AND len(string_split({_BARE}, '.')) IN (2, 3) AND split_part(d, '.', 1) = split_part({_BARE}, '.', 1)))) > 0"
_MAIN = f"""main AS (SELECT brand_id, arg_min(url, page_id) FILTER (WHERE ends_with(host, '.com') AND (contains(host, regexp_replace(brand_id, '[^a-z0-9]', '', 'g')) OR starts_with(host, 'www.'))) AS main_url,
 bool_or({_end('host', [s for s in U.ENGLISH_SUFFIXES if s != '.com'])}) AS abroad FROM u GROUP BY brand_id)"""
# classified first-seen urls, and the configured sites that are not among them
ASSEMBLED_SQL = CLASSIFIED_SQL + f""", f AS (SELECT brand_id, url, min(page_id) AS seen FROM c WHERE NOT {_LOGIN} GROUP BY ALL), j AS (SELECT DISTINCT brand_id, url, seen, {_CORE} AS core, source_type, tier FROM f JOIN c USING (brand_id, url)),
named AS (SELECT DISTINCT brand_id, domains, 'https://' || unnest(list_concat(domains, subs)) AS url FROM brand), sites AS (SELECT brand_id, url, CAST(NULL AS BIGINT) AS seen, {_CORE.replace("regexp_replace(host, '^www[.]', '')", "regexp_replace(url[9:], '^www[.]', '')")} AS core, 'brand_owned' AS source_type, 'primary_website' AS tier FROM named),
x AS (SELECT * FROM sites ANTI JOIN j USING (brand_id, url))"""
ORACLES = {
    "c3_ratio_stats": CLASSIFIED_SQL + """, a AS (SELECT brand_id, count(*) AS total_available, count(*) FILTER (WHERE source_type = 'brand_owned') AS owned_available, count(*) FILTER (WHERE source_type <> 'brand_owned') AS third_available FROM c GROUP BY ALL),
t(n, target_owned, target_third) AS (VALUES (25, 15, 10), (90, 54, 36)), z AS (SELECT *, least(owned_available, target_owned) AS owned_taken, least(third_available, target_third) AS third_taken FROM a, t)
SELECT *, owned_taken + third_taken AS total_taken, round(owned_taken / (owned_taken + third_taken), 9) AS owned_share, round(third_taken / (owned_taken + third_taken), 9) AS third_share FROM z""",
    # no bound on hosts; of the pools' 16 and 4
    "c4_quota_counts": CLASSIFIED_SQL + """, a AS (SELECT *, CASE WHEN body_length < CASE source_type WHEN 'brand_owned' THEN 75 ELSE 200 END THEN 'thin' WHEN regexp_matches(lower(title), '401|403|404|access denied|error|forbidden|not found') THEN 'error' END AS bad FROM c),
b AS (SELECT *, count(*) FILTER (WHERE bad IS NULL) OVER (PARTITION BY brand_id, source_type ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM a)
SELECT brand_id, CASE WHEN taken >= CASE source_type WHEN 'brand_owned' THEN 16 ELSE 4 END THEN coalesce(bad, 'pool_cap') ELSE coalesce(bad, 'kept') END AS reason, count(*) AS n FROM b GROUP BY ALL""",
    "c1_domain_parts": f"WITH {URLS_SQL} SELECT page_id, domain, subdomain, path FROM parts",
    "c2_classify_urls": CLASSIFIED_SQL + " SELECT page_id, source_type, tier FROM c",
    "c3_enforce_ratio": CLASSIFIED_SQL + " SELECT brand_id, page_id, source_type, row_number() OVER (PARTITION BY brand_id, source_type ORDER BY page_id) AS place FROM c QUALIFY place <= CASE source_type WHEN 'brand_owned' THEN 15 ELSE 10 END",
    "c4_collect_quota": CLASSIFIED_SQL + """,
a AS (SELECT *, CASE WHEN body_length < CASE source_type WHEN 'brand_owned' THEN 75 ELSE 200 END THEN 'thin' WHEN regexp_matches(lower(title), '401|403|404|access denied|error|forbidden|not found') THEN 'error' END AS bad,
 lower(regexp_extract(url, '://([^/?#]*)', 1)) AS place FROM c),
b AS (SELECT *, bad IS NULL AND count(*) FILTER (WHERE bad IS NULL) OVER (PARTITION BY brand_id, place ORDER BY page_id) <= 4 AS fit FROM a),
d AS (SELECT *, count(*) FILTER (WHERE fit) OVER (PARTITION BY brand_id, source_type ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM b)
SELECT brand_id, page_id, CASE WHEN bad IS NOT NULL THEN bad WHEN taken >= CASE source_type WHEN 'brand_owned' THEN 12 ELSE 8 END THEN 'pool_cap' WHEN NOT fit THEN 'domain_cap' ELSE 'kept' END AS reason FROM d""",
    "c5_login_pages": f"WITH {VARIED_SQL} SELECT page_id, {_LOGIN} AS login FROM u",
    "c6_brand_pages": f"WITH {VARIED_SQL}, {BRAND_SQL} SELECT page_id, CASE WHEN {_BARE} <> '' AND (list_contains(domains, {_BARE}) OR starts_with({_BARE} || '.', regexp_replace(brand_id, '[^a-z0-9]', '', 'g') || '.')) THEN 'primary' ELSE 'subdomain' END AS kind, {_CORE} AS core FROM u JOIN brand USING (brand_id)",
    "c7_locale": f"WITH {URLS_SQL} SELECT page_id, {_end('host', U.ENGLISH_SUFFIXES)} AS english, {_end('host', U.USA_SUFFIXES)} AS usa FROM u",
    "c7_main_urls": f"WITH {URLS_SQL}, {_MAIN} SELECT brand_id, main_url, abroad AND main_url IS NOT NULL AS has_variants FROM main",
    "c8_promotional": f"WITH {VARIED_SQL} SELECT brand_id, count(*) FILTER (WHERE {_PROMO}) AS promotional, 10 AS target, count(*) FILTER (WHERE {_PROMO}) >= 10 AS met FROM u GROUP BY brand_id",
    "c11_brand_owned": f"WITH {VARIED_SQL} SELECT page_id, CASE WHEN contains(host, 'brand1') THEN 'brand_owned' ELSE 'third_party' END AS source_type, CASE WHEN contains(host, 'brand1') THEN 'primary_website' ELSE 'user_generated' END AS tier FROM u WHERE page_id % 3 = 1",
    "c12_assemble": ASSEMBLED_SQL + " SELECT brand_id, url, seen, core, source_type, tier, row_number() OVER (PARTITION BY brand_id ORDER BY added, core DESC, source_type = 'brand_owned' DESC, url) AS rank FROM (SELECT *, 1 AS added FROM j UNION ALL SELECT *, 0 FROM x)".replace("added, core DESC", "added, CASE WHEN added = 1 THEN core END DESC"),
    "c12_strategies": ASSEMBLED_SQL + " SELECT strategy, brand_id, url, row_number() OVER (PARTITION BY strategy, brand_id ORDER BY added, CASE WHEN added = 1 THEN core END DESC, url) AS rank FROM (SELECT *, 1 AS added, CASE source_type WHEN 'brand_owned' THEN 'brand_controlled' ELSE 'third_party' END AS strategy FROM j UNION ALL SELECT x.*, 0, s FROM x, (VALUES ('brand_controlled')) AS t(s)"
    " UNION ALL SELECT *, 0, 'third_party' FROM (SELECT * FROM sites EXCEPT SELECT * REPLACE (CAST(NULL AS BIGINT) AS seen, core AS core, 'brand_owned' AS source_type, 'primary_website' AS tier) FROM j WHERE source_type <> 'brand_owned'))",
    "c15_subpages": f"WITH {URLS_SQL}, {_MAIN}, m AS (SELECT brand_id, regexp_extract(main_url, '^([^:]*://[^/?#]*)', 1) || unnest({_list(U.PROMOTIONAL)}) AS url FROM main WHERE main_url IS NOT NULL) SELECT brand_id, url FROM m WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.brand_id = m.brand_id AND u.url = m.url)",
}
