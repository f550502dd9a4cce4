"""URL operators: classification against brand configuration, quotas, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentgauge.functions import urls as U
from contentgauge.sources.stage import numbered, written


def with_domain_parts(df: DataFrame) -> DataFrame:
    return df.withColumn("_p", U.domain_parts(F.col("url"))).select("*", "_p.*").drop("_p")


def _owned(domain: Column, subdomain: Column) -> Column:
    """An exact domain or subdomain, the label of a brand domain, or the same subdomain under a brand's label."""
    full = F.when(subdomain == "", domain).otherwise(F.concat_ws(".", subdomain, domain))
    label = U.brand_label(domain)
    behind = lambda s: F.regexp_replace(s, r"^[^.]*\.", "")
    below = F.exists("brand_subdomains", lambda s: (F.size(F.split(s, r"\.")) >= 3) & (F.substring_index(s, ".", 1) == subdomain) & (U.brand_label(behind(s)) == label))
    return F.array_contains("brand_domains", domain) | F.array_contains("brand_subdomains", full) | F.exists("brand_domains", lambda d: U.brand_label(d) == label) | ((subdomain != "") & below)


def classify_urls(urls: DataFrame, brands: DataFrame) -> DataFrame:
    """source_type and tier of each url of a brand; brands is small and broadcast."""
    df = with_domain_parts(urls).join(F.broadcast(brands), "brand_id")
    d, s, p = F.col("domain"), F.col("subdomain"), F.col("path")
    front = s.isin("", "www") & (p.isin("", "/") | U.any_start(p, ["/about", "/products"]))
    hub = s.isin(U.HUB) | U.any_start(p, U.HUB_PATHS)
    shop = s.isin(U.SHOP) | U.any_start(p, U.SHOP_PATHS)
    own_tier = F.when(front, "primary_website").when(hub, "content_hub").when(shop, "direct_to_consumer").otherwise("primary_website")
    handle = F.lower(F.regexp_replace(F.coalesce(F.try_element_at(F.filter(F.split(p, "/"), lambda x: x != ""), F.lit(1)), F.lit("")), "^@+", ""))
    social = d.isin(U.KNOWN["social"])
    official = social & (handle != "") & F.exists("brand_handles", lambda h: F.lower(F.regexp_replace(h, "^@+", "")) == handle)
    other = (
        F.when(social, "user_generated").when(d.isin(U.KNOWN["news_media"]), "news_media").when(d.isin(U.KNOWN["review"]), "user_generated").when(d.isin(U.KNOWN["marketplace"]), "marketplace")
        .when(d.isin(U.KNOWN["expert"]) | U.any_end(d, [".edu", ".gov", ".org"]), "expert_professional").otherwise("user_generated")
    )
    owned = F.coalesce(_owned(d, s), F.lit(False))
    tier = F.when(owned, own_tier).when(official, "brand_social").otherwise(other)
    return df.withColumn("source_type", F.when(owned | official, "brand_owned").otherwise("third_party")).withColumn("tier", tier)


def targets(n: int, owned_ratio: float, third_ratio: float) -> tuple[int, int]:
    """Whole-number targets; what rounding leaves goes to the larger pool, of equals to the owned one."""
    owned, third = int(n * owned_ratio), int(n * third_ratio)
    left = max(0, n - owned - third)
    return (owned + left, third) if owned_ratio >= third_ratio else (owned, third + left)


def enforce_ratio(classified: DataFrame, keys: list[str], order_col: str, n: int, owned_ratio: float = 0.6, third_ratio: float = 0.4) -> DataFrame:
    """The first of each pool in order up to the pool's target."""
    owned, third = targets(n, owned_ratio, third_ratio)
    place = F.row_number().over(Window.partitionBy(*keys, "source_type").orderBy(order_col))
    limit = F.when(F.col("source_type") == "brand_owned", owned).otherwise(third)
    return classified.withColumn("place", place).filter(F.col("place") <= max(owned, third)).filter(F.col("place") <= limit)


def ratio_stats(classified: DataFrame, enforced: DataFrame, keys: list[str], n: int, owned_ratio: float = 0.6, third_ratio: float = 0.4) -> DataFrame:
    """For each key what there was, what was aimed at and what was taken of either pool, and the shares of what was taken (0 without any)."""
    owned, third = targets(n, owned_ratio, third_ratio)
    count = lambda df, tail: df.groupBy(*keys).agg(F.count("*").alias(f"total_{tail}"), F.count_if(F.col("source_type") == "brand_owned").alias(f"owned_{tail}"), F.count_if(F.col("source_type") != "brand_owned").alias(f"third_{tail}"))
    both = count(classified, "available").join(count(enforced, "taken").hint("shuffle_hash"), keys, "left").na.fill(0)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total_taken")), F.lit(0.0))
    return both.withColumns({"target_owned": F.lit(owned), "target_third": F.lit(third), "owned_share": share("owned_taken"), "third_share": share("third_taken")})


# fixed values: words of the titles of error pages
ERROR_TITLES = ["access denied", "forbidden", "403", "401", "error", "not found", "404"]


def collect_quota(classified: DataFrame, keys: list[str], order_col: str, n: int, owned_ratio: float = 0.6, min_owned: int = 75, min_third: int = 200) -> DataFrame:
    """reason for every candidate: thin, error, pool_cap, domain_cap or kept, in the order of the candidates, of equals by url.

    A pool takes candidates up to its target; while it is open, a host and port may fill a fifth of n (no bound if the
    owned share is 0.8 or more). A null title is no error page, a null length is thin. What decides is the place of the
    last good candidate that a host, and then a pool, has room for: Spark keeps a bound's length of rows of each key
    before it shuffles them, so no brand, pool or host is gathered in one task.
    """
    owned, third = targets(n, owned_ratio, round(1 - owned_ratio, 9))
    least = F.when(F.col("source_type") == "brand_owned", min_owned).otherwise(min_third)
    error = U.any_part(F.lower(F.coalesce("title", F.lit(""))), ERROR_TITLES)
    df = classified.withColumn("_bad", F.when(F.coalesce("body_length", F.lit(0)) < least, "thin").when(error, "error")).withColumns({"_host": U.location(F.col("url")), "_place": F.struct(order_col, "url")})
    cap = max(1, int(0.2 * n)) if owned_ratio < 0.8 else n
    good = df.filter("_bad is null").select(*keys, "source_type", "_host", "_place")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*keys, *by).orderBy("_place"))
    fit = good.withColumn("_k", rank("_host")).filter(F.col("_k") <= cap)
    full_host = fit.filter(F.col("_k") == cap).select(*keys, "_host", F.col("_place").alias("_host_end"))
    first = fit.select(*keys, "source_type", "_place").withColumn("_k", rank("source_type")).filter(F.col("_k") <= max(owned, third))
    limit = F.when(F.col("source_type") == "brand_owned", owned).otherwise(third)
    full_pool = first.filter(F.col("_k") == limit).select(*keys, "source_type", F.col("_place").alias("_pool_end"))  # two rows for each of the few keys
    rows = df.join(full_host.hint("shuffle_hash"), [*keys, "_host"], "left").join(F.broadcast(full_pool), [*keys, "source_type"], "left")
    closed = F.coalesce(F.col("_place") > F.col("_pool_end"), F.lit(False)) | (limit == 0)
    reason = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(closed, "pool_cap").when(F.col("_place") > F.col("_host_end"), "domain_cap").otherwise("kept")
    return rows.select(*classified.columns, reason.alias("reason"))


def quota_counts(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of each key and reason."""
    return judged.groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def promo_quota(urls: DataFrame, keys: list[str], n: int) -> DataFrame:
    target = max(1, int(0.25 * n + 0.999))
    counts = urls.groupBy(*keys).agg(F.count_if(U.is_promotional(F.col("url"))).alias("promotional"))
    return counts.withColumn("target", F.lit(target)).withColumn("met", F.col("promotional") >= target)


def main_urls(urls: DataFrame, order_col: str) -> DataFrame:
    """The first .com url of each brand whose host holds the brand's slug or begins with www., and whether the brand has hosts of other countries."""
    h = U.host(F.col("url"))
    fits = h.endswith(".com") & (((U.slug(F.col("brand_id")) != "") & h.contains(U.slug(F.col("brand_id")))) | h.startswith("www."))
    abroad = [s for s in U.ENGLISH_SUFFIXES if s != ".com"]
    hosts = urls.withColumn("_host", h).withColumn("_fits", fits)
    first = hosts.groupBy("brand_id").agg(F.min_by("url", F.when(F.col("_fits"), F.col(order_col))).alias("main_url"), F.bool_or(U.any_end(F.col("_host"), abroad)).alias("abroad"))
    return first.withColumn("has_variants", F.col("abroad") & F.col("main_url").isNotNull()).drop("abroad")


def add_primary_subpages(urls: DataFrame, mains: DataFrame) -> DataFrame:
    """Promotional sub-pages of each main url that are not among the brand's urls yet."""
    made = mains.filter("main_url is not null").select("brand_id", F.explode(F.array(*[F.concat(F.regexp_extract("main_url", r"^([^:]*://[^/?#]*)", 1), F.lit(p)) for p in U.PROMOTIONAL])).alias("url"))
    return made.join(urls.select("brand_id", "url").hint("shuffle_hash"), ["brand_id", "url"], "left_anti")


def assemble_urls(results: DataFrame, brands: DataFrame, order_col: str, strategy: str = "both") -> DataFrame:
    """First-seen urls that are no login pages, classified, core domains first, then owned ones, then by url; configured sites that are not among them on top, by url.

    strategy brand_controlled keeps owned urls, third_party the others; another keeps both. Sites are a brand's domains
    and subdomains, as https addresses unless they name their scheme; they are owned primary websites without seen.
    rank numbers a brand's urls; no brand is sorted in one task.
    """
    # written, as the rules on urls below name the url so often that it must be a column, not an expression
    first = written(results.groupBy("brand_id", "url").agg(F.min(order_col).alias("seen"))).filter(~U.is_login(F.col("url")))
    core = lambda df: df.withColumn("core", U.is_core_domain(F.col("url"), F.col("brand_domains")))
    wanted = {"brand_controlled": F.col("source_type") == "brand_owned", "third_party": F.col("source_type") != "brand_owned"}.get(strategy, F.lit(True))
    columns = ["brand_id", "url", "seen", "core", "source_type", "tier"]
    kept = written(core(classify_urls(first, brands)).filter(wanted).select(*columns, F.lit(1).alias("_added")))
    none = F.array().cast("array<string>")
    sites = F.concat(F.coalesce("brand_domains", none), F.coalesce("brand_subdomains", none))
    named = F.array_distinct(F.transform(sites, lambda d: F.when(F.trim(d).rlike("^https?://"), F.trim(d)).otherwise(F.concat(F.lit("https://"), F.trim(d)))))
    own = written(brands.select("brand_id", "brand_domains", F.explode(named).alias("url")))
    missing = core(own).join(kept.select("brand_id", "url").hint("shuffle_hash"), ["brand_id", "url"], "left_anti")
    added = missing.select("brand_id", "url", F.lit(None).cast(kept.schema["seen"].dataType).alias("seen"), "core", F.lit("brand_owned").alias("source_type"), F.lit("primary_website").alias("tier"), F.lit(0).alias("_added"))
    by_kind = [F.when(F.col("_added") == 0, 0).when(F.col("core"), 1).otherwise(2).alias("a"), ((F.col("_added") == 1) & (F.col("source_type") != "brand_owned")).alias("b")]
    return numbered(kept.unionByName(added), ["brand_id"], [*by_kind, "url"]).drop("_added")


# fixed values: parts of the paths of links that lead to no content
NO_CONTENT = ["/search", "/login", "/cart", "/checkout", "/account", "/privacy", "/terms", "/contact"]


def internal_links(links: DataFrame, k: int = 15) -> DataFrame:
    """Of links(page_id, page_url, pos, href): those to the page's own host that lead to content, absolute, distinct, the first k in order."""
    own = links.filter("href <> '' and href not like '#%' and href not like 'javascript:%'").withColumn("target", U.resolve(F.col("page_url"), F.col("href")))
    own = own.filter((U.location(F.col("target")) == U.location(F.col("page_url"))) & ~U.any_part(F.lower(U.path(F.col("target"))), NO_CONTENT))
    first = own.groupBy("page_id", "target").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("rank") <= k)


def detect_brand_owned(urls: DataFrame, brands: DataFrame) -> DataFrame:
    """source_type and tier as by classify_urls; of a brand without domains, owned is a url whose host holds the brand's id."""
    held = F.replace(U.location(F.col("url")), F.lit("www."), F.lit("")).contains(F.lower("brand_id"))
    bare = F.size(F.coalesce("brand_domains", F.array().cast("array<string>"))) <= 0
    df = classify_urls(urls, brands)
    return df.withColumns({"source_type": F.when(bare, F.when(held, "brand_owned").otherwise("third_party")).otherwise(F.col("source_type")), "tier": F.when(bare, F.when(held, "primary_website").otherwise("user_generated")).otherwise(F.col("tier"))})


def broken_links(content: DataFrame, status: DataFrame) -> DataFrame:
    """Distinct links of each text against a table of link status: broken from 400 on but for 403, or without an answer."""
    found = content.select("content_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(https?://[^\s<>\"')]+)"), 1))).alias("url"))
    joined = found.join(status.hint("shuffle_hash"), "url", "left")
    bad = (F.col("status") >= 400) & (F.col("status") != 403) | F.coalesce(F.col("failed"), F.lit(False))
    return joined.groupBy("content_id").agg(F.count("*").alias("links"), F.count_if(F.coalesce(bad, F.lit(False))).alias("broken"))
