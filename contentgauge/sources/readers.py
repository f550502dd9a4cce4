"""Source rows to content rows: assets, posts, reviews, videos with comments, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT = [
    ("content_id", "string"), ("src", "string"), ("platform_id", "string"), ("author", "string"), ("title", "string"), ("body", "string"), ("rating", "double"), ("upvotes", "int"),
    ("helpful_count", "double"), ("event_ts", "string"), ("run_id", "string"), ("brand_id", "string"), ("meta", "map<string,string>"), ("url", "string"), ("modality", "string"),
    ("channel", "string"), ("platform_type", "string"),
]
ASSETS = "id string, url string, title string, body string, html string, source_type string, channel string, meta map<string,string>"


def content_row(df: DataFrame, **columns: Column) -> DataFrame:
    """The content schema from named columns; run_id and brand_id pass through, the rest is null."""
    passed = {c: F.col(c) for c in ("run_id", "brand_id") if c in df.columns}
    made = passed | columns
    return df.select(*[made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in CONTENT])


def strings(**columns: Column) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.coalesce(c.cast("string"), F.lit("")))])


def read_assets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Collected assets from JSON, and those that have a url but no text yet and are to be fetched."""
    assets = spark.read.schema(ASSETS).option("multiLine", True).json(path)
    bare = (F.trim(F.coalesce("body", F.lit(""))) == "") & (F.coalesce("html", F.lit("")) == "")
    return assets.filter(~bare | F.col("url").isNull()), assets.filter(bare & F.col("url").isNotNull())


def from_reddit(df: DataFrame) -> DataFrame:
    link = F.concat(F.lit("https://www.reddit.com"), "permalink")
    kind = F.when(F.coalesce("selftext", F.lit("")) != "", "text").when(F.coalesce("url", F.lit("")) != "", "link").otherwise("title")
    return content_row(
        df, content_id=F.concat(F.lit("reddit_"), "id"), src=F.lit("reddit"), platform_id=F.col("id"), author=F.col("author"), title=F.col("title"), body=F.col("selftext"), rating=F.col("upvote_ratio"),
        upvotes=F.col("score"), event_ts=F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd'T'HH:mm:ss"), url=link, modality=F.lit("text"), channel=F.lit("reddit"), platform_type=F.lit("social"),
        meta=strings(subreddit=F.col("subreddit"), source_url=link, url=link, linked_url=F.col("url"), upvote_ratio=F.col("upvote_ratio"), num_comments=F.col("num_comments"), title=F.col("title"), content_type=kind),
    )


def from_amazon(df: DataFrame) -> DataFrame:
    return content_row(
        df, content_id=F.concat(F.lit("amazon_"), "review_id"), src=F.lit("amazon"), platform_id=F.col("review_id"), author=F.col("reviewer_name"), title=F.col("title"), body=F.col("content"),
        rating=F.col("rating"), helpful_count=F.col("helpful_count"), event_ts=F.col("review_date"), url=F.concat(F.lit("https://www.amazon.com/dp/"), "product_id"), modality=F.lit("text"),
        channel=F.lit("amazon"), platform_type=F.lit("marketplace"),
        meta=strings(product_id=F.col("product_id"), product_title=F.col("product_title"), product_brand=F.col("product_brand"), verified_purchase=F.col("verified_purchase"), review_date=F.col("review_date")),
    )


def from_youtube(df: DataFrame, include_comments: bool = False, k: int = 20) -> DataFrame:
    """A row for each video and, if asked for, for the first k of its comments."""
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id")
    same = dict(src=F.lit("youtube"), url=link, channel=F.lit("youtube"), platform_type=F.lit("social"))
    videos = content_row(
        df, content_id=F.concat(F.lit("youtube_video_"), "video_id"), platform_id=F.col("video_id"), author=F.col("channel_title"), title=F.col("title"), body=F.col("description"),
        event_ts=F.col("publish_time"), modality=F.lit("video"),
        meta=strings(source_url=link, url=link, channel_title=F.col("channel_title"), view_count=F.col("view_count"), like_count=F.col("like_count"), comment_count=F.col("comment_count"), content_type=F.lit("video")), **same,
    )
    if not include_comments:
        return videos
    rows = df.filter("comment_count > 0").withColumn("c", F.explode(F.slice("comments", 1, k)))
    comments = content_row(
        rows, content_id=F.concat(F.lit("youtube_comment_"), "c.comment_id"), platform_id=F.col("c.comment_id"), author=F.col("c.author"), title=F.lit(""), body=F.col("c.text"),
        upvotes=F.coalesce("c.like_count", F.lit(0)), event_ts=F.col("c.published_at"), modality=F.lit("text"),
        meta=strings(video_id=F.col("video_id"), video_title=F.col("title"), video_url=link, source_url=link, like_count=F.coalesce("c.like_count", F.lit(0)), content_type=F.lit("comment")), **same,
    )
    return videos.unionByName(comments)


def from_web(df: DataFrame) -> DataFrame:
    """Pages(url, title, body, and where known terms, privacy, brand_owned, badge) as content; badge is a map of what the page shows."""
    optional = [F.map_filter(strings(**{c: F.col(c)}), lambda _, v: v != "") for c in ("terms", "privacy") if c in df.columns]
    optional += [F.coalesce("badge", F.create_map().cast("map<string,string>"))] if "badge" in df.columns else []
    owned = F.coalesce(F.col("brand_owned").cast("string"), F.lit("false")) if "brand_owned" in df.columns else F.lit("false")
    meta = F.map_concat(strings(source_url=F.col("url"), description=F.substring("body", 1, 200), is_brand_owned=owned, content_type=F.lit("web")), *optional)
    return content_row(
        df, content_id=F.concat(F.lit("web_"), F.md5("url")), src=F.lit("web"), platform_id=F.col("url"), author=F.lit("web"), title=F.col("title"), body=F.col("body"), url=F.col("url"),
        modality=F.lit("text"), channel=F.lit("web"), platform_type=F.when(owned == "true", "owned").otherwise("web"), meta=meta,
    )


#: What a collected page says of its certificate and its legal links.
_PROPAGATED = ["ssl_valid", "ssl_issuer", "ssl_expiry_days", "ssl_error", "privacy", "terms"]


def from_collector(df: DataFrame) -> DataFrame:
    """Collected pages(query, url, title, body, and where known access_denied, page_meta and the certificate's and legal columns) as assets.

    meta_info has the query, the first 500 characters as description, whether access was denied, what the page's own
    metadata says (over the former), and certificate and legal links (over all); what is not known has no key.
    """
    known = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    present = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    own = strings(query=F.col("query"), source_url=F.col("url"), title=F.col("title"), description=F.substring(F.coalesce("body", F.lit("")), 1, 500), access_denied=F.coalesce(known("access_denied"), F.lit("false")))
    page = F.coalesce("page_meta", F.create_map().cast("map<string,string>")) if "page_meta" in df.columns else F.create_map().cast("map<string,string>")
    told = F.create_map(*[x for c in _PROPAGATED for x in (F.lit(c), known(c))])
    over = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
    return df.select(F.lit("brave").alias("source_type"), F.lit("web").alias("channel"), "url", "title", F.col("body").alias("raw_content"), F.col("body").alias("normalized_content"), present(over(over(own, page), told)).alias("meta_info"))
