"""Queries of the readers and sinks, with their SQL twins: the given tables as source rows; what a sink wrote is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgauge.sources import readers as R
from contentgauge.sources import writers as W
from contentgauge.sources.stage import shared_folder
from contentgauge.sources.tables import CONTENT_SQL, SCORES_SQL, contents, scores, table

ROW = ["content_id", "src", "platform_id", "author", "title", "body", "rating", "upvotes", "helpful_count", "event_ts", "url", "modality", "channel", "platform_type"]


def _shown(df):
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return df.select(*ROW, meta.alias("meta"))


def a1_assets(spark, sf_dir):
    """Pages as collected assets in JSON arrays of fifty; some have no text yet, some no url."""
    n = F.col("page_id")
    asset = F.struct(n.cast("string").alias("id"), F.when(n % 5 > 0, F.col("url")).alias("url"), F.when(n % 3 == 0, "text").when(n % 3 == 1, " ").alias("body"), F.when(n % 4 == 0, F.col("html")).alias("html"))
    out = shared_folder(spark, "assets")
    arrays = table(spark, sf_dir, "pages").groupBy(F.floor(n / 50).alias("batch")).agg(F.to_json(F.collect_list(asset)).alias("value"))
    arrays.write.partitionBy("batch").text(out)
    have, fetch = R.read_assets(spark, out)
    return have.select("id", F.lit("ready").alias("route")).unionByName(fetch.select("id", F.lit("fetch").alias("route")))


def a2_reddit(spark, sf_dir):
    """Conversation turns as posts."""
    c, n = table(spark, sf_dir, "conversations"), F.col("conv_id")
    posts = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("author"), F.concat(F.lit("Turn "), "turn").alias("title"), F.when(n % 3 == 0, F.col("text")).otherwise("").alias("selftext"), (n % 10 / 10.0).alias("upvote_ratio"),
        F.col("turn").alias("score"), (1_700_000_000 + n * 86_400).alias("created_utc"), F.when(n % 2 == 0, "http://l").alias("url"), F.concat(F.lit("/r/a/"), n).alias("permalink"), F.lit("a").alias("subreddit"), (n % 7).alias("num_comments"),
    )
    return _shown(R.from_reddit(posts))


def a3_amazon(spark, sf_dir):
    """Line items as reviews."""
    i = table(spark, sf_dir, "lineitem")
    reviews = i.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("review_id"), F.col("l_partkey").cast("string").alias("product_id"), F.lit("P").alias("product_title"), F.lit("B").alias("product_brand"), F.concat(F.lit("c"), "l_suppkey").alias("reviewer_name"),
        F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("content"), (F.col("l_orderkey") % 5 + 1).alias("rating"), (F.col("l_partkey") % 9).alias("helpful_count"), (F.col("l_suppkey") % 2 == 0).alias("verified_purchase"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("review_date"),
    )
    return _shown(R.from_amazon(reviews))


def a4_youtube(spark, sf_dir):
    """Documents as videos, every fourth with 25 comments, of which 20 count."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    comment = lambda k: F.struct(F.concat_ws("-", n, k).alias("comment_id"), F.concat(F.lit("u"), k).alias("author"), F.concat(F.lit("said "), k).alias("text"), F.when(k % 2 == 0, k).alias("like_count"), F.lit("2024-01-02").alias("published_at"))
    videos = d.select(
        n.cast("string").alias("video_id"), F.substring_index("text", "\n", 1).alias("title"), F.md5("text").alias("description"), F.col("source").alias("channel_title"), F.lit("2024-01-01").alias("publish_time"), (n % 100).alias("view_count"),
        (n % 10).alias("like_count"), F.when(n % 4 == 0, 25).otherwise(0).alias("comment_count"), F.transform(F.sequence(F.lit(0), F.lit(24)), comment).alias("comments"),
    )
    return _shown(R.from_youtube(videos, include_comments=True))


def a5_web(spark, sf_dir):
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("url", F.lit("T").alias("title"), F.col("html").alias("body"), F.when(n % 3 == 0, "http://terms").alias("terms"), F.when(n % 4 == 0, "http://privacy").otherwise("").alias("privacy"), (n % 2 == 0).alias("brand_owned"))
    return _shown(R.from_web(p)).withColumn("body", F.md5("body")).withColumn("meta", F.md5("meta"))


def _lake(spark, sf_dir) -> str:
    out = shared_folder(spark, "lake")
    W.write_content(contents(spark, sf_dir), out)
    W.write_scores(scores(spark, sf_dir), out)
    return out


def a6_write_content(spark, sf_dir):
    return spark.read.parquet(f"{_lake(spark, sf_dir)}/content").select("content_id", "brand_id", "src", "run_id", F.md5("body").alias("body"))


def a7_write_scores(spark, sf_dir):
    return spark.read.parquet(f"{_lake(spark, sf_dir)}/scores").select("content_id", "brand_id", "src", "run_id", "score_provenance", "score_resonance")


def a10_manifest(spark, sf_dir):
    out = _lake(spark, sf_dir)
    files = W.run_manifest(spark.read.parquet(f"{out}/content"), spark.read.parquet(f"{out}/scores"))
    return files.groupBy("table", "run_id", "brand_id", "src").agg(F.sum("n").alias("n"))


def _runs(spark, sf_dir):
    """Four runs of documents as assets; the brand of one is known."""
    c = contents(spark, sf_dir)
    runs = c.groupBy("run_id").agg(F.min("seq").alias("k")).select("run_id", F.concat(F.lit("brand_"), "k").alias("brand_id"), F.to_timestamp(F.concat(F.lit("2024-03-0"), F.col("k") + 1)).alias("started_at"))
    brands = c.filter("seq = 1").select("brand_id", F.concat(F.lit("slug-of-"), "brand_id").alias("slug"))
    return runs, c.select(F.col("content_id").alias("asset_id"), "run_id", F.col("channel").alias("source_type")), scores(spark, sf_dir).select(F.col("content_id").alias("asset_id"), "score_coherence"), brands


def a8_export_run(spark, sf_dir):
    runs, assets, rows, brands = _runs(spark, sf_dir)
    found = []
    for run in ("run_1", "run_2"):
        out = shared_folder(spark, "export")
        W.write_export(W.export_run(runs, assets, rows, brands, run), out)
        found.append(spark.read.parquet(f"{out}/scores").select("asset_id", "score_coherence", "brand_slug", F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0")).alias("day")))
    return found[0].unionByName(found[1])


def a9_export_raw(spark, sf_dir):
    _, assets, _, _ = _runs(spark, sf_dir)
    out = shared_folder(spark, "raw")
    W.export_raw(assets.withColumn("brand_slug", F.lit("b")), out)
    return spark.read.json(out).select("asset_id", "run_id", "source_type", "brand_slug")


def a11_prune(spark, sf_dir):
    """Orders as runs, line items as assets and as their scores: what a retention of a thousand days leaves of the scores."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    assets = i.select(F.col("l_orderkey").alias("run_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("asset_id"))
    as_of = F.to_timestamp(F.lit("2001-08-02"))
    kept, _ = W.prune_runs({"runs": runs, "assets": assets, "scores": assets.select("asset_id"), "summary": runs.select("run_id")}, as_of, 1000)
    return kept["scores"]


def a11_prune_written(spark, sf_dir):
    """The same on tables partitioned by the year of the run: rows deleted, and rows and years left of each table.

    Scores are made from the written assets and the summary from the written runs, so that line items meet orders once;
    no table is dealt by year, as a task writes one file for each of a few years.
    """
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    year = F.year("o_orderdate").alias("year")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), year)
    assets = i.join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("asset_id"), F.col("l_orderkey").alias("run_id"), year)
    out = shared_folder(spark, "lake")
    back = lambda name: spark.read.parquet(f"{out}/{name}")
    for name, df in {"runs": lambda: runs, "assets": lambda: assets, "scores": lambda: back("assets").drop("run_id"), "summary": lambda: back("runs").drop("started_at")}.items():
        df().write.partitionBy("year").parquet(f"{out}/{name}")
    names = ["runs", "assets", "scores", "summary"]
    counts = W.prune_written(spark, out, dict.fromkeys(names, ["year"]), F.to_timestamp(F.lit("2001-08-02")), 1000)
    left = lambda name: back(name).agg(F.count("*").alias("n_left"), F.count_distinct("year").alias("years")).select(F.lit(name).alias("table"), F.lit(counts[name]).cast("bigint").alias("deleted"), "n_left", "years")
    return reduce(DataFrame.unionByName, map(left, names))


QUERIES = {f.__name__: f for f in (a1_assets, a2_reddit, a3_amazon, a4_youtube, a5_web, a6_write_content, a7_write_scores, a8_export_run, a9_export_raw, a10_manifest, a11_prune, a11_prune_written)}

_NULL, _DOUBLE = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
_INT = "CAST(NULL AS INTEGER)"
_TUBE = "'youtube' AS src"
_LINK = "'https://www.youtube.com/watch?v=' || doc_id"
_DAY = "strftime(make_timestamp((1700000000 + conv_id * 86400) * 1000000), '%Y-%m-%dT%H:%M:%S')"
ORACLES = {
    "a1_assets": "SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 3 > 0 AND page_id % 4 > 0 AND page_id % 5 > 0 THEN 'fetch' ELSE 'ready' END AS route FROM pages",
    "a2_reddit": f"""WITH p AS (SELECT *, conv_id || '-' || turn AS id, 'https://www.reddit.com/r/a/' || conv_id AS link, CASE WHEN conv_id % 2 = 0 THEN 'http://l' ELSE '' END AS l FROM conversations)
SELECT 'reddit_' || id AS content_id, 'reddit' AS src, id AS platform_id, role AS author, 'Turn ' || turn AS title, CASE WHEN conv_id % 3 = 0 THEN text ELSE '' END AS body, conv_id % 10 / 10.0 AS rating, CAST(turn AS INTEGER) AS upvotes, {_DOUBLE} AS helpful_count, {_DAY} AS event_ts,
 link AS url, 'text' AS modality, 'reddit' AS channel, 'social' AS platform_type, 'content_type=' || CASE WHEN conv_id % 3 = 0 AND text <> '' THEN 'text' WHEN l <> '' THEN 'link' ELSE 'title' END || ';linked_url=' || l || ';num_comments=' || conv_id % 7 || ';source_url=' || link
 || ';subreddit=a;title=Turn ' || turn || ';upvote_ratio=' || printf('%.1f', conv_id % 10 / 10.0) || ';url=' || link AS meta FROM p""",
    "a3_amazon": f"""WITH r AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem)
SELECT 'amazon_' || id AS content_id, 'amazon' AS src, id AS platform_id, 'c' || l_suppkey AS author, l_returnflag AS title, l_linestatus AS body, CAST(l_orderkey % 5 + 1 AS DOUBLE) AS rating, {_INT} AS upvotes, CAST(l_partkey % 9 AS DOUBLE) AS helpful_count, day AS event_ts,
 'https://www.amazon.com/dp/' || l_partkey AS url, 'text' AS modality, 'amazon' AS channel, 'marketplace' AS platform_type,
 'product_brand=B;product_id=' || l_partkey || ';product_title=P;review_date=' || day || ';verified_purchase=' || CASE WHEN l_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS meta FROM r""",
    "a4_youtube": f"""SELECT 'youtube_video_' || doc_id AS content_id, {_TUBE}, CAST(doc_id AS VARCHAR) AS platform_id, source AS author, split_part(text, chr(10), 1) AS title, md5(text) AS body, {_DOUBLE} AS rating, {_INT} AS upvotes, {_DOUBLE} AS helpful_count, '2024-01-01' AS event_ts, {_LINK} AS url,
 'video' AS modality, 'youtube' AS channel, 'social' AS platform_type, 'channel_title=' || source || ';comment_count=' || CASE WHEN doc_id % 4 = 0 THEN 25 ELSE 0 END || ';content_type=video;like_count=' || doc_id % 10 || ';source_url=' || {_LINK} || ';url=' || {_LINK} || ';view_count=' || doc_id % 100 AS meta FROM documents
UNION ALL SELECT 'youtube_comment_' || doc_id || '-' || k, 'youtube', doc_id || '-' || k, 'u' || k, '', 'said ' || k, NULL, CAST(CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS INTEGER), NULL, '2024-01-02', {_LINK}, 'text', 'youtube', 'social',
 'content_type=comment;like_count=' || CASE WHEN k % 2 = 0 THEN k ELSE 0 END || ';source_url=' || {_LINK} || ';video_id=' || doc_id || ';video_title=' || split_part(text, chr(10), 1) || ';video_url=' || {_LINK} FROM documents, range(20) AS r(k) WHERE doc_id % 4 = 0""",
    "a5_web": f"""WITH p AS (SELECT *, html AS body, CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END AS owned FROM pages)
SELECT 'web_' || md5(url) AS content_id, 'web' AS src, url AS platform_id, 'web' AS author, 'T' AS title, md5(body) AS body, {_DOUBLE} AS rating, {_INT} AS upvotes, {_DOUBLE} AS helpful_count, {_NULL} AS event_ts, url, 'text' AS modality, 'web' AS channel, CASE WHEN owned = 'true' THEN 'owned' ELSE 'web' END AS platform_type,
 md5('content_type=web;description=' || substr(body, 1, 200) || ';is_brand_owned=' || owned || CASE WHEN page_id % 4 = 0 THEN ';privacy=http://privacy' ELSE '' END || ';source_url=' || url || CASE WHEN page_id % 3 = 0 THEN ';terms=http://terms' ELSE '' END) AS meta FROM p""",
    "a6_write_content": f"WITH {CONTENT_SQL} SELECT content_id, brand_id, src, run_id, md5(body) AS body FROM content",
    "a7_write_scores": f"WITH {SCORES_SQL} SELECT content_id, brand_id, src, run_id, score_provenance, score_resonance FROM scores",
    "a10_manifest": f"""WITH {SCORES_SQL} SELECT 'content' AS "table", run_id, brand_id, src, count(*) AS n FROM content GROUP BY ALL UNION ALL SELECT 'scores', run_id, brand_id, src, count(*) FROM scores GROUP BY ALL""",
    "a8_export_run": f"""WITH {SCORES_SQL}, r AS (SELECT run_id, min(seq) AS k FROM content GROUP BY ALL)
SELECT content_id AS asset_id, score_coherence, CASE WHEN run_id = 'run_1' AND k = 1 THEN 'slug-of-brand_1' ELSE 'unknown' END AS brand_slug, '2024-03-0' || (k + 1) AS day FROM scores JOIN r USING (run_id) WHERE run_id IN ('run_1', 'run_2')""",
    "a9_export_raw": f"WITH {CONTENT_SQL} SELECT content_id AS asset_id, run_id, channel AS source_type, 'b' AS brand_slug FROM content",
    "a11_prune_written": """WITH r AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, o_orderdate < TIMESTAMP '2001-08-02' - INTERVAL 1000 DAY AS old FROM orders), n AS (SELECT count(*) FILTER (WHERE old) AS deleted, count(*) FILTER (WHERE NOT old) AS n_left, count(DISTINCT y) FILTER (WHERE NOT old) AS years FROM r),
i AS (SELECT count(*) FILTER (WHERE old) AS deleted, count(*) FILTER (WHERE NOT old) AS n_left, count(DISTINCT y) FILTER (WHERE NOT old) AS years FROM lineitem JOIN r ON l_orderkey = k)
SELECT t AS "table", n.* FROM n, unnest(['runs', 'summary']) AS x(t) UNION ALL SELECT t, i.* FROM i, unnest(['assets', 'scores']) AS x(t)""",
    "a11_prune": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS asset_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-02' - INTERVAL 1000 DAY)",
}
