"""Queries of the streaming jobs: the stream reads the given tables' files, runs once over what is there, and its sink is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.plans.normalization import CLEAN_SQL, LANGUAGE_SQL, SKIP_SQL
from contentgauge.sources.stage import shared_folder
from contentgauge.sources.tables import table
from contentgauge.streaming import jobs


def _stream(spark, sf_dir, name):
    """A stream over a table's files; the pattern in the path lets a table be one file as well as a folder."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 100).parquet(f"{sf_dir}/{name}.parque[t]")


def _events(df):
    return df.select(F.col("ts").cast("timestamp").alias("event_time"), F.concat(F.lit("brand_"), (F.col("user_id") % 7).cast("string")).alias("brand_id"), (F.col("event_id") % 3 == 0).alias("is_authentic"))


def s3_daily_ratio(spark, sf_dir):
    """Events in three arrivals: the first 20 days, the rest, and once more events of the first days, which are too late."""
    out = shared_folder(spark)
    events = _events(table(spark, sf_dir, "events"))
    start = events.agg(F.date_trunc("day", F.min("event_time")).alias("start"))
    aged = events.join(F.broadcast(start), F.lit(True)).withColumn("age", F.datediff("event_time", "start")).drop("start")
    for part in (aged.filter("age < 20"), aged.filter("age >= 20"), aged.filter("age < 3")):
        part.drop("age").write.mode("append").parquet(f"{out}/arrivals")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/arrivals")
        jobs.run_ratio(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("brand_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("ratio_pct", 9).alias("ratio_pct"))


#: Hours after which documents arrive once more, and the part of them that does.
WAVES = [(0, 1), (1, 1), (25, 1), (26, 1), (60, 2)]


def arrivals(spark, sf_dir, hours, part):
    """Documents whose id the part divides, each at a second of the hour that follows its id, so many hours later."""
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") % part == 0)
    at = F.timestamp_seconds(F.lit(1_700_000_000 + hours * 3600) + F.col("doc_id") % 3600)
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("content_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), at.alias("event_time"))


def s1_daily_dedup(spark, sf_dir):
    """Documents that arrive again an hour, 25, 26 and 60 hours later, each time as a run of its own: after 25 and 60 hours they are new again."""
    out = shared_folder(spark)
    for hours, part in WAVES:
        arrivals(spark, sf_dir, hours, part).write.mode("append").parquet(f"{out}/arrivals")
        stream = spark.readStream.schema("content_id string, title string, body string, event_time timestamp").parquet(f"{out}/arrivals")
        query = jobs.dedup_stream(stream).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{out}/rows")
        query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("fingerprint", F.unix_seconds("event_time").alias("second"))


def s2_quality_gate(spark, sf_dir):
    """Documents through the gate in micro-batches; gated rows and the number of attributes of those that pass are appended."""
    out = shared_folder(spark)
    content = _stream(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("content_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), *[F.lit(v).cast(kind).alias(c) for c, kind, v in _UNKNOWN])

    def sink(gated, attributes, number):
        gated.select("content_id", "skip_reason", "language").write.mode("overwrite").parquet(f"{out}/gated/batch={number}")
        attributes.select("content_id", "attribute_id").write.mode("overwrite").parquet(f"{out}/attributes/batch={number}")

    jobs.run_gate(content, sink, f"{out}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{out}/attributes").groupBy("content_id").agg(F.count("attribute_id").alias("n"))
    rows = spark.read.parquet(f"{out}/gated").join(found.hint("shuffle_hash"), "content_id", "left")
    return rows.select("content_id", "skip_reason", "language", (F.coalesce("n", F.lit(0)) > 0).alias("has_attributes"))


_UNKNOWN = [("src", "string", "web"), ("modality", "string", "text"), ("channel", "string", "web"), ("helpful_count", "double", None), ("url", "string", None), ("meta", "map<string,string>", None)]
QUERIES = {f.__name__: f for f in (s1_daily_dedup, s2_quality_gate, s3_daily_ratio)}
_FP = r"md5(array_to_string(list_transform(list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1) || ' ' || text), '\s+'), lambda w: w <> '')[1:50], lambda w: md5(w)), ''))"
ORACLES = {
    "s2_quality_gate": CLEAN_SQL + f", g AS (SELECT content_id, {SKIP_SQL} AS skip_reason, {LANGUAGE_SQL} AS language FROM cleaned) SELECT *, skip_reason IS NULL AS has_attributes FROM g",
    # the first of a fingerprint, the first again after 25 hours, and the first of the even ones after 60
    "s1_daily_dedup": f"""WITH f AS (SELECT {_FP} AS fingerprint, 1700000000 + doc_id % 3600 AS t, doc_id FROM documents)
SELECT fingerprint, min(t) AS second FROM f GROUP BY ALL UNION ALL SELECT fingerprint, min(t) + 25 * 3600 FROM f GROUP BY ALL UNION ALL SELECT fingerprint, min(t) + 60 * 3600 FROM f WHERE doc_id % 2 = 0 GROUP BY ALL""",
    "s3_daily_ratio": "SELECT 'brand_' || user_id % 7 AS brand_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(100.0 * count(*) FILTER (WHERE event_id % 3 = 0) / count(*), 9) AS ratio_pct FROM events GROUP BY ALL",
}
