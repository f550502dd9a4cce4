"""Content, score and run tables derived from the given star schema, document and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content row for each document: its first line is the title; engagement follows the id."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select(
        F.concat(F.lit("doc_"), n.cast("string")).alias("content_id"), n.alias("seq"), F.col("source").alias("src"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), ((n % 50) / 10.0).alias("rating"),
        (n % 400).cast("int").alias("upvotes"), (n % 23).cast("double").alias("helpful_count"), F.col("lang").alias("declared_lang"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (n % 5 + 1).cast("int")).alias("channel"),
        F.element_at(F.array(*map(F.lit, MODALITIES)), (n % 3 + 1).cast("int")).alias("modality"),
        F.concat(F.lit("brand_"), (n % 7).cast("string")).alias("brand_id"), F.concat(F.lit("run_"), (n % 4).cast("string")).alias("run_id"),
    )


CHANNELS = ["web", "youtube", "reddit", "amazon", "email"]
MODALITIES = ["text", "image", "video"]
DIMENSIONS = ["provenance", "verification", "transparency", "coherence", "resonance"]
#: Per dimension: what the document id is multiplied with for a score of 0.00 to 1.00.
FACTORS = {"provenance": 37, "verification": 53, "transparency": 71, "coherence": 89, "resonance": 97}


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five scores in [0, 1] for each document, from its id."""
    c = contents(spark, sf_dir).drop("title", "body")
    return c.select("*", *[(F.col("seq") * FACTORS[d] % 101 / 100.0).alias(f"score_{d}") for d in DIMENSIONS])


CONTENT_SQL = """content AS (
  SELECT 'doc_' || doc_id AS content_id, doc_id AS seq, source AS src, split_part(text, chr(10), 1) AS title, text AS body, (doc_id % 50) / 10.0 AS rating,
         doc_id % 400 AS upvotes, CAST(doc_id % 23 AS DOUBLE) AS helpful_count, lang AS declared_lang,
         ['web', 'youtube', 'reddit', 'amazon', 'email'][doc_id % 5 + 1] AS channel, ['text', 'image', 'video'][doc_id % 3 + 1] AS modality,
         'brand_' || doc_id % 7 AS brand_id, 'run_' || doc_id % 4 AS run_id
  FROM documents)"""

SCORES_SQL = (
    CONTENT_SQL + ",\nscores AS (SELECT content_id, seq, src, rating, upvotes, helpful_count, channel, modality, brand_id, run_id, "
    + ", ".join(f"(seq * {FACTORS[d]} % 101) / 100.0 AS score_{d}" for d in DIMENSIONS) + " FROM content)"
)
