"""A training corpus from documents: five stages, each over all that the one before kept.

quality: documents that the classifier rejects go. line_dedup: lines that an earlier document holds go from the text,
and n_chars follows it. jaccard: of each group of near copies the smallest doc_id stays. decontaminate: documents
with a window of a benchmark item go. sentencepiece: texts become token ids, and what the ids decode to is beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgauge.llm import decontaminate, jaccard_join, line_dedup, piece_codec, quality
from contentgauge.llm.common import materialize, table
from contentgauge.llm.queries import model_path


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeated_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_near_copies(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(docs, model_path())


STAGES = [("quality", by_quality), ("line_dedup", by_lines), ("jaccard", by_similarity), ("decontaminate", by_benchmark), ("sentencepiece", to_tokens)]

#: The quality classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
