"""Quality classifier: perplexity under an n-gram model of words learned from trusted text, and words that mark toxic documents.

The model (word_model) is learned from three quarters of the trusted texts and scores every document; a high quantile
of the scores of the last quarter is a language's threshold.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgauge.llm import word_model
from contentgauge.llm.common import BROADCAST_ROWS, join_ids, materialize

#: Quantile of a language's held-out trusted documents beyond which a document is rejected, for perplexity and for marking words.
UPPER = 0.999
#: Documents with which a language's own quantile weighs as much as what all languages show.
HALF = 5000
#: Documents that the mean of the languages counts as, in the deviation of a language with few.
SHARED = 10
#: Words at the language's median that every text is scored with, so that the chance of few words rejects nothing.
PRIOR = 20
#: Share of repeated words up to which no text is rejected for them.
LEAST_REPEATS = 0.2
#: Rows of language thresholds up to which they are broadcast.
MOST_LANGUAGES = 100_000
#: One trusted text of so many is not learned from, but shows what the model finds in good text that is new to it.
HELD_OUT = 4


def never_null(lang: str):
    """The language as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).alias("_lang")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with _toxic: false for trusted documents (good in every row of labels and never toxic), true for good ones that are toxic, else null; and _held, of trusted ones that the limits are measured on. Copies of a text are all held or all not."""
    ids = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    ids = ids.filter("q = 1").select("doc_id", (F.col("t") != 0).alias("_toxic"))
    held = ~F.col("_toxic") & (F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)
    n = ids.count()
    found = join_ids(docs, ids, ["doc_id"], "left", n).withColumn("_held", F.coalesce(held, F.lit(False)))
    # the model's chunks are numbered by the order of rows, which a shuffle doesn't give again on a retry
    return found if n <= BROADCAST_ROWS else materialize(found)


def with_prior(score: str, middle: str):
    """The score over a text's own words and PRIOR more at the language's median."""
    return (F.col(score) * F.col("n") + F.col(middle) * PRIOR) / (F.col("n") + PRIOR)


def share_repeated():
    """Share of words that repeat one of the two before, of a text's own and PRIOR that don't; perplexity doesn't see repetition."""
    return F.col("repeats") / (F.col("n") + PRIOR)


def limits(held_out: DataFrame) -> DataFrame:
    """_lang, middle, most, most_toxic, most_repeats from held_out(_lang, n, score, toxic, repeats); the row with a null _lang is for languages without trusted documents.

    A language's limit is its own quantile, weighted with its documents, and HALF documents' weight of the greatest of
    this, of the quantile of all, taken from each one's median, and of that of a normal distribution about it with the
    deviation of the documents above it (copies pull those below down) and of SHARED more with the mean of all languages:
    few documents can't show a high quantile, many do.
    """
    by = held_out.groupBy("_lang").agg(F.percentile_approx("score", 0.5, 10_000).alias("middle"))
    overall = held_out.agg(F.lit(None).cast("string").alias("_lang"), F.percentile_approx("score", 0.5, 10_000).alias("middle"))
    beyond = held_out.join(F.broadcast(by), "_lang").withColumn("beyond", with_prior("score", "middle") - F.col("middle"))
    of = lambda c: F.percentile_approx(c, UPPER, 10_000)
    above = F.when(F.col("beyond") > 0, F.col("beyond"))
    own = beyond.groupBy("_lang").agg(F.count("*").alias("docs"), of("beyond").alias("own"), of("toxic").alias("own_toxic"), of(share_repeated()).alias("own_repeats"), F.count(above).alias("v"), F.mean(above * above).alias("square"))
    pooled = beyond.agg(of("beyond").alias("all"), of("toxic").alias("all_toxic"), of(share_repeated()).alias("all_repeats"))
    shared = own.agg(F.coalesce(F.avg("square"), F.lit(0.0)).alias("shared"))
    square = (F.col("v") * F.coalesce("square", "shared") + SHARED * F.col("shared")) / (F.col("v") + SHARED)
    own = own.crossJoin(F.broadcast(shared)).withColumn("normal", NormalDist().inv_cdf(UPPER) * F.sqrt(square))
    docs = F.coalesce("docs", F.lit(0))
    # the row of all languages has no documents of its own
    most = lambda a, *more: (F.coalesce(F.col(a) * docs, F.lit(0.0)) + F.greatest(a, *more) * HALF) / (docs + HALF)
    found = by.unionByName(overall).join(F.broadcast(own), "_lang", "left").crossJoin(F.broadcast(pooled))
    return found.select("_lang", "middle", (F.col("middle") + most("own", "all", "normal")).alias("most"), most("own_toxic", "all_toxic").alias("most_toxic"), F.when(F.col("middle").isNotNull(), F.greatest(most("own_repeats", "all_repeats"), F.lit(LEAST_REPEATS))).alias("most_repeats"))


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of docs(doc_id, _lang, text, ...), without the text, and the limits of their languages."""
    docs = labelled(docs, labels)
    known = docs.filter("text <> '' and _toxic is not null and not _held").select("text", F.col("_toxic").alias("toxic"))
    scores = materialize(word_model.score(docs.drop("_toxic"), *word_model.learn(known)))
    return scores, materialize(limits(scores.filter("_held and n > 0").select("_lang", "n", "score", "toxic", "repeats")))


def with_limits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows(_lang, n, score, toxic, repeats) with most and kept."""
    overall = found.filter("_lang is null").first()
    names = ("middle", "most", "most_toxic", "most_repeats")
    own = found.filter("_lang is not null").select("_lang", *[F.col(c).alias(f"_{c}") for c in names])
    own = F.broadcast(own) if own.count() <= MOST_LANGUAGES else own.hint("shuffle_hash")
    rows = rows.join(own, "_lang", "left").select("*", *[F.coalesce(f"_{c}", F.lit(overall[c] if overall else None).cast("double")).alias(c) for c in names])
    within = [with_prior("score", "middle") <= F.col("most"), F.col("toxic") <= F.col("most_toxic"), share_repeated() <= F.col("most_repeats")]
    return rows.withColumn("kept", reduce(and_, [F.coalesce(x, F.lit(True)) for x in within]))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Perplexity of every document by word and whether it is kept.

    Returns doc_id, lang, perplexity, threshold, kept, one row per input row. A document is kept if its log perplexity,
    over its own words and PRIOR more at its language's median, is at most its language's threshold, and its word that
    marks toxic documents most weighs no more than in its language's trusted documents (their quantile UPPER), nor does
    it repeat words more than they do. Languages without held-out trusted documents, and a null lang, take the figures of all. A null or empty text has no perplexity and is kept, as is
    everything if there is no trusted text. Repeated rows and copies are judged alike.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), never_null("lang"), F.col("text").cast("string").alias("text"))
    scores, found = judged(docs, labels)
    return with_limits(scores, found).select("doc_id", "lang", F.exp("score").alias("perplexity"), F.exp("most").alias("threshold"), "kept")


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs, whatever their names."""
    key = F.unhex(F.md5(F.col("text").cast("string")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), never_null("lang"), key.alias("key"), F.col("text").cast("string").alias("text"))
    scores, found = judged(texts, labels)
    rejected = materialize(with_limits(scores, found).filter("not kept").select(F.col("key").alias("_key"), "_lang").distinct())
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    keyed = docs.select(*own, key.alias("_key"), never_null("lang"))
    return join_ids(keyed, rejected, ["_key", "_lang"], "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
