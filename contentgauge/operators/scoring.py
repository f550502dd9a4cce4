"""Signals, dimension scores, overall scores and classes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentgauge.functions.config import DIMENSION_WEIGHTS
from contentgauge.sources.tables import DIMENSIONS

AUTHENTIC, SUSPECT = 0.75, 0.40
LOW = 0.3


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def map_signals(attributes: DataFrame, attr_map: DataFrame, defs: DataFrame) -> DataFrame:
    """Attributes (1 to 10) as signals (0 to 1) with the weight and dimension of their signal; unmapped ones go."""
    joined = attributes.drop("dimension").join(F.broadcast(attr_map), "attribute_id").join(F.broadcast(defs.select("signal_id", "dimension", "weight")), "signal_id")
    return joined.withColumn("value", clamp(F.col("value") / 10.0))


def aggregate_dimensions(signals: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """A score of 0 to 10 for each entity and dimension.

    The mean of known signals is weighted by weight x visibility and capped: by the share of required signals that
    are there (6 below 0.5, 8 below 0.8), by a failing knockout signal (4), and by a required signal that is missing
    or low (6). Unknown signals count as there. Signals fold into one row for each entity and signal before they
    meet the definitions, so an entity with very many signals is reduced where they are.
    """
    known = F.col("status") != "unknown"
    value = F.when((F.col("value") > 1) & (F.col("value") <= 10), F.col("value") / 10).otherwise(clamp(F.col("value")))
    folded = signals.withColumn("v", value).groupBy(*keys, "dimension", "signal_id").agg(
        F.sum(F.when(known, F.col("v") * F.col("weight"))).alias("vw"), F.sum(F.when(known, F.col("weight"))).alias("w"), F.sum(F.when(known, F.col("confidence") * F.col("weight"))).alias("cw"),
        F.greatest(F.max(F.when(known, F.col("value")).otherwise(1.0)), F.lit(0.0)).alias("best"),
    )
    own = folded.join(F.broadcast(defs.drop("weight", "dimension")), "signal_id", "left")
    m = F.coalesce("multiplier", F.lit(1.0))
    low = F.col("best") <= LOW
    totals = own.groupBy(*keys, "dimension").agg(
        F.sum(F.col("vw") * m).alias("vw"), F.sum(F.col("w") * m).alias("w"), F.sum(F.col("cw") * m).alias("cw"), F.count_if(F.col("required")).alias("covered"),
        F.coalesce(F.bool_or(F.col("required") & low), F.lit(False)).alias("low_core"), F.coalesce(F.bool_or(F.col("knockout") & low), F.lit(False)).alias("knocked_out"),
    )
    needed = defs.groupBy("dimension").agg(F.count_if(F.col("required")).alias("needed"))
    # every entity has a row for every dimension, signals or not
    grid = signals.select(*keys).distinct().withColumn("dimension", F.explode(F.array(*map(F.lit, sorted(DIMENSIONS)))))
    full = grid.join(totals.hint("shuffle_hash"), [*keys, "dimension"], "left").join(F.broadcast(needed), "dimension")
    covered = F.coalesce("covered", F.lit(0))
    coverage = F.when(F.col("needed") > 0, covered / F.col("needed")).otherwise(1.0)
    raw = F.coalesce(F.try_divide("vw", "w"), F.lit(0.0)) * 10
    cover_cap = F.when(coverage < 0.5, 6.0).when(coverage < 0.8, 8.0).otherwise(10.0)
    cap = F.when(F.coalesce("knocked_out", F.lit(False)), 4.0).when(F.coalesce("low_core", F.lit(False)) | (covered < F.col("needed")), 6.0).otherwise(10.0)
    level = F.when((coverage >= 0.8) & ~F.coalesce("knocked_out", F.lit(False)), "high").when(coverage >= 0.5, "medium").otherwise("low")
    return full.select(
        *keys, "dimension", F.greatest(F.lit(0.0), F.least(raw, cover_cap, cap)).alias("value"), (F.coalesce(F.try_divide("cw", "w"), F.lit(0.0)) * 0.5 + coverage * 0.5).alias("confidence"),
        coverage.alias("coverage"), level.alias("level"),
    )


def dimension_weight() -> Column:
    return reduce(lambda c, d: c.when(F.col("dimension") == d[0], d[1]), list(DIMENSION_WEIGHTS.items())[1:], F.when(F.col("dimension") == "provenance", DIMENSION_WEIGHTS["provenance"])).otherwise(0.2)


def trust_columns() -> list[Column]:
    """Aggregates of dimension rows: overall score (0 to 100), confidence and coverage; dimensions without score and coverage don't count."""
    w = F.when((F.col("value") > 0) | (F.col("coverage") > 0), dimension_weight())
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * w), F.sum(w)), F.lit(0.0))
    return [(mean("value") * 10).alias("overall"), mean("confidence").alias("confidence"), mean("coverage").alias("coverage")]


def trust_score(dimensions: DataFrame, keys: list[str]) -> DataFrame:
    return dimensions.groupBy(*keys).agg(*trust_columns())


def freshness(published: Column, as_of: Column) -> Column:
    age = F.floor(F.unix_seconds(as_of) / 86400 - F.unix_seconds(published) / 86400)
    return F.when(age.isNull(), 0.5).when(age < 30, 1.0).when(age < 90, 0.9).when(age < 180, 0.8).when(age < 365, 0.6).otherwise(0.4)


def engagement_resonance(src: Column, rating: Column, upvotes: Column, helpful: Column) -> Column:
    by_rating = F.when(src == "amazon", (rating - 3) * 0.1).when(src == "reddit", (rating - 0.5) * 0.2).otherwise(0.0)
    parts = [F.coalesce(by_rating, F.lit(0.0)), F.coalesce(F.log10(F.greatest(F.lit(1.0), upvotes.cast("double"))) / 3 * 0.1, F.lit(0.0)), F.when(helpful.isNotNull(), F.least(helpful / 20, F.lit(1.0)) * 0.1).otherwise(0.0)]
    return clamp(reduce(add, parts, F.lit(0.5)))


def adjust_scores(scores: DataFrame, attributes: DataFrame) -> DataFrame:
    """score (0 to 1) of each content_id and dimension, moved by the confidence-weighted attributes of the dimension.

    Negative moves of attributes whose evidence starts with LLM: don't count, as the score has them already.
    """
    move = (F.col("value") - 5.5) * 9
    counts = ~(F.coalesce(F.col("evidence"), F.lit("")).startswith("LLM:") & (move < 0))
    moves = attributes.filter(counts).groupBy("content_id", "dimension").agg(F.try_divide(F.sum(move * F.col("confidence")), F.sum("confidence")).alias("move"))
    s = F.col("score") * 100
    moved = clamp(0.7 * s + 0.3 * clamp(s + F.col("move"), 0.0, 100.0), 0.0, 100.0) / 100
    return scores.join(moves.hint("shuffle_hash"), ["content_id", "dimension"], "left").select("content_id", "dimension", F.when(F.col("move").isNull(), F.col("score")).otherwise(moved).alias("score"))


def mean_score() -> Column:
    return reduce(add, [F.col(f"score_{d}") * 0.2 for d in DIMENSIONS])


def band(rating: Column) -> Column:
    return F.when(rating >= 80, "excellent").when(rating >= 60, "good").when(rating >= 40, "fair").otherwise("poor")


def classify(df: DataFrame) -> DataFrame:
    overall = F.round(mean_score(), 9)
    label = F.when(overall >= AUTHENTIC, "authentic").when(overall >= SUSPECT, "suspect").otherwise("inauthentic")
    return df.withColumn("overall", overall).withColumn("class_label", label).withColumn("is_authentic", F.col("class_label") == "authentic")


def class_confidence(overall: Column) -> tuple[Column, Column, Column]:
    width = AUTHENTIC - SUSPECT
    good = F.greatest(F.lit(0.0), overall - AUTHENTIC) / (1 - AUTHENTIC)
    middle = F.least(F.least(F.lit(1.0), (AUTHENTIC - overall) / width), F.greatest(F.lit(0.0), (overall - SUSPECT) / width))
    bad = F.greatest(F.lit(0.0), SUSPECT - overall) / SUSPECT
    total = good + middle + bad
    share = lambda x: F.when(total > 0, x / total).otherwise(x)
    return share(good), share(middle), share(bad)


def top_uncertain(classified: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """Of the suspects, the n nearest to the middle of the thresholds, for each key."""
    distance = F.abs(F.col("overall") - (AUTHENTIC + SUSPECT) / 2)
    ranked = classified.filter("class_label = 'suspect'").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.round(distance, 9), "seq")))
    return ranked.filter(F.col("rank") <= n)


def authenticity_ratio(content: DataFrame, classified: DataFrame, keys: list[str]) -> DataFrame:
    joined = content.select("content_id", *keys).join(classified.select("content_id", *keys, "class_label", "is_authentic").hint("shuffle_hash"), ["content_id", *keys])
    n, good, middle = F.count("*"), F.count_if(F.col("is_authentic")), F.count_if(F.col("class_label") == "suspect")
    return joined.groupBy(*keys).agg(
        n.alias("total_items"), good.alias("authentic_items"), middle.alias("suspect_items"), F.count_if(F.col("class_label") == "inauthentic").alias("inauthentic_items"),
        (100.0 * good / n).alias("ratio_pct"), (100.0 * (good + 0.5 * middle) / n).alias("extended_pct"),
    )


def ratio_overall(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """Counts add up; the percentage is the mean of the sources' percentages."""
    return ratios.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total_items", "authentic_items", "suspect_items", "inauthentic_items")], F.avg("ratio_pct").alias("ratio_pct"))


def fallback_scores(assets: DataFrame, scored: DataFrame) -> DataFrame:
    size = F.length(F.coalesce("body", F.lit("")))
    score = F.when(size == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.3 + size / 2000.0))
    return assets.join(scored.select("content_id"), "content_id", "left_anti").select("content_id", score.alias("score"), F.when(score >= 0.4, "fair").otherwise("poor").alias("label"))


def asset_class(overall: Column) -> Column:
    return F.when(overall >= 0.75, "excellent").when(overall >= 0.5, "good").when(overall >= 0.25, "fair").otherwise("poor")
