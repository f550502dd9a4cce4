"""Run-level operators: item and run tables assembled from content, scores and attributes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgauge.operators import normalize, scoring
from contentgauge.sources.tables import DIMENSIONS

# fixed values: sentences of the prompt that a suggestion must not repeat
ECHOES = ["why didn't i get 100%", "what specific thing could make this even better", "what is one small thing i could do to make this perfect", "the client wants to know"]
# fixed values: parts of the names of issues whose items need an explanation
EXPLAINED = ["improvement", "opportunity", "vocabulary", "tone", "voice"]


def item_summary(classified: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Items with their final score (0 to 100; the adjusted one where there is one) and a title that falls back to the body's start."""
    title = F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.concat(F.substring("body", 1, 60), F.lit("...")))
    joined = classified.join(adjusted.select("content_id", "adjusted").hint("shuffle_hash"), "content_id", "left")
    return joined.withColumns({"final_score": F.coalesce("adjusted", F.col("overall") * 100), "shown_title": title}).drop("adjusted")


def mean_ratio(items: DataFrame, keys: list[str]) -> DataFrame:
    """The score-based ratio of each key: the mean of its items' final scores, and their number."""
    return items.groupBy(*keys).agg(F.avg("final_score").alias("ratio_pct"), F.count("final_score").alias("items"))


def blocked_urls(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose page answered with an error or a wall, and their number by key."""
    gated = normalize.with_skip_reason(items).filter("skip_reason in ('error_page', 'login_wall')")
    return gated.groupBy(*keys, "skip_reason").agg(F.count("*").alias("n"), F.min("content_id").alias("first"))


def report_data(runs: DataFrame, assets: DataFrame, scores: DataFrame, summary: DataFrame) -> DataFrame:
    """Assets of runs with the first score of each (by score_id), the page's url and title in meta, and the run's averages.

    assets(asset_id, run_id, url, title, screenshot_path, meta), scores(asset_id, score_id, overall, rationale),
    summary(run_id, avg_*). meta keeps a source_url and title of its own and gets the rationale's detected attributes as
    JSON text; a missing screenshot is the rationale's. final_score is 0 to 100, null without a score and 0 for a score
    without a number. Runs without a summary have averages of null, summaries without a number of 0.
    """
    first = F.min_by(F.struct("overall", "rationale"), "score_id").alias("_score")
    one = scores.groupBy("asset_id").agg(first, F.min("score_id").alias("score_id"))
    averages = [F.coalesce(c, F.lit(0.0)).alias(c) for c in summary.columns if c.startswith("avg_")]
    joined = assets.join(runs.join(summary.select("run_id", *averages), "run_id", "left"), "run_id").join(one.hint("shuffle_hash"), "asset_id", "left")
    own = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    found = F.get_json_object("_score.rationale", "$.detected_attributes")
    extra = F.array(F.struct(F.lit("source_url").alias("k"), F.col("url").alias("v")), F.struct(F.lit("title").alias("k"), F.col("title").alias("v")))
    filled = F.map_zip_with(F.map_filter(own, lambda k, v: (v != "") | ~k.isin("source_url", "title")), F.map_from_entries(F.filter(extra, lambda e: e["v"] != "")), lambda _, a, b: F.coalesce(a, b))
    kept = F.map_filter(filled, lambda k, _: (k != "detected_attributes") | found.isNull())
    with_found = F.when(found.isNull(), kept).otherwise(F.map_concat(kept, F.create_map(F.lit("detected_attributes"), found)))
    shot = F.coalesce(F.nullif("screenshot_path", F.lit("")), F.get_json_object("_score.rationale", "$.screenshot_path"))
    final = F.when(F.col("score_id").isNotNull(), F.coalesce("_score.overall", F.lit(0.0)) * 100)
    return joined.withColumns({"meta": with_found, "screenshot_path": shot, "final_score": final}).drop("_score")


def denied_pages(report: DataFrame) -> DataFrame:
    """Rows of report_data whose page denied access: url and title with what stands for missing ones, and the reason."""
    denied = report.filter(F.lower(F.coalesce(F.col("meta")["access_denied"], F.lit(""))).isin("true", "1"))
    url = F.coalesce(F.nullif(F.col("meta")["source_url"], F.lit("")), F.nullif(F.col("meta")["url"], F.lit("")), F.lit("Unknown URL"))
    return denied.select("run_id", "asset_id", url.alias("url"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Access Denied")).alias("title"), F.lit("Anti-bot protection (Access Denied)").alias("reason"))


def run_summary(dimensions: DataFrame, asset_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Dimension scores of a run from all its signals (0 to 1), else the mean of its assets' scores; and the overall score."""
    by_signal = dimensions.groupBy(*keys).pivot("dimension", DIMENSIONS).agg(F.first(F.col("value") / 10))
    means = asset_scores.groupBy(*keys).agg(*[F.avg(f"score_{d}").alias(f"mean_{d}") for d in DIMENSIONS], F.avg("overall").alias("mean_overall"))
    overall = scoring.trust_score(dimensions, keys).select(*keys, (F.col("overall") / 100).alias("trust"))
    joined = means.join(by_signal.hint("shuffle_hash"), keys, "left").join(overall.hint("shuffle_hash"), keys, "left")
    return joined.select(*keys, *[F.coalesce(d, f"mean_{d}").alias(d) for d in DIMENSIONS], F.coalesce("trust", "mean_overall").alias("overall"))


def in_visual_scope(content: DataFrame, scopes: list[str] = ["brand_owned", "landing_page"]) -> DataFrame:  # noqa: B006
    """Content whose screenshots are judged: owned sources in either spelling, or a content type of the scope; without regard to case."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return content.filter(low("source_type").isin("brand_owned", "brand-owned") | low("content_type").isin([s.strip().lower() for s in scopes]))


def valid_suggestion(issue_type: Column, suggestion: Column, evidence: Column) -> Column:
    """Whether an issue's item is listed beside the suggestions that were taken.

    Issues of improvements, vocabulary, tone and voice need an aspect (a colon among the first 60 characters, not that
    of a quote) or a rewrite (Change '...'), and no sentence of the prompt. Without a suggestion of that kind there is
    none to list; evidence that is only a quote doesn't replace it. Items of other issues are always listed.
    """
    s, e = F.coalesce(suggestion, F.lit("")), F.coalesce(evidence, F.lit(""))
    t = F.btrim(s, F.lit(" \t\n\r"))
    quote = t.startswith("EXACT QUOTE")
    echo = reduce(or_, [F.lower(s).contains(x) for x in ECHOES])
    colon = F.instr(s, ":")
    aspect = (colon > 0) & (colon <= 60) & ~quote
    rewrite = s.contains("Change '")
    bare = ~aspect & ~rewrite & ((F.length(s) < 100) | s.contains("EXACT QUOTE:")) & (t.startswith("EXACT QUOTE:") | t.startswith("'"))
    only_quoted = (s == "") & (F.length(e) < 100) & ((e.contains("EXACT QUOTE:") & F.trim(e).startswith("EXACT QUOTE:")) | F.trim(e).startswith("'"))
    needed = reduce(or_, [F.lower(F.coalesce(issue_type, F.lit(""))).contains(x) for x in EXPLAINED])
    return ~needed | (~only_quoted & ~echo & ~bare & (aspect | rewrite))


def score_content(content: DataFrame, attributes: DataFrame, attr_map: DataFrame, defs: DataFrame) -> DataFrame:
    """One row for each item that is not skipped: dimension scores (0 to 1), overall score, rating band and what they rest on as JSON.

    attributes(content_id, attribute_id, dimension, value, confidence, status, evidence) decide, merged with issues
    beforehand where there are any (review.merge_issues). meta holds scores by dimension and the item's attributes by id.
    Items without attributes of a signal have no row.
    """
    kept = normalize.with_skip_reason(content).filter("skip_reason is null").select("content_id")
    own = attributes.join(kept.hint("shuffle_hash"), "content_id", "left_semi")
    dims = scoring.aggregate_dimensions(scoring.map_signals(own, attr_map, defs), defs, ["content_id"])
    wide = dims.groupBy("content_id").agg(*[F.max(F.when(F.col("dimension") == d, F.col("value") / 10)).alias(d) for d in DIMENSIONS], *scoring.trust_columns())
    # an item has at most one row of each attribute and of each issue of its text
    listed = own.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("attribute_id", "dimension", F.round("value", 9).alias("value"), F.round("confidence", 9).alias("confidence"), "evidence"))).alias("_listed"))
    out = wide.join(listed.hint("shuffle_hash"), "content_id")
    payload = F.to_json(F.struct(F.struct(*[F.round(d, 9).alias(d) for d in DIMENSIONS]).alias("dimensions"), F.col("_listed").alias("detected_attributes")))
    return out.withColumns({"band": scoring.band(F.round("overall", 9)), "meta": payload}).drop("_listed")
