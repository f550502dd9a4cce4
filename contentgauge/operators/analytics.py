"""Roll-ups of scores, attributes and runs; each for all keys in one job."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentgauge.operators.scoring import band, dimension_weight
from contentgauge.sources.tables import DIMENSIONS

BANDS = ["excellent", "good", "fair", "poor"]


def unpivoted(scores: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each item and dimension."""
    return scores.select(*keep, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"score_{d}").alias("score")) for d in DIMENSIONS])).alias("x")).select(*keep, "x.*")


def dimension_breakdown(scores: DataFrame, keys: list[str]) -> DataFrame:
    return unpivoted(scores, keys).groupBy(*keys, "dimension").agg(
        F.avg("score").alias("average"), F.min("score").alias("low"), F.max("score").alias("high"), F.coalesce(F.nanvl(F.stddev_samp("score"), F.lit(0.0)), F.lit(0.0)).alias("std")
    )


def dimension_by_class(classified: DataFrame) -> DataFrame:
    """Averages by dimension and class; class_label all stands for every class."""
    rows = unpivoted(classified, ["class_label"]).cube("dimension", "class_label").agg(F.count("score").alias("n"), F.avg("score").alias("average"))
    return rows.filter("dimension is not null").withColumn("class_label", F.coalesce("class_label", F.lit("all")))


def dimension_correlations(scores: DataFrame, keys: list[str]) -> DataFrame:
    pairs = list(combinations(sorted(DIMENSIONS), 2))
    degenerate = lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    wide = scores.groupBy(*keys).agg(*[degenerate(F.corr(f"score_{a}", f"score_{b}")).alias(f"{a}~{b}") for a, b in pairs])
    return wide.unpivot(keys, [f"{a}~{b}" for a, b in pairs], "pair", "r")


def band_distribution(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Items by rating band, bands without items too."""
    counts = classified.groupBy(*keys).agg(*[F.count_if(band(F.col("overall") * 100) == b).alias(b) for b in BANDS], F.avg(F.col("overall") * 100).alias("average"))
    long = counts.unpivot([*keys, "average"], BANDS, "band", "n")
    total = F.sum("n").over(Window.partitionBy(*keys))
    return long.select(*keys, "band", "n", (100.0 * F.col("n") / total).alias("pct"), "average")


def share_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def trust_status(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "moderate").otherwise("poor")


def modality_breakdown(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Share, pooled mean with its status, and best and worst dimension of each modality."""
    items = share_of(scores, keys, "modality")
    per = unpivoted(scores, [*keys, "modality"]).groupBy(*keys, "modality", "dimension").agg(F.avg("score").alias("a"), F.sum("score").alias("s"), F.count("score").alias("c"))
    order = F.struct(F.round("a", 9), "dimension")
    pooled = per.groupBy(*keys, "modality").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("mean_trust"), F.max_by("dimension", order).alias("best"), F.min_by("dimension", order).alias("worst"))
    return items.join(pooled.hint("shuffle_hash"), [*keys, "modality"]).withColumn("status", trust_status(F.round("mean_trust", 9)))


def modality_dimensions(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Average, least, greatest and number of each modality's scores of each dimension; scores that are missing don't count."""
    per = unpivoted(scores, [*keys, "modality"]).groupBy(*keys, "modality", "dimension")
    return per.agg(F.avg("score").alias("average"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("score").alias("samples")).filter("samples > 0")


def modality_insights(breakdown: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows of modality_breakdown, the strongest, weakest and most common modality of each key, of equals the first by name; null where there is only one modality."""
    some = breakdown.groupBy(*keys).agg(
        F.min_by("modality", F.struct(-F.round("mean_trust", 9), "modality")).alias("strongest"), F.min_by("modality", F.struct(F.round("mean_trust", 9), "modality")).alias("weakest"), F.min_by("modality", F.struct(-F.col("n"), "modality")).alias("most_common"), F.count("*").alias("modalities"),
    )
    return some.withColumns({c: F.when(F.col("modalities") > 1, F.col(c)) for c in ("strongest", "weakest")})


def place_breakdown(scores: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Items, different channels, mean of each dimension and of these means with its status, for each channel or platform type, and their order by items, then name."""
    mean = {d: F.avg(f"score_{d}") for d in DIMENSIONS}
    rows = scores.withColumn(by, F.coalesce(F.nullif(by, F.lit("")), F.lit("unknown"))).groupBy(*keys, by).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("channel", F.lit("unknown"))).alias("channels"), *[m.alias(d) for d, m in mean.items()])
    there = F.array_compact(F.array(*DIMENSIONS))
    overall = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), by)
    return rows.withColumn("overall", F.coalesce(overall, F.lit(0.0))).withColumns({"status": trust_status(F.round("overall", 9)), "place": F.row_number().over(order)})


def channel_breakdown(scores: DataFrame, keys: list[str]) -> DataFrame:
    """By channel and modality and by channel alone (modality null)."""
    mean = sum((F.avg(f"score_{d}") for d in DIMENSIONS[1:]), F.avg(f"score_{DIMENSIONS[0]}")) / len(DIMENSIONS)
    sets = [[*map(F.col, [*keys, "channel", "modality"])], [*map(F.col, [*keys, "channel"])]]
    return scores.groupingSets(sets, *keys, "channel", "modality").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), mean.alias("mean_score"))


def attribute_performance(attributes: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    perf = attributes.groupBy(*keys, "dimension", "attribute_id").agg(F.avg("value").alias("average"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("detections"))
    totals = items.groupBy(*keys).agg(F.count("*").alias("items"))
    return perf.join(totals.hint("shuffle_hash"), keys).withColumn("rate", F.col("detections") / F.col("items"))


def critical_attributes(perf: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    weight = F.round(F.abs(F.col("average") - 5) * F.col("rate"), 9)
    ranked = perf.withColumn("impact", weight).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("impact"), "attribute_id")))
    return ranked.filter(F.col("rank") <= k)


def attribute_gaps(perf: DataFrame, keys: list[str], threshold: float = 7.0, k: int = 8) -> DataFrame:
    """Attributes below the threshold by gap x dimension weight x rate; the first three are of priority high, the next three medium."""
    impact = F.round((threshold - F.col("average")) * dimension_weight() * F.col("rate"), 9)
    ranked = perf.filter(F.col("average") < threshold).withColumn("impact", impact)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("impact"), "attribute_id"))).filter(F.col("rank") <= k)
    return ranked.withColumn("priority", F.when(F.col("rank") <= 3, "high").when(F.col("rank") <= 6, "medium").otherwise("low"))


def top_lists(df: DataFrame, keys: list[str], lists: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """Rows of several ranked lists in one shuffle; a list is what it takes, the number it is in the order of (ties by seq) and its length.

    A row comes once for each list that takes it, with list and rank. Spark keeps no more than the longest list of each
    key on either side of the shuffle. Null conditions take nothing.
    """
    longest = max(n for _, _, n in lists.values())
    member = F.array_compact(F.array(*[F.when(takes, F.struct(F.lit(name).alias("list"), order.alias("_order"), F.lit(n).alias("_n"))) for name, (takes, order, n) in lists.items()]))
    rows = df.withColumn("_in", F.explode(member)).select("*", "_in.*").drop("_in")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "list").orderBy("_order", "seq"))).filter(F.col("rank") <= longest)
    return ranked.filter(F.col("rank") <= F.col("_n")).drop("_order", "_n")


def with_best_dimensions(scores: DataFrame) -> DataFrame:
    """strongest and weakest dimension of each item, the first by name among equals."""
    by = lambda sign: F.array_sort(F.array(*[F.struct((F.col(f"score_{d}") * sign).alias("s"), F.lit(d).alias("d")) for d in DIMENSIONS]))[0]["d"]
    return scores.withColumn("strongest", by(-1)).withColumn("weakest", by(1))


def extremes(classified: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k best and k worst items of each key."""
    return top_lists(classified, keys, {"best": (F.lit(True), -F.col("overall"), k), "worst": (F.lit(True), F.col("overall"), k)})


def trust_lists(classified: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Items of low and of moderate trust, worst first, k of each, and the notable ones: five of high trust and three of low."""
    score, label = F.col("overall"), F.col("class_label")
    low = (label == "inauthentic") | (score < 0.5)
    lists = {"low": (low, score, k), "moderate": (~low & ((label == "suspect") | (score < 0.7)), score, k), "notable_high": (score >= 0.7, -score, 5), "notable_low": (score < 0.5, -score, 3)}
    return top_lists(with_best_dimensions(classified), keys, lists)


def egregious(classified: DataFrame, bound: float = 0.4) -> DataFrame:
    """All items that are inauthentic or at the bound or below."""
    return classified.filter((F.col("class_label") == "inauthentic") | (F.col("overall") <= bound))


def dimension_examples(scores: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """For each dimension the share of items from 70 and below 40, and the k best and worst."""
    long = unpivoted(scores, [*keys, "content_id", "seq"])
    picks = top_lists(long, [*keys, "dimension"], {"best": (F.lit(True), -F.col("score"), k), "worst": (F.lit(True), F.col("score"), k)}).drop("seq")
    shares = long.groupBy(*keys, "dimension").agg((F.count_if(F.col("score") >= 0.7) / F.count("*")).alias("share_high"), (F.count_if(F.col("score") < 0.4) / F.count("*")).alias("share_low"))
    return picks.join(shares.hint("shuffle_hash"), [*keys, "dimension"])


def run_presence(content: DataFrame, scores: DataFrame) -> DataFrame:
    """Row counts of each run, brand and source in both tables and where they are missing."""
    keys = ["run_id", "brand_id", "src"]
    a = content.filter("run_id is not null").groupBy(*keys).agg(F.count("*").alias("normalized_rows"))
    b = scores.filter("run_id is not null").groupBy(*keys).agg(F.count("*").alias("scores_rows"))
    return a.join(b, keys, "full").withColumn("in_normalized", F.col("normalized_rows").isNotNull()).withColumn("in_scores", F.col("scores_rows").isNotNull())


def ratio_trend(runs: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each run's value beside the one before it, with the change and its direction."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    out = runs.withColumn("previous", before).withColumn("delta", F.round(F.col(value) - F.col("previous"), 9))
    return out.withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").when(F.col("delta") == 0, "flat").otherwise("first"))


def run_totals(runs: DataFrame, as_of: Column, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Runs, brands, items and mean rating (runs without items have none) of all runs and of those of the last days."""
    spans = F.array(F.lit("all"), *[F.when(F.col("started_at") >= as_of - F.make_dt_interval(F.lit(d)), F.lit(f"{d} days")) for d in windows])
    rows = runs.withColumn("window", F.explode(F.array_compact(spans)))
    rating = F.when(F.col("items") > 0, F.col("rating"))
    return rows.groupBy("window").agg(F.count("*").alias("runs"), F.count_distinct("brand_id").alias("brands"), F.sum("items").alias("items"), F.avg(rating).alias("average"))


def usage_cost(log: DataFrame, prices: DataFrame, keys: list[str], default_model: str, warn: tuple[int, int, float] = (100_000, 50_000, 1.0)) -> DataFrame:
    """Tokens, calls and dollars by key and model, with totals (model null) and quota flags.

    The log is summed by model before prices are looked up: an exact name, else the longest known name that the
    model's begins with, else the default.
    """
    used = log.groupBy(*keys, "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"))
    fits = used.select("model").distinct().join(F.broadcast(prices), F.col("model").startswith(F.col("known_model")))
    best = fits.groupBy("model").agg(F.max_by(F.struct("known_model", "input", "output"), F.length("known_model")).alias("p")).select("model", "p.*")
    other = F.broadcast(prices.filter(F.col("known_model") == default_model).select(F.col("known_model").alias("dm"), F.col("input").alias("di"), F.col("output").alias("do")))
    priced = used.join(best, "model", "left").join(other, F.lit(True))
    cost = F.col("prompt_tokens") / 1e6 * F.coalesce("input", "di") + F.col("completion_tokens") / 1e6 * F.coalesce("output", "do")
    priced = priced.withColumn("cost_usd", cost)
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "calls", "cost_usd")]
    rolled = priced.groupingSets([[*map(F.col, [*keys, "model"])], [*map(F.col, keys)]], *keys, "model").agg(*sums)
    over = (F.col("prompt_tokens") > warn[0]) | (F.col("completion_tokens") > warn[1]) | (F.col("cost_usd") > warn[2])
    return rolled.withColumn("over_quota", over)
