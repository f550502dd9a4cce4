"""The whole score row of an item: content, raw model scores, claims, badges, attributes and visual signals meet once, by content_id.

Each input is dealt by content_id one time and reduced there; what an item has of it then is a short list in its row, so
claims, multipliers, resonance, signals, caps, the overall score and the payload are expressions of one projection.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgauge.functions.config import DIMENSION_WEIGHTS
from contentgauge.functions.text import bound
from contentgauge.operators import normalize, review, scoring
from contentgauge.operators.reports import content_type
from contentgauge.sources.tables import DIMENSIONS

# fixed values: the signals that raw scores give, with the weight each has if the definitions don't name it
BASE = {
    "prov_source_clarity": ("provenance", 0.2), "prov_date_freshness": ("provenance", 0.2), "ver_fact_accuracy": ("verification", 0.4), "trans_disclosures": ("transparency", 0.4),
    "coh_voice_consistency": ("coherence", 0.4), "res_cultural_fit": ("resonance", 0.4),
}
_SIGNAL = "struct<signal_id:string,dimension:string,weight:double,value:double,confidence:double,known:boolean,n:bigint>"
_ATTRIBUTE = "struct<attribute_id:string,dimension:string,value:double,confidence:double,evidence:string,n:bigint>"
_ISSUE = "struct<type:string,severity:string,confidence:double,evidence:string,suggestion:string>"


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("content_id")


def _attributes(attributes: DataFrame, attr_map: DataFrame, defs: DataFrame) -> DataFrame:
    """Each item's different attributes, and the signals they map to; equal rows fold into one with their number."""
    named = attr_map.join(F.broadcast(defs.select("signal_id", F.col("dimension").alias("_dim"), F.col("weight").alias("_weight"))), "signal_id")
    columns = ["attribute_id", "dimension", "value", "confidence", "status", "evidence"]
    rows = _dealt(attributes.select("content_id", *columns)).groupBy("content_id", *columns).agg(F.count("*").alias("n")).join(F.broadcast(named), "attribute_id", "left")
    signal = F.struct("signal_id", F.col("_dim").alias("dimension"), F.col("_weight").alias("weight"), scoring.clamp(F.col("value") / 10.0).alias("value"), "confidence", (F.col("status") != "unknown").alias("known"), "n")
    listed = F.struct("attribute_id", "dimension", "value", "confidence", "evidence", "n")
    return rows.groupBy("content_id").agg(F.array_sort(F.collect_list(F.when(F.col("signal_id").isNotNull(), signal))).cast(f"array<{_SIGNAL}>").alias("_mapped"), F.array_sort(F.collect_list(listed)).cast(f"array<{_ATTRIBUTE}>").alias("_attributes"))


def _visual(visual: DataFrame) -> DataFrame:
    columns = ["signal_id", "dimension", "weight", "value", "confidence"]
    rows = _dealt(visual.select("content_id", *columns)).groupBy("content_id", *columns).agg(F.count("*").alias("n"))
    return rows.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct(*columns, F.lit(True).alias("known"), "n"))).cast(f"array<{_SIGNAL}>").alias("_visual"))


def dimension_score(d: str, signals: Column, defs: Column, own_defs: Column | None = None) -> Column:
    """value (0 to 10), confidence, coverage and level of a dimension from an item's signals; defs maps signal_id to its definition.

    The same rules as scoring.aggregate_dimensions, for signals that are in the row. own_defs may have the dimension's
    definitions alone. Spark works out again what a lambda needs wherever it is named, so sums are made in one go and bound.
    """
    m = lambda s: F.coalesce(F.try_element_at(defs, s["signal_id"])["multiplier"], F.lit(1.0)) * s["n"]
    v = lambda s: F.when((s["value"] > 1) & (s["value"] <= 10), s["value"] / 10).otherwise(scoring.clamp(s["value"]))
    add_up = lambda a, s, m: F.struct((a["vw"] + v(s) * s["weight"] * m).alias("vw"), (a["w"] + s["weight"] * m).alias("w"), (a["cw"] + s["confidence"] * s["weight"] * m).alias("cw"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("vw", "w", "cw")])
    sums = F.aggregate(F.filter(signals, lambda s: (s["dimension"] == d) & s["known"]), zero, lambda a, s: bound(m(s), lambda x: add_up(a, s, x)))
    low = lambda b: F.coalesce(b <= scoring.LOW, F.lit(False))
    stops = F.filter(F.map_entries(defs if own_defs is None else own_defs), lambda e: (e["value"]["dimension"] == d) & e["value"]["knockout"])
    knocked = F.exists(stops, lambda e: low(_best(d, signals, e["key"])))
    core = F.col(f"_core_{d}")
    coverage = F.when(F.size(core) > 0, F.size(F.filter(core, lambda b: b.isNotNull())) / F.size(core)).otherwise(1.0)

    def row(x: Column) -> Column:
        covered = x["coverage"]
        cap = F.when(x["knocked"], 4.0).when(x["weak"] | (covered < 1), 6.0).otherwise(10.0)
        cover_cap = F.when(covered < 0.5, 6.0).when(covered < 0.8, 8.0).otherwise(10.0)
        mean = lambda c: F.coalesce(F.try_divide(x["sums"][c], x["sums"]["w"]), F.lit(0.0))
        value = F.greatest(F.lit(0.0), F.least(mean("vw") * 10, cover_cap, cap))
        level = F.when((covered >= 0.8) & ~x["knocked"], "high").when(covered >= 0.5, "medium").otherwise("low")
        return F.struct(value.alias("value"), (mean("cw") * 0.5 + covered * 0.5).alias("confidence"), covered.alias("coverage"), level.alias("level"))

    return bound(F.struct(sums.alias("sums"), knocked.alias("knocked"), F.exists(core, low).alias("weak"), coverage.alias("coverage")), row)


def _best(d: str, signals: Column, k: Column) -> Column:
    """The best value of a signal of a dimension, null where it is missing."""
    return F.array_max(F.transform(F.filter(signals, lambda s: (s["dimension"] == d) & (s["signal_id"] == k)), lambda s: F.when(s["known"], F.greatest(s["value"], F.lit(0.0))).otherwise(1.0)))


def _core(d: str, signals: Column, defs: Column) -> Column:
    """The best value of each required signal of a dimension, null where it is missing."""
    return F.transform(F.filter(F.map_entries(defs), lambda e: (e["value"]["dimension"] == d) & e["value"]["required"]), lambda e: _best(d, signals, e["key"]))


def _adjusted(d: str) -> Column:
    """The dimension's score moved by the item's attributes, as in scoring.adjust_scores."""
    move = lambda a: (a["value"] - 5.5) * 9
    own = F.filter("_attributes", lambda a: (a["dimension"] == d) & ~(F.coalesce(a["evidence"], F.lit("")).startswith("LLM:") & (move(a) < 0)))
    zero = F.struct(F.lit(0.0).alias("moves"), F.lit(0.0).alias("sure"))
    add_up = lambda t, a: F.struct((t["moves"] + move(a) * a["confidence"] * a["n"]).alias("moves"), (t["sure"] + a["confidence"] * a["n"]).alias("sure"))
    s = F.col(f"_base_{d}") * 100
    moved = lambda by: scoring.clamp(0.7 * s + 0.3 * scoring.clamp(s + by, 0.0, 100.0), 0.0, 100.0) / 100
    return bound(F.aggregate(own, zero, add_up, lambda t: F.try_divide(t["moves"], t["sure"])), lambda by: F.when(by.isNull(), F.col(f"_base_{d}")).otherwise(moved(by)))


def scorable(content: DataFrame) -> DataFrame:
    """content without what is skipped, and with n_body, the characters of a body, in its place: the text goes no further."""
    kept = normalize.with_skip_reason(content).filter("skip_reason is null")
    return kept.withColumn("n_body", F.length(F.coalesce("body", F.lit("")))).drop("body", "skip_reason")


def score_rows(content: DataFrame, raw: DataFrame, claims: DataFrame, badges: DataFrame, attributes: DataFrame, visual: DataFrame, attr_map: DataFrame, defs: DataFrame, multipliers: DataFrame, as_of: Column) -> DataFrame:
    """One row for each item that is not skipped, with all that its score rests on.

    content(content_id, title, body, url, src, channel, author, published, rating, upvotes, helpful_count,
    has_guidelines), or scorable's rows of it; raw(content_id, provenance, transparency, coherence, resonance: scores of 0 to 1, 0.5 where there is
    none); claims(content_id, claim_no, claim, status, confidence, reasoning); badges(content_id) of accounts that show
    one; attributes(content_id, attribute_id, dimension, value, confidence, status, evidence), merged with issues
    beforehand where there are any; visual signals(content_id, signal_id, dimension, weight, value, confidence).

    Freshness, claims, multipliers of verification and coherence and engagement make the base signals. With guidelines,
    attributes give no voice signal. Returns the dimensions (0 to 1), overall (0 to 100), confidence, coverage, band,
    content_type, counts of claims and attributes, and meta, JSON of the dimensions, the multiplied scores, the scores
    moved by attributes, the issues of claims and the attributes. Items of one content_id must be one row; items missing
    from an input have nothing of it.
    """
    by = "content_id"
    kept = scorable(content) if "body" in content.columns else content
    items = _dealt(kept.select(by, "title", "n_body", "url", "src", "channel", "author", "published", "rating", "upvotes", "helpful_count", "has_guidelines"))
    raws = _dealt(raw.select(by, *[F.col(d).alias(f"_raw_{d}") for d in ("provenance", "transparency", "coherence", "resonance")]))
    checked = review.claim_results(_dealt(review.with_badges(claims, badges)))
    named = defs.agg(F.map_from_entries(F.collect_list(F.struct("signal_id", F.struct("dimension", "weight", "required", "knockout", "multiplier")))).alias("_defs"))
    own_defs = lambda d: F.map_filter("_defs", lambda _, v: v["dimension"] == d)
    named = named.select("_defs", *[own_defs(d).alias(f"_defs_{d}") for d in DIMENSIONS])
    factors = multipliers.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "dimension", "content_type"), "multiplier"))).alias("_factors"))
    sides = [raws, checked, _attributes(attributes, attr_map, defs), _visual(visual)]
    rows = reduce(lambda a, b: a.join(b.hint("shuffle_hash"), by, "left"), sides, items)
    rows = rows.join(F.broadcast(named), F.lit(True)).join(F.broadcast(factors), F.lit(True))  # a row each
    none = lambda kind: F.array().cast(f"array<{kind}>")
    filled = {c: F.coalesce(c, none(kind)) for c, kind in (("_mapped", _SIGNAL), ("_visual", _SIGNAL), ("_attributes", _ATTRIBUTE), ("claim_issues", _ISSUE))}
    rows = rows.withColumns(filled | {c: F.coalesce(c, F.lit(0)) for c in ("supported", "contradicted", "unverified")} | {"claim_score": F.coalesce("claim_score", F.lit(0.5)), "content_type": content_type(F.col("url"), F.col("channel"))})
    rows = rows.withColumns({f"_raw_{d}": F.coalesce(f"_raw_{d}", F.lit(0.5)) for d in ("provenance", "transparency", "coherence", "resonance")})
    factor = lambda d: F.coalesce(F.try_element_at("_factors", F.concat(F.lit(f"{d}|"), F.col("content_type"))), F.try_element_at("_factors", F.lit(f"{d}|_default")), F.lit(1.0))
    times = lambda x, d: F.when(factor(d) == 1, x).otherwise(F.least(F.lit(1.0), x * factor(d)))
    engaged = scoring.engagement_resonance(F.col("src"), F.col("rating"), F.col("upvotes"), F.col("helpful_count"))
    rows = rows.withColumns({
        "_base_provenance": F.col("_raw_provenance"), "_base_verification": times(F.col("claim_score"), "verification"), "_base_transparency": F.col("_raw_transparency"), "_base_coherence": times(F.col("_raw_coherence"), "coherence"),
        "_base_resonance": scoring.clamp(0.7 * F.col("_raw_resonance") + 0.3 * engaged), "_fresh": scoring.freshness(F.col("published"), as_of), "n_sources": F.col("supported") + F.col("contradicted") + F.col("unverified"),
    })
    sure = review.confidence_columns()
    value_of = {"prov_date_freshness": (F.col("_fresh"), F.lit(1.0))}

    def base(k: str, d: str, default: float) -> Column:
        value, confidence = value_of.get(k, (F.col(f"_base_{d}"), sure[d]))
        weight = F.coalesce(F.try_element_at("_defs", F.lit(k))["weight"], F.lit(default))
        return F.struct(F.lit(k).alias("signal_id"), F.lit(d).alias("dimension"), weight.alias("weight"), value.cast("double").alias("value"), confidence.cast("double").alias("confidence"), F.lit(True).alias("known"), F.lit(1).cast("bigint").alias("n"))

    mapped = F.filter("_mapped", lambda s: ~(F.coalesce(F.col("has_guidelines"), F.lit(False)) & (s["signal_id"] == "coh_voice_consistency")))
    rows = rows.withColumn("_signals", F.concat(F.array(*[base(k, *v) for k, v in BASE.items()]), mapped, F.col("_visual")))
    rows = rows.withColumns({f"_core_{d}": _core(d, F.col("_signals"), F.col(f"_defs_{d}")) for d in DIMENSIONS})
    rows = rows.withColumns({f"_dim_{d}": dimension_score(d, F.col("_signals"), F.col("_defs"), F.col(f"_defs_{d}")) for d in DIMENSIONS})
    dim = lambda d, k: F.col(f"_dim_{d}")[k]
    weigh = {d: F.when((dim(d, "value") > 0) | (dim(d, "coverage") > 0), DIMENSION_WEIGHTS.get(d, 0.2)).otherwise(0.0) for d in DIMENSIONS}
    mean = lambda k: F.coalesce(F.try_divide(reduce(add, [dim(d, k) * weigh[d] for d in DIMENSIONS]), reduce(add, weigh.values())), F.lit(0.0))
    rows = rows.withColumns({"overall": mean("value") * 10, "confidence": mean("confidence"), "coverage": mean("coverage")} | {f"_moved_{d}": _adjusted(d) for d in DIMENSIONS})
    places = lambda x, name: F.round(x, 9).alias(name)
    debug = lambda d, x: F.struct(places(x, "base_score"), factor(d).alias("multiplier"), places(F.col(f"_base_{d}"), "adjusted_score")).alias(d)
    meta = F.to_json(F.struct(
        "title", "url", "content_type",
        F.struct(*[F.struct(places(dim(d, "value"), "value"), places(dim(d, "confidence"), "confidence"), places(dim(d, "coverage"), "coverage"), dim(d, "level").alias("level")).alias(d) for d in DIMENSIONS]).alias("dimensions"),
        F.struct(debug("verification", F.col("claim_score")), debug("coherence", F.col("_raw_coherence"))).alias("score_debug"), F.struct(*[places(F.col(f"_moved_{d}"), d) for d in DIMENSIONS]).alias("adjusted"),
        "claim_issues", F.transform("_attributes", lambda a: a.dropFields("n")).alias("detected_attributes"), F.size("_attributes").alias("attribute_count"),
    ))
    counts = ["supported", "contradicted", "unverified"]
    return rows.select(by, *[(dim(d, "value") / 10).alias(d) for d in DIMENSIONS], "overall", "confidence", "coverage", scoring.band(F.round("overall", 9)).alias("band"), "content_type", *counts, F.size("_attributes").alias("n_attributes"), meta.alias("meta"))
