"""Queries of the scoring and roll-up operators, with their SQL twins.

Scores, attributes and usage come from the ids of documents and events by whole-number arithmetic, so both engines see the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import config as C
from contentgauge.operators import analytics as A
from contentgauge.operators import scoring as S
from contentgauge.sources.tables import CONTENT_SQL, DIMENSIONS, SCORES_SQL, contents, scores, table

RUN = ["brand_id", "run_id"]
ATTRIBUTES = [(i, a, s) for i, (a, s) in enumerate(C.attribute_rows())]
_DIMENSION = {s[0]: s[1] for s in C.SIGNALS}


def attributes(spark, sf_dir):
    """About three of seven attributes of each document, with value, confidence, status and evidence from its id."""
    named = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a).alias("attribute_id"), F.lit(_DIMENSION[s]).alias("dimension")) for i, a, s in ATTRIBUTES])
    x = contents(spark, sf_dir).select("content_id", "seq", *RUN, F.explode(named).alias("a")).select("content_id", "seq", *RUN, "a.*")
    n, k = F.col("seq"), F.col("k")
    return x.filter(n * (k + 3) % 7 < 3).select(
        "content_id", *RUN, "attribute_id", "dimension", (n * (k + 11) % 10 + 1).cast("double").alias("value"), ((n + k) % 10 / 10.0 + 0.1).alias("confidence"),
        F.when((n + k) % 11 == 0, "unknown").otherwise("present").alias("status"), F.when((n + k) % 5 == 0, "LLM: issue").otherwise("rule").alias("evidence"),
    )


ATTR_SQL = CONTENT_SQL + f""",
named AS (SELECT * FROM ({C.values_sql([(i, a, _DIMENSION[s]) for i, a, s in ATTRIBUTES])}) AS t(k, attribute_id, dimension)),
attrs AS (SELECT content_id, brand_id, run_id, attribute_id, dimension, CAST(seq * (k + 11) % 10 + 1 AS DOUBLE) AS value, (seq + k) % 10 / 10.0 + 0.1 AS confidence,
 CASE WHEN (seq + k) % 11 = 0 THEN 'unknown' ELSE 'present' END AS status, CASE WHEN (seq + k) % 5 = 0 THEN 'LLM: issue' ELSE 'rule' END AS evidence
 FROM content, named WHERE seq * (k + 3) % 7 < 3)"""
DEFS_SQL = f"""defs AS (SELECT * FROM ({C.values_sql(C.signal_rows())}) AS t(signal_id, dimension, weight, required, knockout, multiplier)),
amap AS (SELECT * FROM ({C.values_sql(C.attribute_rows())}) AS t(attribute_id, signal_id))"""
SIGNAL_SQL = ATTR_SQL + ",\n" + DEFS_SQL + """,
sig AS (SELECT content_id, brand_id, run_id, signal_id, d.dimension, d.weight, least(1.0, greatest(0.0, value / 10)) AS value, confidence, status
 FROM attrs JOIN amap USING (attribute_id) JOIN defs AS d USING (signal_id))"""


def _dims_sql(keys: str, source: str = "sig") -> str:
    return f"""fold AS (SELECT {keys}, dimension, signal_id, sum(value * weight) FILTER (WHERE status <> 'unknown') AS vw, sum(weight) FILTER (WHERE status <> 'unknown') AS w,
 sum(confidence * weight) FILTER (WHERE status <> 'unknown') AS cw, max(CASE WHEN status = 'unknown' THEN 1.0 ELSE value END) AS best FROM {source} GROUP BY ALL),
tot AS (SELECT {keys}, f.dimension, sum(vw * multiplier) AS vw, sum(w * multiplier) AS w, sum(cw * multiplier) AS cw, count(*) FILTER (WHERE required) AS covered,
 bool_or(required AND best <= 0.3) AS low_core, bool_or(knockout AND best <= 0.3) AS ko FROM fold AS f JOIN defs AS d USING (signal_id) GROUP BY ALL),
need AS (SELECT dimension, count(*) FILTER (WHERE required) AS needed FROM defs GROUP BY dimension),
grid AS (SELECT DISTINCT {keys}, need.dimension, needed FROM {source}, need),
full_grid AS (SELECT {keys}, dimension, needed, coalesce(covered, 0) AS covered, coalesce(vw / w, 0) * 10 AS raw, coalesce(cw / w, 0) AS conf, coalesce(low_core, false) AS low_core, coalesce(ko, false) AS ko,
 coalesce(covered, 0) / needed AS coverage FROM grid LEFT JOIN tot USING ({keys}, dimension)),
dims AS (SELECT {keys}, dimension, greatest(0.0, least(raw, CASE WHEN coverage < 0.5 THEN 6.0 WHEN coverage < 0.8 THEN 8.0 ELSE 10.0 END,
 CASE WHEN ko THEN 4.0 WHEN low_core OR covered < needed THEN 6.0 ELSE 10.0 END)) AS value, conf * 0.5 + coverage * 0.5 AS confidence, coverage,
 CASE WHEN coverage >= 0.8 AND NOT ko THEN 'high' WHEN coverage >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM full_grid)"""


WEIGHT_SQL = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in C.DIMENSION_WEIGHTS.items()) + " ELSE 0.2 END"


def _trust_sql(keys: str) -> str:
    w = f"CASE WHEN value > 0 OR coverage > 0 THEN {WEIGHT_SQL} END"
    mean = lambda c: f"coalesce(sum({c} * {w}) / sum({w}), 0)"
    return f"trust AS (SELECT {keys}, {mean('value')} * 10 AS overall, {mean('confidence')} AS confidence, {mean('coverage')} AS coverage FROM dims GROUP BY {keys})"


CLASS_SQL = SCORES_SQL + """,
cls AS (SELECT *, CASE WHEN overall >= 0.75 THEN 'authentic' WHEN overall >= 0.4 THEN 'suspect' ELSE 'inauthentic' END AS class_label FROM (SELECT *, round((""" + " + ".join(f"score_{d} * 0.2" for d in DIMENSIONS) + """), 9) AS overall FROM scores))"""
LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT *, '{d}' AS dimension, score_{d} AS score FROM cls" for d in DIMENSIONS) + ")"


def _rounded(df, *names, places=9):
    return df.withColumns({n: F.round(n, places) for n in names})


def _signals(spark, sf_dir):
    return S.map_signals(attributes(spark, sf_dir), C.attribute_map(spark), C.signal_defs(spark))


def flagship(spark, sf_dir):
    """Attributes to signals, dimension scores, overall score and rating band of every document."""
    dims = S.aggregate_dimensions(_signals(spark, sf_dir), C.signal_defs(spark), ["content_id"])
    return _rounded(S.trust_score(dims, ["content_id"]).withColumn("band", S.band(F.round("overall", 9))), "overall", "confidence", "coverage")


def f1_map_signals(spark, sf_dir):
    return _rounded(_signals(spark, sf_dir).select("content_id", "signal_id", "dimension", "value", "weight", "confidence", "status"), "confidence")


def f2_freshness(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    as_of = F.to_timestamp(F.lit("1998-12-01"))
    return o.select("o_orderkey", S.freshness(F.col("o_orderdate").cast("timestamp"), as_of).alias("freshness"))


def f3_resonance(spark, sf_dir):
    c = scores(spark, sf_dir)
    e = S.engagement_resonance(F.col("channel"), F.col("rating"), F.col("upvotes"), F.col("helpful_count"))
    return c.select("content_id", F.round(e, 9).alias("engagement"), F.round(S.clamp(0.7 * F.col("score_resonance") + 0.3 * e), 9).alias("resonance"))


def f10_adjust_scores(spark, sf_dir):
    return _rounded(S.adjust_scores(A.unpivoted(scores(spark, sf_dir), ["content_id"]), attributes(spark, sf_dir)), "score")


def f11_dimension_scores(spark, sf_dir):
    return _rounded(S.aggregate_dimensions(_signals(spark, sf_dir), C.signal_defs(spark), ["content_id"]), "value", "confidence", "coverage")


def f12_run_trust(spark, sf_dir):
    return _rounded(S.trust_score(S.aggregate_dimensions(_signals(spark, sf_dir), C.signal_defs(spark), RUN), RUN), "overall", "confidence", "coverage")


def f14_ratings(spark, sf_dir):
    c = S.classify(scores(spark, sf_dir))
    return c.select("content_id", F.round(F.col("overall") * 100, 9).alias("rating"), S.band(F.round(F.col("overall") * 100, 9)).alias("band"))


def f15_classify(spark, sf_dir):
    return S.classify(scores(spark, sf_dir)).select("content_id", "overall", "class_label", "is_authentic")


def f16_class_confidence(spark, sf_dir):
    good, middle, bad = S.class_confidence(F.col("overall"))
    return S.classify(scores(spark, sf_dir)).select("content_id", F.round(good, 9).alias("authentic"), F.round(middle, 9).alias("suspect"), F.round(bad, 9).alias("inauthentic"))


def f18_top_uncertain(spark, sf_dir):
    return S.top_uncertain(S.classify(scores(spark, sf_dir)), RUN).select(*RUN, "content_id", "rank")


def f20_ratio(spark, sf_dir):
    return _rounded(S.authenticity_ratio(contents(spark, sf_dir), S.classify(scores(spark, sf_dir)), [*RUN, "src"]), "ratio_pct", "extended_pct")


def f20_ratio_overall(spark, sf_dir):
    return _rounded(S.ratio_overall(S.authenticity_ratio(contents(spark, sf_dir), S.classify(scores(spark, sf_dir)), [*RUN, "src"]), RUN), "ratio_pct")


def f21_fallback(spark, sf_dir):
    return _rounded(S.fallback_scores(contents(spark, sf_dir), scores(spark, sf_dir).filter("seq % 3 <> 0")), "score")


def f22_asset_scores(spark, sf_dir):
    return S.classify(scores(spark, sf_dir)).select("content_id", "overall", S.asset_class(F.col("overall")).alias("asset_class"))


def g1_dimension_breakdown(spark, sf_dir):
    return _rounded(A.dimension_breakdown(scores(spark, sf_dir), RUN), "average", "std")


def g2_dimension_by_class(spark, sf_dir):
    return _rounded(A.dimension_by_class(S.classify(scores(spark, sf_dir))), "average")


def g3_correlations(spark, sf_dir):
    return _rounded(A.dimension_correlations(scores(spark, sf_dir), RUN), "r")


def g4_bands(spark, sf_dir):
    return _rounded(A.band_distribution(S.classify(scores(spark, sf_dir)), RUN), "pct", "average")


def g5_content_type_pct(spark, sf_dir):
    return _rounded(A.share_of(scores(spark, sf_dir), RUN, "channel"), "pct")


def g7_modality(spark, sf_dir):
    return _rounded(A.modality_breakdown(scores(spark, sf_dir), RUN), "pct", "mean_trust")


def g8_channels(spark, sf_dir):
    return _rounded(A.channel_breakdown(scores(spark, sf_dir), RUN), "mean_score")


def _performance(spark, sf_dir):
    return A.attribute_performance(attributes(spark, sf_dir), contents(spark, sf_dir), RUN)


def g9_attribute_performance(spark, sf_dir):
    return _rounded(_performance(spark, sf_dir), "average", "rate")


def g10_critical_attributes(spark, sf_dir):
    return _rounded(A.critical_attributes(_performance(spark, sf_dir), RUN).select(*RUN, "attribute_id", "impact", "rank"), "impact")


def g11_attribute_gaps(spark, sf_dir):
    return _rounded(A.attribute_gaps(_performance(spark, sf_dir), RUN).select(*RUN, "attribute_id", "impact", "rank", "priority"), "impact")


def g12_extremes(spark, sf_dir):
    return A.extremes(S.classify(scores(spark, sf_dir)), RUN).select(*RUN, "content_id", "overall", "list", "rank")


def g12_trust_lists(spark, sf_dir):
    return A.trust_lists(S.classify(scores(spark, sf_dir)), RUN).select(*RUN, "content_id", "overall", "strongest", "weakest", "list", "rank")


def g12_egregious(spark, sf_dir):
    return A.egregious(S.classify(scores(spark, sf_dir))).select(*RUN, "content_id", "overall", "class_label")


def g18_run_presence(spark, sf_dir):
    return A.run_presence(contents(spark, sf_dir), scores(spark, sf_dir).filter("seq % 9 < 4"))


def g19_trend(spark, sf_dir):
    ratios = S.ratio_overall(S.authenticity_ratio(contents(spark, sf_dir), S.classify(scores(spark, sf_dir)), [*RUN, "src"]), RUN)
    return _rounded(A.ratio_trend(ratios, ["brand_id"], "run_id", "ratio_pct").select(*RUN, "ratio_pct", "previous", "delta", "direction"), "ratio_pct", "previous", "delta")


def g19_totals(spark, sf_dir):
    """Orders as runs of customers as brands: the key's last two digits are its items, the price its rating."""
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_custkey").alias("brand_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_orderkey") % 100).alias("items"), F.col("o_totalprice").alias("rating"))
    return _rounded(A.run_totals(runs, F.to_timestamp(F.lit("2001-08-02"))), "average", places=4)


MODELS = ["gpt-4o", "gpt-4o-mini-2024-07-18", "claude-3-opus-latest", "o1-mini", "other-model", "gemini-1.5-pro-002"]


def usage(spark, sf_dir):
    """A call for each conversation turn; tokens are a quarter of the characters."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("run_"), (F.col("conv_id") % 4).cast("string")).alias("run_id"), F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % 6 + 1).cast("int")).alias("model"),
        F.floor(F.length("text") / 4).alias("prompt_tokens"), (F.col("turn") * 7 + 1).alias("completion_tokens"),
    )


def g20_usage_cost(spark, sf_dir):
    return _rounded(A.usage_cost(usage(spark, sf_dir), C.prices(spark), ["run_id"], C.DEFAULT_MODEL), "cost_usd")


def g27_dimension_examples(spark, sf_dir):
    return _rounded(A.dimension_examples(scores(spark, sf_dir), RUN), "share_high", "share_low")


QUERIES = {
    f.__name__: f
    for f in (
        flagship, f1_map_signals, f2_freshness, f3_resonance, f10_adjust_scores, f11_dimension_scores, f12_run_trust, f14_ratings, f15_classify, f16_class_confidence, f18_top_uncertain, f20_ratio,
        f20_ratio_overall, f21_fallback, f22_asset_scores, g1_dimension_breakdown, g2_dimension_by_class, g3_correlations, g4_bands, g5_content_type_pct, g7_modality, g8_channels,
        g9_attribute_performance, g10_critical_attributes, g11_attribute_gaps, g12_extremes, g12_trust_lists, g12_egregious, g18_run_presence, g19_trend, g19_totals, g20_usage_cost, g27_dimension_examples,
    )
}

_BAND = lambda x: f"CASE WHEN {x} >= 80 THEN 'excellent' WHEN {x} >= 60 THEN 'good' WHEN {x} >= 40 THEN 'fair' ELSE 'poor' END"
_ENG = """least(1.0, greatest(0.0, 0.5 + CASE channel WHEN 'amazon' THEN (rating - 3) * 0.1 WHEN 'reddit' THEN (rating - 0.5) * 0.2 ELSE 0 END
 + log10(greatest(1.0, upvotes)) / 3 * 0.1 + least(helpful_count / 20, 1.0) * 0.1))"""
RATIO_SQL = CLASS_SQL + """,
ratio AS (SELECT brand_id, run_id, src, count(*) AS total_items, count(*) FILTER (WHERE class_label = 'authentic') AS authentic_items, count(*) FILTER (WHERE class_label = 'suspect') AS suspect_items,
 count(*) FILTER (WHERE class_label = 'inauthentic') AS inauthentic_items, 100.0 * count(*) FILTER (WHERE class_label = 'authentic') / count(*) AS ratio_pct,
 100.0 * (count(*) FILTER (WHERE class_label = 'authentic') + 0.5 * count(*) FILTER (WHERE class_label = 'suspect')) / count(*) AS extended_pct FROM cls GROUP BY ALL),
total AS (SELECT brand_id, run_id, CAST(sum(total_items) AS BIGINT) AS total_items, CAST(sum(authentic_items) AS BIGINT) AS authentic_items, CAST(sum(suspect_items) AS BIGINT) AS suspect_items,
 CAST(sum(inauthentic_items) AS BIGINT) AS inauthentic_items, avg(ratio_pct) AS ratio_pct FROM ratio GROUP BY ALL)"""
PERF_SQL = ATTR_SQL + """,
items AS (SELECT brand_id, run_id, count(*) AS items FROM content GROUP BY ALL),
perf AS (SELECT brand_id, run_id, dimension, attribute_id, avg(value) AS average, min(value) AS low, max(value) AS high, count(*) AS detections, items, count(*) / items AS rate FROM attrs JOIN items USING (brand_id, run_id) GROUP BY brand_id, run_id, dimension, attribute_id, items)"""
_ALLSCORES = "(" + " + ".join(f"avg(score_{d})" for d in DIMENSIONS) + ") / 5"
_PAIRS = [(a, b) for i, a in enumerate(sorted(DIMENSIONS)) for b in sorted(DIMENSIONS)[i + 1 :]]

ORACLES = {
    "flagship": f"WITH {SIGNAL_SQL}, {_dims_sql('content_id')}, {_trust_sql('content_id')} SELECT content_id, round(overall, 9) AS overall, round(confidence, 9) AS confidence, round(coverage, 9) AS coverage, {_BAND('round(overall, 9)')} AS band FROM trust",
    "f1_map_signals": f"WITH {SIGNAL_SQL} SELECT content_id, signal_id, dimension, value, weight, round(confidence, 9) AS confidence, status FROM sig",
    "f2_freshness": """SELECT o_orderkey, CASE WHEN a < 30 THEN 1.0 WHEN a < 90 THEN 0.9 WHEN a < 180 THEN 0.8 WHEN a < 365 THEN 0.6 WHEN a IS NULL THEN 0.5 ELSE 0.4 END AS freshness
FROM (SELECT o_orderkey, floor((epoch(TIMESTAMP '1998-12-01') - epoch(o_orderdate)) / 86400) AS a FROM orders)""",
    "f3_resonance": f"WITH {SCORES_SQL} SELECT content_id, round({_ENG}, 9) AS engagement, round(least(1.0, greatest(0.0, 0.7 * score_resonance + 0.3 * {_ENG})), 9) AS resonance FROM scores",
    "f10_adjust_scores": f"""WITH {ATTR_SQL}, {CLASS_SQL.replace(CONTENT_SQL + ',', '')}, {LONG_SQL},
mv AS (SELECT content_id, dimension, sum((value - 5.5) * 9 * confidence) / sum(confidence) AS move FROM attrs WHERE NOT (starts_with(evidence, 'LLM:') AND value < 5.5) GROUP BY ALL)
SELECT content_id, dimension, round(CASE WHEN move IS NULL THEN score ELSE least(100.0, greatest(0.0, 0.7 * score * 100 + 0.3 * least(100.0, greatest(0.0, score * 100 + move)))) / 100 END, 9) AS score FROM long LEFT JOIN mv USING (content_id, dimension)""",
    "f11_dimension_scores": f"WITH {SIGNAL_SQL}, {_dims_sql('content_id')} SELECT content_id, dimension, round(value, 9) AS value, round(confidence, 9) AS confidence, round(coverage, 9) AS coverage, level FROM dims",
    "f12_run_trust": f"WITH {SIGNAL_SQL}, {_dims_sql('brand_id, run_id')}, {_trust_sql('brand_id, run_id')} SELECT brand_id, run_id, round(overall, 9) AS overall, round(confidence, 9) AS confidence, round(coverage, 9) AS coverage FROM trust",
    "f14_ratings": f"WITH {CLASS_SQL} SELECT content_id, round(overall * 100, 9) AS rating, {_BAND('round(overall * 100, 9)')} AS band FROM cls",
    "f15_classify": f"WITH {CLASS_SQL} SELECT content_id, overall, class_label, class_label = 'authentic' AS is_authentic FROM cls",
    "f16_class_confidence": f"""WITH {CLASS_SQL}, p AS (SELECT content_id, greatest(0.0, overall - 0.75) / 0.25 AS g, least(least(1.0, (0.75 - overall) / 0.35), greatest(0.0, (overall - 0.4) / 0.35)) AS m, greatest(0.0, 0.4 - overall) / 0.4 AS b FROM cls)
SELECT content_id, round(CASE WHEN g + m + b > 0 THEN g / (g + m + b) ELSE g END, 9) AS authentic, round(CASE WHEN g + m + b > 0 THEN m / (g + m + b) ELSE m END, 9) AS suspect, round(CASE WHEN g + m + b > 0 THEN b / (g + m + b) ELSE b END, 9) AS inauthentic FROM p""",
    "f18_top_uncertain": f"WITH {CLASS_SQL} SELECT brand_id, run_id, content_id, row_number() OVER (PARTITION BY brand_id, run_id ORDER BY round(abs(overall - 0.575), 9), seq) AS rank FROM cls WHERE class_label = 'suspect' QUALIFY rank <= 10",
    "f20_ratio": f"WITH {RATIO_SQL} SELECT * REPLACE (round(ratio_pct, 9) AS ratio_pct, round(extended_pct, 9) AS extended_pct) FROM ratio",
    "f20_ratio_overall": f"WITH {RATIO_SQL} SELECT * REPLACE (round(ratio_pct, 9) AS ratio_pct) FROM total",
    "f21_fallback": f"""WITH {CONTENT_SQL}, f AS (SELECT content_id, CASE WHEN length(body) = 0 THEN 0.5 ELSE least(1.0, 0.3 + length(body) / 2000) END AS score FROM content WHERE seq % 3 = 0)
SELECT content_id, round(score, 9) AS score, CASE WHEN score >= 0.4 THEN 'fair' ELSE 'poor' END AS label FROM f""",
    "f22_asset_scores": f"WITH {CLASS_SQL} SELECT content_id, overall, CASE WHEN overall >= 0.75 THEN 'excellent' WHEN overall >= 0.5 THEN 'good' WHEN overall >= 0.25 THEN 'fair' ELSE 'poor' END AS asset_class FROM cls",
    "g1_dimension_breakdown": f"WITH {CLASS_SQL}, {LONG_SQL} SELECT brand_id, run_id, dimension, round(avg(score), 9) AS average, min(score) AS low, max(score) AS high, round(coalesce(stddev_samp(score), 0), 9) AS std FROM long GROUP BY ALL",
    "g2_dimension_by_class": f"WITH {CLASS_SQL}, {LONG_SQL} SELECT dimension, coalesce(class_label, 'all') AS class_label, count(*) AS n, round(avg(score), 9) AS average FROM long GROUP BY GROUPING SETS ((dimension, class_label), (dimension))",
    "g3_correlations": f"WITH {SCORES_SQL}, c AS (" + " UNION ALL ".join(f"SELECT brand_id, run_id, '{a}~{b}' AS pair, corr(score_{a}, score_{b}) AS r FROM scores GROUP BY ALL" for a, b in _PAIRS) + ") SELECT brand_id, run_id, pair, round(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END, 9) AS r FROM c",
    "g4_bands": f"""WITH {CLASS_SQL}, b AS (SELECT brand_id, run_id, {_BAND('overall * 100')} AS band FROM cls), t AS (SELECT brand_id, run_id, count(*) AS total, avg(overall * 100) AS average FROM cls GROUP BY ALL),
n AS (SELECT brand_id, run_id, band, count(*) AS n FROM b GROUP BY ALL)
SELECT brand_id, run_id, x.band, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / total, 9) AS pct, round(average, 9) AS average FROM t CROSS JOIN (VALUES ('excellent'), ('good'), ('fair'), ('poor')) AS x(band) LEFT JOIN n USING (brand_id, run_id, band)""",
    "g5_content_type_pct": f"WITH {SCORES_SQL} SELECT brand_id, run_id, channel, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY brand_id, run_id), 9) AS pct FROM scores GROUP BY brand_id, run_id, channel",
    "g7_modality": f"""WITH {CLASS_SQL}, {LONG_SQL}, i AS (SELECT brand_id, run_id, modality, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY brand_id, run_id) AS pct FROM cls GROUP BY brand_id, run_id, modality),
p AS (SELECT brand_id, run_id, modality, dimension, avg(score) AS a, sum(score) AS s, count(*) AS c FROM long GROUP BY ALL)
SELECT brand_id, run_id, modality, n, round(pct, 9) AS pct, round(sum(s) / sum(c), 9) AS mean_trust, CASE WHEN round(sum(s) / sum(c), 9) >= 0.8 THEN 'excellent' WHEN round(sum(s) / sum(c), 9) >= 0.6 THEN 'good' WHEN round(sum(s) / sum(c), 9) >= 0.4 THEN 'moderate' ELSE 'poor' END AS status, max_by(dimension, (round(a, 9), dimension)) AS best, min_by(dimension, (round(a, 9), dimension)) AS worst
FROM i JOIN p USING (brand_id, run_id, modality) GROUP BY ALL""",
    "g8_channels": f"WITH {SCORES_SQL} SELECT brand_id, run_id, channel, modality, count(*) AS n, count(DISTINCT src) AS sources, round({_ALLSCORES}, 9) AS mean_score FROM scores GROUP BY GROUPING SETS ((brand_id, run_id, channel, modality), (brand_id, run_id, channel))",
    "g9_attribute_performance": f"WITH {PERF_SQL} SELECT * REPLACE (round(average, 9) AS average, round(rate, 9) AS rate) FROM perf",
    "g10_critical_attributes": f"WITH {PERF_SQL} SELECT brand_id, run_id, attribute_id, round(impact, 9) AS impact, rank FROM (SELECT *, row_number() OVER (PARTITION BY brand_id, run_id ORDER BY impact DESC, attribute_id) AS rank FROM (SELECT *, round(abs(average - 5) * rate, 9) AS impact FROM perf)) WHERE rank <= 5",
    "g11_attribute_gaps": f"""WITH {PERF_SQL} SELECT brand_id, run_id, attribute_id, round(impact, 9) AS impact, rank, CASE WHEN rank <= 3 THEN 'high' WHEN rank <= 6 THEN 'medium' ELSE 'low' END AS priority
FROM (SELECT *, row_number() OVER (PARTITION BY brand_id, run_id ORDER BY impact DESC, attribute_id) AS rank FROM (SELECT *, round((7 - average) * {WEIGHT_SQL} * rate, 9) AS impact FROM perf WHERE average < 7)) WHERE rank <= 8""",
    "g12_extremes": f"""WITH {CLASS_SQL}, x AS (SELECT *, 'best' AS list, -overall AS o FROM cls UNION ALL SELECT *, 'worst', overall FROM cls)
SELECT brand_id, run_id, content_id, overall, list, row_number() OVER (PARTITION BY brand_id, run_id, list ORDER BY o, seq) AS rank FROM x QUALIFY rank <= 5""",
    "g12_trust_lists": f"""WITH {CLASS_SQL}, {LONG_SQL}, d AS (SELECT content_id, arg_max(dimension, (score, -ascii(dimension), -ascii(dimension[3]))) AS strongest, arg_min(dimension, (score, dimension)) AS weakest FROM long GROUP BY content_id),
x AS (SELECT *, 'low' AS list, overall AS o, 10 AS n FROM cls WHERE class_label = 'inauthentic' OR overall < 0.5 UNION ALL SELECT *, 'moderate', overall, 10 FROM cls WHERE overall >= 0.5 AND class_label <> 'inauthentic' AND (class_label = 'suspect' OR overall < 0.7)
 UNION ALL SELECT *, 'notable_high', -overall, 5 FROM cls WHERE overall >= 0.7 UNION ALL SELECT *, 'notable_low', -overall, 3 FROM cls WHERE overall < 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY brand_id, run_id, list ORDER BY o, seq) AS rank FROM x) SELECT brand_id, run_id, content_id, overall, strongest, weakest, list, rank FROM r JOIN d USING (content_id) WHERE rank <= n""",
    "g12_egregious": f"WITH {CLASS_SQL} SELECT brand_id, run_id, content_id, overall, class_label FROM cls WHERE class_label = 'inauthentic' OR overall <= 0.4",
    "g19_totals": """WITH w AS (SELECT 'all' AS "window", DATE '0001-01-01' AS since UNION ALL SELECT '7 days', DATE '2001-07-26' UNION ALL SELECT '30 days', DATE '2001-07-03' UNION ALL SELECT '90 days', DATE '2001-05-04')
SELECT "window", count(*) AS runs, count(DISTINCT o_custkey) AS brands, CAST(sum(o_orderkey % 100) AS BIGINT) AS items, round(avg(o_totalprice) FILTER (WHERE o_orderkey % 100 > 0), 4) AS average FROM w JOIN orders ON o_orderdate >= since GROUP BY ALL""",
    "g18_run_presence": f"""WITH {SCORES_SQL}, n AS (SELECT run_id, brand_id, src, count(*) AS normalized_rows FROM content GROUP BY ALL), s AS (SELECT run_id, brand_id, src, count(*) AS scores_rows FROM scores WHERE seq % 9 < 4 GROUP BY ALL)
SELECT run_id, brand_id, src, normalized_rows, scores_rows, normalized_rows IS NOT NULL AS in_normalized, scores_rows IS NOT NULL AS in_scores FROM n FULL JOIN s USING (run_id, brand_id, src)""",
    "g19_trend": f"""WITH {RATIO_SQL}, l AS (SELECT brand_id, run_id, ratio_pct, lag(ratio_pct) OVER (PARTITION BY brand_id ORDER BY run_id) AS previous FROM total), d AS (SELECT *, round(ratio_pct - previous, 9) AS delta FROM l)
SELECT brand_id, run_id, round(ratio_pct, 9) AS ratio_pct, round(previous, 9) AS previous, round(delta, 9) AS delta, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' WHEN delta = 0 THEN 'flat' ELSE 'first' END AS direction FROM d""",
    "g20_usage_cost": f"""WITH log AS (SELECT 'run_' || conv_id % 4 AS run_id, {MODELS}[conv_id % 6 + 1] AS model, length(text) // 4 AS prompt_tokens, turn * 7 + 1 AS completion_tokens FROM conversations),
price AS (SELECT * FROM ({C.values_sql([(m, *p) for m, p in C.PRICES.items()])}) AS t(known_model, input, output)),
used AS (SELECT run_id, model, sum(prompt_tokens) AS p, sum(completion_tokens) AS c, count(*) AS calls FROM log GROUP BY ALL),
best AS (SELECT model, max_by(input, length(known_model)) AS input, max_by(output, length(known_model)) AS output FROM (SELECT DISTINCT model FROM log) JOIN price ON starts_with(model, known_model) GROUP BY model),
priced AS (SELECT *, p / 1e6 * coalesce(input, 0.15) + c / 1e6 * coalesce(output, 0.6) AS cost FROM used LEFT JOIN best USING (model)),
rolled AS (SELECT run_id, model, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(calls) AS BIGINT) AS calls, sum(cost) AS cost_usd FROM priced GROUP BY GROUPING SETS ((run_id, model), (run_id)))
SELECT * REPLACE (round(cost_usd, 9) AS cost_usd), prompt_tokens > 100000 OR completion_tokens > 50000 OR cost_usd > 1.0 AS over_quota FROM rolled""",
    "g27_dimension_examples": f"""WITH {CLASS_SQL}, {LONG_SQL}, x AS (SELECT *, 'best' AS list, -score AS o FROM long UNION ALL SELECT *, 'worst', score FROM long),
r AS (SELECT brand_id, run_id, dimension, content_id, score, list, row_number() OVER (PARTITION BY brand_id, run_id, dimension, list ORDER BY o, seq) AS rank FROM x QUALIFY rank <= 5),
s AS (SELECT brand_id, run_id, dimension, count(*) FILTER (WHERE score >= 0.7) / count(*) AS share_high, count(*) FILTER (WHERE score < 0.4) / count(*) AS share_low FROM long GROUP BY ALL)
SELECT r.*, round(share_high, 9) AS share_high, round(share_low, 9) AS share_low FROM r JOIN s USING (brand_id, run_id, dimension)""",
}
