"""Hand-computed cases of the scoring formulas."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from contentgauge.functions import config, text, urls
from contentgauge.functions import config as C
from contentgauge.operators import assembly, normalize, scoring
from contentgauge.operators import scoring as S
from contentgauge.plans import scores as scores_plan
from contentgauge.sources.tables import DIMENSIONS
from tests.conftest import SF


def _signals(spark, rows):
    return spark.createDataFrame(rows, "e string, signal_id string, dimension string, value double, weight double, confidence double, status string")


@pytest.mark.parametrize(
    ("values", "value", "coverage", "confidence"),
    [([1.0, 0.8, 0.9], 9.0, 1.0, 0.975), ([0.0, 0.0, 0.0], 0.0, 1.0, 1.0), ([1.0], 6.0, 1 / 3, None)],
)
def test_dimension_score(spark, values, value, coverage, confidence):
    ids = ["prov_author_bylines", "prov_source_clarity", "prov_domain_trust"]
    conf = [1.0, 0.9, 0.95] if values[0] == 1.0 and len(values) == 3 else [1.0] * 3
    rows = [("a", i, "provenance", v, 0.2, c, "known") for i, v, c in zip(ids, values, conf, strict=False)]
    got = scoring.aggregate_dimensions(_signals(spark, rows), config.signal_defs(spark), ["e"]).filter("dimension = 'provenance'").first()
    assert got["coverage"] == pytest.approx(coverage)
    assert got["value"] == pytest.approx(value if len(values) < 3 or values[0] == 0 else (1.0 * 1.0 + 0.8 * 0.8 + 0.9 * 0.8) / 2.6 * 10)
    assert 0 <= got["confidence"] <= 1


def test_unknown_signal_counts_as_there_but_not_in_the_mean(spark):
    rows = [("a", "prov_author_bylines", "provenance", 0.0, 0.2, 1.0, "unknown"), ("a", "prov_source_clarity", "provenance", 0.9, 0.2, 1.0, "known"), ("a", "prov_domain_trust", "provenance", 0.9, 0.2, 1.0, "known")]
    got = scoring.aggregate_dimensions(_signals(spark, rows), config.signal_defs(spark), ["e"]).filter("dimension = 'provenance'").first()
    assert (got["value"], got["coverage"], got["level"]) == (pytest.approx(9.0), 1.0, "high")


def test_knockout_caps_at_four(spark):
    rows = [("a", i, "provenance", v, 0.2, 1.0, "known") for i, v in (("prov_author_bylines", 1.0), ("prov_source_clarity", 0.2), ("prov_domain_trust", 1.0))]
    got = scoring.aggregate_dimensions(_signals(spark, rows), config.signal_defs(spark), ["e"]).filter("dimension = 'provenance'").first()
    assert (got["value"], got["level"]) == (4.0, "medium")


def test_score_without_attributes_stays(spark):
    s = spark.createDataFrame([("c", "provenance", 0.5), ("c", "resonance", 0.5)], "content_id string, dimension string, score double")
    a = spark.createDataFrame([("c", "provenance", 10.0, 1.0, "rule")], "content_id string, dimension string, value double, confidence double, evidence string")
    got = {r["dimension"]: r["score"] for r in scoring.adjust_scores(s, a).collect()}
    assert got["resonance"] == 0.5 and got["provenance"] == pytest.approx(0.7 * 0.5 + 0.3 * 0.905)


def test_clean_text(spark):
    df = spark.createDataFrame([("  a&amp;lt;b   http://x.y/z?q=1 wow!!! why??  end..... ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.clean_text(F.col("t"))).collect()] == ["a<b  wow! why? end...", ""]


def test_triage_examples(spark):
    rows = [("Login", "x" * 150), ("Home", "x" * 50), ("Page not found", "x" * 200), ("Story", "x" * 200)]
    df = normalize.with_triage(spark.createDataFrame(rows, "title string, body string"))
    assert [r["reason"] for r in df.collect()] == ["functional_page", "too_short", "error_page", "passed"]


def test_dedup_keeps_the_first_of_equals(spark):
    rows = [(1, "t", "same text", 1.0, 0, 0.0), (2, "t", "same text", 1.0, 0, 0.0), (3, "t", "same text", 5.0, 0, 0.0), (4, "t", "other", None, None, None)]
    df = spark.createDataFrame(rows, "seq bigint, title string, body string, rating double, upvotes int, helpful_count double")
    assert sorted(r["seq"] for r in normalize.dedup_content(df).collect()) == [3, 4]
    assert sorted(r["seq"] for r in normalize.dedup_content(df.filter("seq < 3")).collect()) == [1]


def test_domain_parts(spark):
    df = spark.createDataFrame([("https://www.brand.com.au/p",), ("http://blog.brand.com/a",), ("http://brand.com",), ("nothing",)], "u string")
    got = [tuple(r[0]) for r in df.select(urls.domain_parts(F.col("u"))).collect()]
    assert got == [("brand.com.au", "www", "/p"), ("brand.com", "blog", "/a"), ("brand.com", "", ""), ("", "", "")]


def _assembled(spark):
    """An item that no other input knows, one with repeated attributes and a badge only, one that is skipped; clashing names."""
    body = "Some words that are long enough to be judged. " * 20
    columns = "content_id string, title string, body string, url string, src string, channel string, author string, published timestamp, rating double, upvotes int, helpful_count double, has_guidelines boolean, n int, _defs int"
    content = spark.createDataFrame([("a", "T", body, *[None] * 9, 1, 1), ("b", "T", body, "https://x.example/blog/1", "web", "web", "Ann", None, None, None, None, True, 1, 1), ("c", "T", "", *[None] * 9, 1, 1)], columns)
    none = lambda schema: spark.createDataFrame([], schema)
    attribute = ("b", "author_brand_identity_verified", "provenance", 10.0, 0.9, "present", "rule")
    attributes = spark.createDataFrame([attribute, attribute], "content_id string, attribute_id string, dimension string, value double, confidence double, status string, evidence string")
    badges = spark.createDataFrame([("b",)], "content_id string")
    claims = none("content_id string, claim_no int, claim string, status string, confidence double, reasoning string")
    raw, visual = none("content_id string, provenance double, transparency double, coherence double, resonance double"), none("content_id string, signal_id string, dimension string, weight double, value double, confidence double")
    factors = none("dimension string, content_type string, multiplier double")
    return assembly.score_rows(content, raw, claims, badges, attributes, visual, C.attribute_map(spark), C.signal_defs(spark), factors, F.current_timestamp())


def test_score_rows_deal_each_input_once(spark):
    """Content, raw scores, claims with badges, attributes and visual signals: five exchanges, whatever is joined and counted after them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation")
    try:
        plan = _assembled(spark)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.optimizer.excludedRules")
    own = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(own) == 5 and all("REPARTITION_BY_COL" in line for line in own)


def test_score_rows_with_missing_parts(spark):
    got = {r.content_id: r for r in _assembled(spark).collect()}
    assert got.keys() == {"a", "b"}
    assert (got["a"].supported, got["a"].n_attributes, got["a"].content_type) == (0, 0, "other") and json.loads(got["a"].meta)["claim_issues"] == []
    assert (got["b"].supported, got["b"].n_attributes, got["b"].content_type) == (1, 1, "blog") and json.loads(got["b"].meta)["score_debug"]["verification"]["base_score"] == 0.6
    assert got["b"].provenance > got["a"].provenance


def test_dimension_scores_in_the_row_equal_the_grouped_ones(spark):
    """The same signals through assembly.dimension_score and scoring.aggregate_dimensions."""
    signals = S.map_signals(scores_plan.attributes(spark, SF), C.attribute_map(spark), C.signal_defs(spark))
    grouped = {(r.content_id, r.dimension): r for r in S.aggregate_dimensions(signals, C.signal_defs(spark), ["content_id"]).collect()}
    listed = signals.groupBy("content_id").agg(F.collect_list(F.struct("signal_id", "dimension", "weight", "value", "confidence", (F.col("status") != "unknown").alias("known"), F.lit(1).cast("bigint").alias("n"))).alias("s"))
    defs = C.signal_defs(spark).agg(F.map_from_entries(F.collect_list(F.struct("signal_id", F.struct("dimension", "weight", "required", "knockout", "multiplier")))).alias("d"))
    rows = listed.join(F.broadcast(defs), F.lit(True)).withColumns({f"_core_{d}": assembly._core(d, F.col("s"), F.col("d")) for d in DIMENSIONS})
    met = 0
    for r in rows.select("content_id", *[assembly.dimension_score(d, F.col("s"), F.col("d")).alias(d) for d in DIMENSIONS]).collect():
        for d in DIMENSIONS:
            own, other = r[d], grouped[r.content_id, d]
            assert (own.level, pytest.approx(own.value), pytest.approx(own.confidence), own.coverage) == (other.level, other.value, other.confidence, pytest.approx(other.coverage))
            met += 1
    assert met == len(grouped) > 100
