"""Cases of the third round's findings."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__
from contentgauge.functions import text
from contentgauge.operators import normalize, review
from contentgauge.plans import attributes, runs, sources, trees
from contentgauge.sources.tables import DIMENSIONS
from contentgauge.streaming import jobs
from tests.conftest import SF, duck_rows, rows_of


def test_structured_body_of_short_articles(spark, tmp_path):
    """The twin of b16 has every step that a given page can come to: a short title whose paragraphs are enough, too little of all, and nothing but an advert."""
    page = "<html><body><nav><ul><li><a href='/a'>{nav}</a></li></ul></nav><div class=\"ad\">An advert's text.</div><article><h1>{h}</h1><p><b>{h}<br>{first}{rest}</p></article><footer>Foot</footer></body></html>"
    cases = [("Entry", "Ou.", "", 96), ("Entry", "Ou.", "", 95), ("Entry1", "Ou.", "", 97), ("Entry1", "Und so.", "", 80), ("Entry1", "Und so.", "x", 120), ("Entry", "", "", 3), ("Entry", "", "", 0), ("Entry1", "", "", 0)]
    rows = [(k, f"https://x.example/{k}", page.format(nav=n, h=h, first=f, rest="<p>" + "y" * size)) for k, (n, h, f, size) in enumerate(cases)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = trees.b16_structured_body(spark, str(tmp_path)).cache()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows_of(found) == duck_rows(c, __spark_entry__.oracle_sql()["b16_structured_body"])
    assert [r.text for r in found.filter("page_id = 2").orderBy("pos").collect()] == ["Ou.", "y" * 97]
    assert [(r.tag, r.text) for r in found.filter("page_id = 6").collect()] == [("div", "An advert's text.")]


@pytest.mark.parametrize("parts", [1, 3])
def test_rules_apply_in_their_own_order(spark, parts):
    """However rules are dealt over partitions, applied has them by rule_no, or by rule_id without one."""
    names = ["long", "short", "named"]
    rules = [(k, n, "bonus", 1.0, ["a"], None, None) for k, n in enumerate(names)]
    dealt = spark.createDataFrame(rules[::-1], "rule_no int, rule_id string, effect string, points double, keys array<string>, op string, threshold double").repartition(parts)
    item = spark.range(1).select(F.lit("c").alias("content_id"), *[F.lit(0.5).alias(f"score_{d}") for d in DIMENSIONS], F.create_map(F.lit("a"), F.lit("x")).alias("meta"))
    weights = dict.fromkeys(DIMENSIONS, 0.2)
    assert review.rubric_scores(item, dealt, weights).first()["applied"] == names
    assert review.rubric_scores(item, dealt.drop("rule_no"), weights).first()["applied"] == sorted(names)


def test_fingerprints_share_states(spark, tmp_path):
    """All fingerprints in one group's state: each is known for its own day, and goes on its own."""
    now, path, rows = dt.datetime(2024, 1, 1), str(tmp_path / "in"), str(tmp_path / "out")
    schema, states = "content_id string, title string, body string, event_time timestamp", []
    row = lambda i, body, hours: (i, "t", body, now + dt.timedelta(hours=hours))
    for part in ([row("b", "same", 0), row("a", "same", 0), row("c", "other", 20)], [row("d", "same", 23), row("e", "other", 43)], [row("f", "same", 43), row("g", "other", 44)], [row("h", "x", 200)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.dedup_stream(spark.readStream.schema(schema).parquet(path), groups=1)
        query = stream.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start(rows)
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(r.content_id for r in spark.read.parquet(rows).collect()) == ["a", "c", "f", "g", "h"] and states == [1, 1, 1, 1]


def test_texts_are_searched_once(spark):
    """Each costly pattern stands once in the plan, however many attributes and columns use what it finds."""
    plan = attributes.e_attributes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in ("billion", "cited by", "out of", "@[")] == [1, 1, 1, 1] and plan.count("https?:") == 1


def test_white_space_is_squeezed(spark):
    """Every run of white space becomes a space, also where a run begins with one."""
    texts = ["a b", "a  b", " a \n\tb\u00a0c\u2003 d ", "\n a", "a \u3000", "", "   "]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", text.squeeze(F.col("x")).alias("y")).orderBy("k").collect()
    assert [r.y for r in rows] == [" ".join(x.split()) for x in texts]


def test_texts_are_cleaned_once(spark):
    """The filter of rows without text doesn't clean title and body again, and a narrow table with fingerprints and lengths gives the same rows as texts do."""
    rows = [(1, " A  b ", "text &amp; more", 1.0, 1, 0.0), (2, None, " ", 1.0, 1, 0.0), (3, "A b", "text & more", 2.0, 1, 0.0), (4, "", "x", 0.0, 0, 0.0)]
    df = spark.createDataFrame(rows, "seq int, title string, body string, rating double, upvotes int, helpful_count double")
    cleaned = normalize.clean_content(df)
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("&nbsp;") == 2
    narrow = normalize.with_length(normalize.with_fingerprint(cleaned)).drop("title", "body")
    of = lambda x: [r.seq for r in normalize.validate_length(normalize.dedup_content(x)).collect()]
    assert [r.seq for r in cleaned.orderBy("seq").collect()] == [1, 3, 4] and of(cleaned) == of(narrow) == [3]


def _exchanged(node) -> set[str]:
    """The columns that a plan's exchanges deal."""
    own = {node.output().apply(k).name() for k in range(node.output().size())} if node.nodeName() == "Exchange" else set()
    return own.union(*(_exchanged(node.children().apply(k)) for k in range(node.children().size())))


def test_score_rows_leave_texts_behind(spark):
    """Of a body, its length and verdict are dealt; sums of a dimension are made in one go and the payload is parsed once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        done = runs.f13_score_rows(spark, SF)._jdf.queryExecution()
        assert "n_body" in (dealt := _exchanged(done.executedPlan())) and not dealt & {"text", "body"}
        plan = done.optimizedPlan().toString()
        assert plan.count("aggregate(") == 2 * len(DIMENSIONS) and "get_json_object(meta" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_gates_read_the_first_characters_only(spark):
    """A phrase counts up to the five-hundredth (errors) and the thousandth (logins) of the lower-cased characters, of which some characters give two."""
    cases = [("x" * 487 + "ACCESS DENIED", "error_page"), ("x" * 488 + "ACCESS DENIED", None), ("İ" * 243 + "x" + "access denied", "error_page"), ("İ" * 244 + "access denied", None), ("Σ" * 993 + "Captcha", "login_wall"), ("Σ" * 994 + "Captcha", None)]
    df = spark.createDataFrame([(k, "t", b + "y" * 600) for k, (b, _) in enumerate(cases)], "k int, title string, body string")
    assert [r.skip_reason for r in normalize.with_skip_reason(df).orderBy("k").collect()] == [why for _, why in cases]
    assert "lower(substring(coalesce(body" in normalize.with_skip_reason(df)._jdf.queryExecution().optimizedPlan().toString()


def test_retention_deals_each_table_once(spark, duck, monkeypatch):
    """Line items meet orders for the assets only, nothing is dealt by year before the retention, and in it assets meet old runs once to be counted and for the scores."""
    found, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        plan = self._df._jdf.queryExecution().optimizedPlan().toString()
        found.append((path.rsplit("/", 1)[1].split("-")[0], plan.count("Join "), plan.count("RebalancePartitions")))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    assert rows_of(sources.a11_prune_written(spark, SF)) == duck_rows(duck, __spark_entry__.oracle_sql()["a11_prune_written"])
    assert found[:4] == [("runs", 0, 0), ("assets", 1, 0), ("scores", 0, 0), ("summary", 0, 0)]
    assert [joins for name, joins, _ in found[4:] if name == "stage"] == [0, 1, 1, 0, 1, 1]  # old runs, their assets; partitions of scores, assets, summary and runs
