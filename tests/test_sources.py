"""Readers, sinks, streaming jobs, chunking and detectors on small hand-made tables."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from contentgauge.functions import pages as P
from contentgauge.operators import detectors, page_tree, review
from contentgauge.sources import readers, writers
from contentgauge.streaming import jobs


def test_assets_are_routed(spark, tmp_path):
    rows = [{"id": "1", "url": "u", "body": "text"}, {"id": "2", "url": "u2", "body": " "}, {"id": "3", "body": ""}, {"id": "4", "url": "u4", "html": "<p>x"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    have, fetch = readers.read_assets(spark, str(tmp_path / "a.json"))
    assert sorted(r["id"] for r in have.collect()) == ["1", "3", "4"] and [r["id"] for r in fetch.collect()] == ["2"]


def test_sources_to_content(spark):
    reddit = spark.createDataFrame([("x1", "me", "T", "", 0.9, 5, 0, "http://l", "/r/a/1", "a", 3)], "id string, author string, title string, selftext string, upvote_ratio double, score int, created_utc bigint, url string, permalink string, subreddit string, num_comments int")
    r = readers.from_reddit(reddit).first()
    assert (r["content_id"], r["url"], r["event_ts"], r["meta"]["content_type"], r["platform_type"]) == ("reddit_x1", "https://www.reddit.com/r/a/1", "1970-01-01T00:00:00", "link", "social")
    amazon = spark.createDataFrame([("7", "p", "pt", "pb", "n", "T", "C", 4, 2, True, "2024-01-01")], "review_id string, product_id string, product_title string, product_brand string, reviewer_name string, title string, content string, rating int, helpful_count int, verified_purchase boolean, review_date string")
    a = readers.from_amazon(amazon).first()
    assert (a["rating"], a["helpful_count"], a["meta"]["verified_purchase"], a["url"]) == (4.0, 2.0, "true", "https://www.amazon.com/dp/p")
    kind = "video_id string, title string, description string, channel_title string, publish_time string, view_count int, like_count int, comment_count int, comments array<struct<comment_id:string,author:string,text:string,like_count:int,published_at:string>>"
    videos = spark.createDataFrame([("v", "T", "D", "ch", "t", 1, 2, 30, [(f"c{k}", "a", "x", None, "t") for k in range(30)]), ("w", "T", "D", "ch", "t", 1, 2, 0, [("z", "a", "x", 1, "t")])], kind)
    assert readers.from_youtube(videos).count() == 2 and readers.from_youtube(videos, include_comments=True).count() == 22
    web = readers.from_web(spark.createDataFrame([("http://u", "T", "b" * 300, "http://t", None)], "url string, title string, body string, terms string, privacy string")).first()
    assert len(web["meta"]["description"]) == 200 and "privacy" not in web["meta"] and web["meta"]["terms"] == "http://t"


def test_sinks_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "b1", "s", "r1"), ("c2", "b1", "s", "r1"), ("c3", "b2", "s", "r1")], "content_id string, brand_id string, src string, run_id string")
    writers.write_content(rows, str(tmp_path))
    writers.write_scores(rows.limit(2), str(tmp_path))
    writers.write_content(rows.filter("brand_id = 'b2'"), str(tmp_path))  # other partitions stay
    back = spark.read.parquet(str(tmp_path / "content"))
    assert back.count() == 3 and "brand_id" in back.columns
    manifest = writers.run_manifest(back, spark.read.parquet(str(tmp_path / "scores")))
    assert {(r["table"], r["brand_id"]): r["n"] for r in manifest.collect()}["content", "b1"] == 2


def test_export_and_retention(spark, tmp_path):
    day = dt.datetime(2024, 3, 5, 10)
    runs = spark.createDataFrame([("r1", "b1", day), ("r2", "bx", day - dt.timedelta(days=100))], "run_id string, brand_id string, started_at timestamp")
    assets = spark.createDataFrame([("a1", "r1", "web"), ("a2", "r2", "web")], "asset_id string, run_id string, source_type string")
    scores = spark.createDataFrame([("a1", 0.8), ("a2", 0.1)], "asset_id string, overall double")
    brands = spark.createDataFrame([("b1", "brand-one")], "brand_id string, slug string")
    out = writers.export_run(runs, assets, scores, brands, "r1")
    assert {n: df.count() for n, df in out.items()} == {"runs": 1, "assets": 1, "scores": 1} and out["scores"].first()["brand_slug"] == "brand-one" and out["runs"].first()["month"] == "03"
    writers.write_export(out, str(tmp_path / "lake"))
    assert (tmp_path / "lake/assets/brand_slug=brand-one/year=2024/month=03/day=05").is_dir()
    assert writers.export_run(runs, assets, scores, brands, "r2")["runs"].first()["brand_slug"] == "unknown"
    writers.export_raw(out["assets"].select("asset_id", "run_id", "source_type", "brand_slug"), str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 1
    kept, gone = writers.prune_runs({"runs": runs, "assets": assets, "scores": scores, "summary": runs.select("run_id")}, day, 30)
    assert gone == 1 and all(df.count() == 1 for df in kept.values())


def test_retention_rewrites_only_what_it_must(spark, tmp_path):
    """Years with old runs only go, the year with both is written again, others keep their files; a second call deletes nothing."""
    root, day = str(tmp_path / "lake"), dt.datetime(2024, 3, 5)
    runs = spark.createDataFrame([("r1", day, 2024), ("r2", day - dt.timedelta(days=400), 2023), ("r3", day - dt.timedelta(days=100), 2023), ("r4", None, None)], "run_id string, started_at timestamp, year int")
    assets = spark.createDataFrame([("a1", "r1", 2024), ("a2", "r2", 2023), ("a3", "r3", 2023), ("a4", "r2", 2022), ("a5", "r4", None), (None, "r2", 2022)], "asset_id string, run_id string, year int")
    for name, df in {"runs": runs, "assets": assets, "scores": assets.drop("run_id")}.items():
        df.repartition("year").write.partitionBy("year").parquet(f"{root}/{name}")
    files = lambda: {str(f.relative_to(tmp_path)) for f in (tmp_path / "lake").rglob("*.parquet")}
    before = files()
    by = dict.fromkeys(["runs", "assets", "scores"], ["year"])
    assert writers.prune_written(spark, root, by, day, 365) == {"scores": 2, "assets": 3, "runs": 1}
    assert {r.asset_id for r in spark.read.parquet(f"{root}/assets").collect()} == {"a1", "a3", "a5"}
    assert {r.asset_id for r in spark.read.parquet(f"{root}/scores").collect()} == {"a1", "a3", "a5", None}  # a score without an id belongs to no run
    kept = before & files()
    assert all(f in kept for f in before if "year=2024" in f or "HIVE_DEFAULT" in f) and not any("year=2023" in f for f in kept) and not (tmp_path / "lake/assets/year=2022").exists()
    after = files()
    assert writers.prune_written(spark, root, by, day, 365) == {"scores": 0, "assets": 0, "runs": 0} and files() == after


@pytest.mark.parametrize("size", [50, 200])
def test_chunks(spark, size):
    text = "A sentence here. Another one follows! " * 40
    rows = review.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id bigint, text string"), size, 10).collect()
    own = [r for r in rows if r["doc_id"] == 1]
    assert all(r["text"] == text[r["start"] : r["end"]].strip() and len(r["text"]) <= size for r in own)
    assert all(b["start"] == a["end"] - 10 for a, b in zip(own, own[1:], strict=False)) and own[-1]["end"] == len(text)
    assert [r["text"] for r in rows if r["doc_id"] != 1] == ["short"]


def _detect(spark, rows, **kind):
    schema = "content_id string, title string, body string, src string, modality string, channel string, helpful_count double, url string, meta map<string,string>"
    found = detectors.detect_attributes(spark.createDataFrame([(f"c{k}", t, b, s, "text", "web", 0.0, u, m) for k, (t, b, s, u, m) in enumerate(rows)], schema), ["content_id"])
    return {(r["content_id"], r["attribute_id"]): (r["value"], round(r["confidence"], 3)) for r in found.collect()}


def test_detectors(spark):
    prose = "This sentence has exactly twelve words so that it reads quite well. " * 3
    got = _detect(
        spark,
        [
            ("T", prose, "web", "https://x.com/me", {"canonical_url": "https://x.com/me/", "author": "A", "has_c2pa_manifest": "true"}),
            ("T", "gonna buy now with 50% off, study found. See [1] or mail a@b.co", "amazon", None, {"verified_purchase": "true", "ssl_valid": "false"}),
            ("T", "hi", "web", "http://a.b/c", {"canonical_url": "http://other.org/", "exif_data": "x", "exif_status": "stripped", "watermark": "1"}),
        ],
    )
    assert got["c0", "readability_grade_level_fit"] == (10.0, 0.7) and got["c0", "canonical_url_matches_declared_source"] == (10.0, 1.0)
    assert got["c0", "ai_vs_human_labeling_clarity"] == (7.0, 0.9) and got["c0", "verified_platform_account"] == (3.0, 0.7)
    assert got["c1", "data_source_citations_for_claims"] == (10.0, 0.85) and got["c1", "ad_sponsored_label_consistency"] == (1.0, 0.8)
    assert got["c1", "review_authenticity_confidence"] == (8.0, 0.7) and got["c1", "source_domain_trust_baseline"] == (2.0, 0.9) and got["c1", "contact_info_availability"] == (10.0, 0.9)
    assert got["c2", "canonical_url_matches_declared_source"] == (1.0, 1.0) and got["c2", "exif_metadata_integrity"] == (5.0, 1.0) and got["c2", "digital_watermark_fingerprint_detected"] == (10.0, 1.0)
    assert ("c2", "readability_grade_level_fit") not in got


def test_readability_medians(spark):
    two = "one two three four five six seven eight nine ten eleven. " + "one two three four five six seven eight nine. "
    nav = "\n".join(f"menu entry {k}" for k in range(30))
    got = _detect(spark, [("", two, "web", None, {}), ("", nav, "web", None, {}), ("", "w " * 40 + ".", "web", None, {})])
    assert got["c0", "readability_grade_level_fit"][0] == 7.0 and ("c1", "readability_grade_level_fit") not in got and got["c2", "readability_grade_level_fit"][0] == 4.0


def test_page_expressions(spark):
    html = """<html><head><title> A &amp; B </title><link rel='canonical' href="http://c/x"><meta property="og:title" content="OT"><meta property="og:type" content="video.other">
    <meta name="description" content="d"><meta name="robots" content="noindex"><script type="application/ld+json">{"@type": "Article", "datePublished": "2024-01-02"}</script><script type="application/ld+json">{bad</script></head>
    <body><img src=a.png width="300px" class="photo"><img class="hero-logo" src=l.png><footer><a href="/terms">Terms</a> <a href=/p>Privacy policy</a></footer></body>"""
    df = spark.createDataFrame([(html,), ("<p>x",), (None,)], "h string")
    h = F.col("h")
    rows = df.select(P.title(h).alias("t"), P.canonical(h).alias("c"), P.open_graph(h).alias("og"), P.meta_tags(h).alias("m"), F.size(P.json_ld(h)).alias("j"), P.published(h).alias("p"), P.has_visuals(h).alias("v"), P.modality(F.lit(None).cast("string"), F.lit(""), F.lit(""), h).alias("k"), P.anchors(h).alias("a")).collect()
    r = rows[0]
    assert (r["t"], r["c"], r["og"], r["m"], r["j"], r["p"], r["v"], r["k"]) == ("A &amp; B", "http://c/x", {"og_title": "OT", "og_type": "video.other"}, {"description": "d", "robots": "noindex"}, 1, "2024-01-02", True, "video")
    assert [(a["href"], a["label"]) for a in r["a"]] == [("/terms", "Terms"), ("/p", "Privacy policy")]
    assert rows[1]["v"] is False and rows[1]["t"] == "" and rows[1]["k"] == "text"


def test_channels(spark):
    cases = [("https://www.youtube.com/w", "", "youtube", "social"), ("https://my.shop.io/", "src1", "src1", "marketplace"), ("http://blog.me.io", "", "blog", "owned"), (None, "s", "s", "unknown"), (None, None, "unknown", "unknown")]
    df = spark.createDataFrame([(u, s) for u, s, _, _ in cases], "u string, s string")
    assert [tuple(r[0]) for r in df.select(P.channel(F.col("u"), F.col("s"))).collect()] == [(c, k) for _, _, c, k in cases]


def _files(spark, path, rows):
    spark.createDataFrame(rows, "content_id string, title string, body string, event_time timestamp, src string, modality string, channel string, helpful_count double").coalesce(1).write.mode("append").parquet(path)


def test_fingerprints_are_known_for_a_day(spark, tmp_path):
    """An hour later the same text is known, 25 hours later it comes out again; what is older than a day has no state left; null text and ties."""
    now, path, rows = dt.datetime(2024, 1, 1), str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda i, body, hours: (i, "t", body, now + dt.timedelta(hours=hours), "web", "text", "web", 0.0)
    states = []
    for part in ([row("b", "same", 0), row("a", "same", 0), row("c", "other", 0.5), row("n", None, 0)], [row("d", "same", 1)], [row("e", "same", 25), row("late", "new but late", 2)], [row("f", "same", 25.5), row("g", "x", 60)], [row("h", "y", 120)]):
        _files(spark, path, part)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        query = jobs.dedup_stream(stream).writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start(rows)
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(r.content_id for r in spark.read.parquet(rows).collect()) == ["a", "c", "e", "g", "h", "late", "n"]
    assert states[0] == states[1] == 3 and states[-1] < max(states) and states[-1] <= 2


def test_daily_ratios_are_put_in_place(spark, tmp_path):
    """A day's row changes with new events, a repeated batch changes nothing, rows beyond the watermark are dropped with their state."""
    path, root = str(tmp_path / "in"), str(tmp_path / "rows")
    event = lambda day, hour, ok: ("b", dt.datetime(2024, 1, day, hour), ok)
    read = lambda: sorted((r.day.day, r.n, r.ratio_pct) for r in spark.read.parquet(root).collect())
    states = []
    for part in ([event(1, 1, True), event(1, 2, False)], [event(1, 3, True), event(2, 1, True)], [event(9, 1, True)], [event(1, 4, True), event(9, 2, False)], [event(20, 1, True)]):
        spark.createDataFrame(part, "brand_id string, event_time timestamp, is_authentic boolean").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("brand_id string, event_time timestamp, is_authentic boolean").parquet(path)
        query = jobs.run_ratio(stream, root, str(tmp_path / "c"))
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        if len(states) == 2:
            assert read() == [(1, 3, pytest.approx(200 / 3)), (2, 1, 100.0)]
    assert read() == [(1, 3, pytest.approx(200 / 3)), (2, 1, 100.0), (9, 2, 50.0), (20, 1, 100.0)] and states[-1] == 1
    rows = spark.read.parquet(root)
    again = spark.createDataFrame(rows.filter("date = '2024-01-09'").collect(), rows.schema)
    before = read()
    jobs.upsert(again, root, ["brand_id", "date"], "date")
    assert read() == before


def test_streams(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    row = lambda i, body, hours: (i, "t", body, now + dt.timedelta(hours=hours), "web", "text", "web", 0.0)
    _files(spark, path, [row("a", "same body", 0), row("b", "same body", 1), row("c", "x" * 150, 2), row("d", "", 3)])
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = {}

    def sink(gated, attributes, number):
        got[number] = ({r["content_id"]: r["skip_reason"] for r in gated.collect()}, {r["content_id"] for r in attributes.collect()})

    for _ in range(2):  # the second run starts from the checkpoint and finds only what is new
        jobs.run_gate(stream, sink, str(tmp_path / "c2")).awaitTermination()
        _files(spark, path, [row("e", "y" * 200, 4)])
    assert got[0] == ({"a": "insufficient_content", "b": "insufficient_content", "c": None, "d": "insufficient_content"}, {"c"}) and got[1] == ({"e": None}, {"e"})


def test_page_trees_of_odd_markup(spark):
    """Null and empty pages, text without tags, elements that are never closed or closed twice, the title of a page without a body, scripts and comments within text."""
    html = "<header>Top <nav>menu</nav></header><main><h1 class=x>Head line one</h1><p>Some text <b>bold</b> here.</p><ul><li class=price>Price 5 dollars</li></ul>" + "<p>Long enough paragraph of text.</p>" * 3 + "</main><div class='site-info'>Foot &copy;</div>"
    pages = [(1, html), (2, "<title>T</title><p>only <!-- x -->this</p></i><script>x</script>"), (3, None), (4, ""), (5, "bare < text"), (6, "<body><article><header><h1>Title</h1></header>Text.</article>"), (None, "<div>a" * 300)]
    trees = page_tree.page_trees(spark.createDataFrame([(i, f"https://x.example/{i}", h, "n") for i, h in pages], "page_id bigint, url string, html string, runs string")).cache()
    got = {r.page_id: r for r in page_tree.segments(trees).collect()}
    assert got[1].header_text == "Top menu" and got[1].footer_text == "Foot ©" and got[1].main_text.startswith("Head line one Some text bold here. Price 5 dollars Long")
    assert (got[6].main_text, got[6].header_text) == ("Title Text.", "Title")  # text of a header within an article is in both
    assert got[2].main_text == got[3].main_text == ""  # no body
    units = sorted((r.page_id or 0, r.pos, r.tag, r.role, r.text) for r in page_tree.structured_body(trees).collect())
    assert units[0][2:] == ("div", "body_text", " ".join(["a"] * 299)) and [u[2:] for u in units if u[0] == 1][:3] == [("h1", "headline", "Head line one"), ("p", "body_text", "Some text bold here."), ("li", "product_info", "Price 5 dollars")]
    assert [u[2:] for u in units if u[0] == 2] == [("p", "body_text", "only this")] and {u[0] for u in units} == {0, 1, 2}
    bodies = {r.page_id: (r.step, r.body) for r in page_tree.body_text(trees).collect()}
    assert bodies[2] == ("body", "only \n this") and bodies[3] == bodies[4] == ("body", "") and bodies[5] == ("body", "bare < text") and bodies[None][0] == "longest"


def test_page_trees_with_cards_and_nesting(spark):
    """Nested cards each count, at most 20 are listed, and the longest div that is no sidebar wins, the first of equals."""
    card = "<div class='product-card'><h3>Name {0}</h3><p class='cost'>{0} EUR</p></div>"
    grid = "<body><div class='product-grid'>" + "".join(card.format(k) for k in range(25)) + "</div></body>"
    few = "<body>" + card.format(1) * 2 + "<div class='x'>" + "long text " * 12 + "</div><div class='y'>" + "text long " * 12 + "</div></body>"
    trees = page_tree.page_trees(spark.createDataFrame([(1, grid), (2, few)], "page_id bigint, html string").withColumn("url", F.lit(None).cast("string")))
    units = [(r.page_id, r.tag, r.role, r.text) for r in page_tree.structured_body(trees).orderBy("page_id", "pos").collect()]
    assert units[:20] == [(1, "product_card", "product_listing", f"Name {k} ({k} EUR)") for k in range(20)]
    bodies = {r.page_id: r for r in page_tree.body_text(trees).collect()}
    # cards of the part "card" are also those with the name of the whole grid in them
    assert bodies[1].step == "grid" and bodies[1].body.count("\n") == 24 and bodies[2].step == "longest" and bodies[2].body.startswith("long text")


def test_badges_follow_the_url(spark):
    pages = [(1, "https://X.com/a", '<svg data-testid="icon-verified"></svg>'), (2, "https://www.linkedin.com/company/a", '<use href="#verified-medium"></use>'), (3, None, '<b title="verified">v</b>'), (4, "https://instagram.com/a", None)]
    trees = page_tree.page_trees(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    got = {r.page_id: (r.verified, r.platform, r.badge_type) for r in page_tree.verification_badges(trees).collect()}
    assert got == {1: (True, "twitter", "gold_checkmark"), 2: (True, "linkedin", "verified_account"), 3: (True, "unknown", "verification_badge"), 4: (False, "instagram", "")}
