"""Text operators that SQL cannot express, against brute force."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from contentgauge.functions import pages as P
from contentgauge.functions import text as T
from contentgauge.functions import urls as U
from contentgauge.operators import normalize as N
from tests.conftest import SF


def brute_summary(body, description, most=240):
    """Two sentences by the definition."""

    def short(t):
        t = t.strip(" ")
        if len(t) <= most:
            return t
        cut = t[:most]
        if (at := cut.rfind(".")) > most // 2:
            return cut[: at + 1].strip(" ") + "…"
        return re.sub("[.,;:]+$", "", cut.rsplit(" ", 1)[0]) + "…"

    if not body:
        return ""
    if len((description or "").strip(" ")) >= 30:
        return short(description)
    clean = re.sub(r"\s+", " ", body).strip(" ")
    for p in T.UI_PHRASES:
        clean = clean.replace(p, "")
    clean = re.sub("[-_=]{2,}", " ", re.sub(r"(?:\b[A-Za-z]{1,3}\b\s*){1,4}", "", clean)).strip(" ")
    if len(clean) <= most:
        return clean
    parts = [s.strip(" ") for s in re.split(r"(?<=[.!?])\s+", clean)]
    parts = [s for s in parts if len(s) > 10]
    if len(parts) <= 2:
        return short(" ".join(parts) or clean)

    def weight(s):
        words = re.findall(r"\w+", s.lower())
        return round(sum(1 / math.sqrt(words.count(w)) for w in dict.fromkeys(words)) * min(1.5, len(words) / 10), 6)

    ranked = sorted(range(len(parts)), key=lambda i: -weight(parts[i]))[:6]
    chosen = {}
    for i in ranked:
        if len(chosen) < 2:
            chosen.setdefault(parts[i].lower(), parts[i])
    return short(" ".join([s for s in parts if s in chosen.values()][:2]))


def test_summaries_equal_brute_force(spark):
    docs = {f"doc_{r['doc_id']}": (r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["d13_summaries"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, text = docs[r["content_id"]]
        described = f"  A description of document {n}, ends." if n % 5 == 0 else "short" if n % 5 == 1 else None
        assert r["summary"] == brute_summary(text, described), n


def test_summary_edges(spark):
    long = "This sentence has quite some different words. " * 3 + "Another sentence follows here, longer than others are. " + "Final words " + "and more words " * 20
    rows = [None, "", " ", "short one", "x" * 500, long, "Read more " * 50, "Wordy " * 100]
    got = [r["summary"] for r in N.summarize(spark.createDataFrame([(b, None) for b in rows], "body string, description string")).collect()]
    assert got == [brute_summary(b, None) for b in rows]


def test_resolved_links(spark):
    from urllib.parse import urljoin

    bases = ["https://a.example/x/y?q=1#f", "http://a.example", "https://a.example/x/y/"]
    hrefs = ["/p", "p", "../p", "../../../p?x=/../y", "./", "..", "//b.example/c", "#top", "?z=1", "https://c.example/", "mailto:a@b", "p/./q/../r#s"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "base string, href string").select("base", "href", U.resolve(F.col("base"), F.col("href")).alias("to")).collect()
    assert [(r["base"], r["href"], r["to"]) for r in got] == [(b, h, urljoin(b, h)) for b, h in rows]


def test_login_pages(spark):
    yes = ["https://login.a.example/", "https://a.example/x/Sign-In", "https://a.example/x/account.aspx", "https://a.example/?ACTION=login", "https://a.example/p?next=/", "https://a.example/#/register", "https://a.example/#login", "https://a.example/blog/authors"]
    no = ["https://a.example/", "https://a.example/catalog?item=5#reviews", "https://a.example/about/company", "https://mylogin.example/", None, ""]
    got = spark.createDataFrame([(u,) for u in yes + no], "url string").select(U.is_login(F.col("url"))).collect()
    assert [r[0] for r in got] == [True] * len(yes) + [False] * len(no)


def test_json_ld_is_opened(spark):
    texts = ['{"@graph": [{"a": 1}, {"json_ld": [{"b": 2}, [{"c": 3}]]}]}', '[1, "x", {"d": 4}]', '{"@graph": {"e": 5}}', "{bad", None, '{"author": "Jo"}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.transform(P.flat_json_ld(F.try_parse_json("t")), lambda v: F.to_json(v)).alias("o"), P.names_in(F.col("t"), "author").alias("n")).collect()
    assert [r["o"] for r in got] == [['{"a":1}', '{"b":2}', '{"c":3}'], ['{"d":4}'], ['{"e":5}'], [], [], ['{"author":"Jo"}']] and [r["n"] for r in got] == [[]] * 5 + [["Jo"]]
