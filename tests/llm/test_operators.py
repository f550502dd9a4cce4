"""Training-data operators against brute force, libraries and edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import sys
import subprocess
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contentgauge.llm import (
    components, decontaminate, embedding_dedup, html_extract, jaccard_join, line_dedup, periodic_runs, piece_codec, pieces, quality, queries, substring_dedup, token_counts, token_files, url_filters, vector_codes, word_model,
)
from tests.conftest import ROOT, SF, duck_rows, rows_of

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use inside.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, _doc int, doc int, token int, node int, row_key int, label int, count int, _hit int"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def documents(spark, texts):
    rows = [(i, t, "en" if i and i % 2 else None, None, None if t is None else len(t), *[0] * 9) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    base, passage = words(300, 1), words(60, 2)
    near = list(base)
    near[10], near[200] = "new", "words"
    far = base[:150] + words(150, 3)
    texts = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "one two"),
        (10, " ".join(words(50, 4) + passage + words(40, 5))), (11, " ".join(passage)), (12, "A a " * 60), (13, " ".join(words(20_000, 6))), (14, " ".join(passage[:19])),
        (15, "Same line of text\nother line\nshort\nsame LINE of text \n"), (16, "  SAME line of text\nshort\n\nmore lines here"), (17, "é漢字😀   nbsp wide ▁▁ under\x00nul"),
        (18, " ".join(passage + words(30, 7) + passage)), (None, " ".join(base)), (None, None), (2, " ".join(base)),
    ]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.mark.parametrize("name", [n for n in queries.ORACLES])
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(entry.queries()[name](spark, SF)) == duck_rows(duck, entry.oracle_sql()[name])


# 1 decontamination


def brute_hits(text, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    own, hit, found = pattern.findall(low(text)), set(), set()
    for item, t in items:
        w = pattern.findall(low(t))
        if item is None or not w:
            continue
        for k in range(max(1, len(w) - window + 1)):
            seq = w[k : k + window]
            for j in range(len(own) - len(seq) + 1):
                if own[j : j + len(seq)] == seq:
                    hit |= set(range(j, j + len(seq)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, docs, monkeypatch, shard_bytes):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
    base = words(300, 1)
    items = [(1, " ".join(base[40:70])), (2, "ONE, two!"), (3, None), (4, "..."), (None, "one"), (10, " ".join(words(60, 2)[5:16])), (11, "漢字😀  ")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan_documents(docs, bench).collect())
    assert got == sorted((str(i), *brute_hits(t, items)) for i, t in corpus())
    for r in decontaminate.scan_documents(docs, bench).join(docs.select("doc_id", "text"), "doc_id").collect():
        for (s, e), (a, b) in zip(r["hits"], r["spans"], strict=True):
            assert decontaminate.words_of(r["text"][a:b]) == decontaminate.words_of(r["text"])[s:e]
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1, 2, 8)").count() == 0 and kept.filter("doc_id is null").count() == 2


def test_decontamination_of_nothing(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.scan_documents(empty, bench).count() == 0
    assert decontaminate.scan_documents(docs, bench).filter("contaminated").count() == 0


# 2 and 3 tokens


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def odd_texts(seed=0, n=300):
    r = random.Random(seed)
    vocabulary = pieces.load(queries.model_path())
    pool = [p.replace("▁", " ") for p in vocabulary.ids]
    alphabet = "abc the▁ \n\té漢字😀.,0123  aaaa"
    return ["".join(r.choices(pool, k=r.randint(1, 25))) for _ in range(n)] + ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(n)] + [" " * k for k in range(40)] + ["a" * 3000, "the" * 999]


def test_codec_equals_the_library(library):
    codec = piece_codec.Codec(pieces.load(queries.model_path()))
    texts = odd_texts()
    got = codec.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [codec.decode(x) for x in got] == library.decode(library.encode(texts))
    for ids in ([229, 153], [258, 300, 68], [1, 300, 2], [0, 300], [29871]):
        assert codec.decode(np.array(ids)) == library.decode(ids)


def test_prefix_counts_equal_the_library(library):
    counter = token_counts.PrefixCounter(pieces.load(queries.model_path()))
    texts = [t for t in odd_texts(1, 60) if len(t) < 200]
    for text, counts in zip(texts, counter.texts(texts), strict=True):
        assert counts.tolist() == [len(x) for x in library.encode([text[:k] for k in range(len(text) + 1)])]
        assert token_counts.unpack(token_counts.pack(counts)).tolist() == counts.tolist()
        assert token_counts.longest_prefix(counts, 5) == max(k for k, c in enumerate(counts) if c <= 5)


def test_token_queries(spark, docs, empty, library):
    want = {(str(i), t): library.encode(t or "") for i, t in corpus()}
    got = token_counts.count_tokens(docs, queries.model_path(), limit=100, keep_prefixes=True).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((str(i), len((t or "").encode()), len(want[str(i), t]), len(want[str(i), t]) > 100) for i, t in corpus())
    rows = piece_codec.encode_documents(docs, queries.model_path()).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in rows) == sorted((str(i), want[str(i), t], library.decode(want[str(i), t])) for i, t in corpus())
    assert token_counts.count_tokens(empty, queries.model_path()).count() == piece_codec.encode_documents(empty, queries.model_path()).count() == 0


# 4 substring dedup


def brute_repeats(texts, window=20):
    rows = [(i, SPACE.findall(t or "")) for i, t in texts]
    first: dict[tuple, tuple] = {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            key, at = tuple(w[k : k + window]), (-1 if i is None else i, k)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (-1 if i is None else i, k):
                gone |= set(range(k, k + window))
        out.append((str(i), len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup_equals_brute_force(spark, docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substring_dedup, "SAMPLE", 1.0)
        monkeypatch.setattr(substring_dedup, "HOT_ROWS", 2)
    got = substring_dedup.find_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(corpus())
    assert all(sha(r["kept"]) == r["kept_sha256"] and sum(b - a for a, b in r["ranges"]) == r["n_removed"] for r in got)


def test_substring_dedup_of_random_shared_passages(spark):
    r = random.Random(5)
    texts = []
    for i in range(60):
        own = []
        for _ in range(r.randint(1, 4)):
            own += words(r.randint(0, 30), r.randrange(10**6)) + (p := words(80, r.randrange(6)))[: r.randint(15, 80)] + p[r.randint(0, 60) :]
        texts.append((i, " ".join(own)))
    got = sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.find_repeats(documents(spark, texts)).collect())
    assert got == brute_repeats(texts)


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.find_repeats(empty).count() == 0


# 5 embeddings


def near_vectors():
    r = np.random.default_rng(3)
    out = []
    for k in range(40):
        center = r.standard_normal(64)
        out += [(center + 0.12 * r.standard_normal(64)) for _ in range(k % 5 + 1)]
    v = [x / np.linalg.norm(x) for x in out]
    return [(i, x.astype(np.float32).tolist(), i % 2) for i, x in enumerate(v)] + [(900 + k, v[0].astype(np.float32).tolist(), 0) for k in range(3)]


ODD_VECTORS = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] + [1.0] * 63, 1), (1003, [None] + [1.0] * 63, 1), (1004, [1.0] * 64, None), (1005, [1.0] * 64, None), (1006, [], 1), (1007, [1.0, 0.0], 1)]


@pytest.mark.parametrize("block", [2048, 3])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = near_vectors()
    df = spark.createDataFrame([(*x, 0, 0) for x in rows + ODD_VECTORS], "vec_id bigint, embedding array<float>, label int, cell int, n int")
    x = np.array([e for _, e, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(link, False)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *[root[j] for j in np.flatnonzero(link[i])]]) for i in range(len(rows))]
    want = [(rows[i][0], int(link[i].sum()), rows[root[i]][0], root[i] == i) for i in range(len(rows))] + [(v, 0, v, True) for v, _, _ in ODD_VECTORS]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(df).collect())
    assert link.sum() > 20 and got == sorted(want)


def test_embedding_recall_and_lattice():
    shortest = embedding_dedup.minimal_vectors()
    assert shortest.shape == (240, 8) and np.allclose((shortest**2).sum(axis=1), 2)
    r = np.random.default_rng(1)
    points = r.standard_normal((200, 8)) * 3
    own = embedding_dedup.nearest(points)
    assert np.allclose(embedding_dedup.nearest(own), own)
    # no neighbouring lattice point is nearer
    assert ((points - own) ** 2).sum(axis=1).max() <= 1 + 1e-9 and all((((points[k] - own[k] - shortest) ** 2).sum(axis=1) >= ((points[k] - own[k]) ** 2).sum() - 1e-9).all() for k in range(200))
    a = r.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.standard_normal((3000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * side  # pairs just at the threshold
    x, y = embedding_dedup.cells(a), embedding_dedup.cells(b)
    met = ((y == x[:, :, :1]).any(axis=2) | (x == y[:, :, :1]).any(axis=2)).any(axis=1)
    assert met.mean() > 0.999


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_dense_cell_in_bounded_memory(tmp_path):
    """Two full blocks of near copies in one cell: every pair is counted, in far less memory than the pairs would take."""
    code = """
import resource
import numpy as np
from contentgauge.llm import embedding_dedup as e
r = np.random.default_rng(0)
v = r.standard_normal(64) + 0.001 * r.standard_normal((2 * e.BLOCK, 64))
v /= np.sqrt((v * v).sum(1, keepdims=True))
own = e.cells(v)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
counts, forest = e._meet({"vectors": v, "own": own, "cid": np.arange(len(v)), "n": np.ones(len(v), int), "block": np.repeat([0, 1], e.BLOCK)}, 0, int(own[0, 0, 0]), True)
assert (own == own[0]).all() and all(n == e.BLOCK for _, _, n in counts) and len(counts) == len(v) and len(forest) == len(v) - 1
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_vectors_out_of_range(spark):
    """Finite doubles whose squares are not."""
    rows = [(1, 0, [1e200, 1e200]), (2, 0, [2e200, 2e200]), (3, 0, [1e-200, 1e-200]), (4, 0, [1e-200, -1e-200]), (5, 0, [0.0, 0.0])]
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


# 6 Jaccard join


def brute_components(texts):
    sets = []
    for _, t in texts:
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least: dict[int, list] = {}
    for k, (i, _) in enumerate(texts):
        least.setdefault(top(k), []).append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted((str(i), len(sets[k]), str(first[top(k)])) for k, (i, _) in enumerate(texts))


def near_copies(n, size, edits, seed):
    r = random.Random(seed)
    base, out = words(size, seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = f"e{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    monkeypatch.setattr(jaccard_join, "DENSE", 1)
    texts = corpus() + [(100 + k, t) for k, t in enumerate(near_copies(40, 120, 6, 11) + near_copies(40, 60, 3, 12) + near_copies(20, 9, 1, 13))]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.link_documents(documents(spark, texts)).collect())
    assert got == brute_components(texts)


def test_sketch_bounds_the_difference():
    r = random.Random(2)
    for _ in range(200):
        n, m, same = r.randint(1, 300), r.randint(1, 300), r.randint(0, 300)
        both = [r.randrange(1 << 64) for _ in range(same)]
        a, b = (np.unique(np.array(both + [r.randrange(1 << 64) for _ in range(k)], np.uint64)) for k in (n, m))
        x, y = ((8 * len(s), int.from_bytes(s, "little")) for s in map(jaccard_join.sketch, (a, b)))
        assert jaccard_join.apart(x, y) <= len(np.setxor1d(a, b))


def test_one_of_each_group_stays(spark, docs, empty):
    kept = jaccard_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18]
    assert jaccard_join.link_documents(empty).count() == 0


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: m for n, m in root.items() if any(a != b and n in (a, b) for a, b in pairs)}


# 7 urls


def test_url_rules(spark):
    urls = [
        "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/en", "http://x.net/", "http://x.net", "http://example.com/de/x?y", "http://example.com/dex", "http://b.org/fr/#f", "http://notorg/fr/",
        None, "no scheme", "ftp://U@H.org:80/fr/x", "://?", "http://net/", "http://evil.network/",
    ]
    pages = spark.createDataFrame([(k, u, None, 0) for k, u in enumerate(urls)] + [(None, urls[0], None, 0), (0, urls[0], None, 0)], "page_id bigint, url string, html string, verdict int")
    labels = url_filters.labelled_urls(pages, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert url_filters.judge_urls(pages.limit(0), labels).count() == 0
    got = url_filters.judge_urls(pages, labels).collect()
    assert len(got) == len(urls) + 2
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and by[1][1:] == ("/en/", "example.net/en/", "allow") and by[2][2:] == ("net/", "block")
    assert by[3][2:] == ("net/", "block") and by[4] == ("x.net", "", None, "allow") and by[5] == ("example.com", "/de/x", "example.com/de/", "block") and by[6][2:] == (None, "allow")
    assert by[7][2:] == ("org/fr/", "allow") and by[8][2] is None and by[9] == by[10] == ("", "", None, "allow") and by[11][0] == "u@h.org:80" and by[12][:2] == ("", "") and by[13][2] == "net/" and by[14][2] is None


def brute_rules(labelled):
    """Antecedents of rules -> bad with confidence, by counting every set of tokens."""
    baskets = [(frozenset(x), bad) for x, bad in labelled if bad is not None and (x or bad)]
    n, bad = len(baskets), sum(b for _, b in baskets)
    sets = {frozenset(c) for x, _ in baskets for k in range(1, len(x) + 1) for c in itertools.combinations(sorted(x), k)}
    found = {}
    for s in sets:
        both, own = sum(s <= x and b for x, b in baskets), sum(s <= x for x, b in baskets)
        if both / n >= max(url_filters.MIN_SUPPORT, url_filters.MIN_ROWS / n) and both / own >= url_filters.MIN_CONFIDENCE and both / own / (bad / n) >= url_filters.MIN_LIFT:
            found[s] = both / own
    return {s: c for s, c in found.items() if not any(o < s and found[o] >= c for o in found)}


@pytest.mark.parametrize("most", [url_filters.MOST_RULES, 0])
def test_mined_url_rules(spark, monkeypatch, most):
    """Mining, pruning and matching against brute force on labels that carry signal, by the index and by the join."""
    monkeypatch.setattr(url_filters, "MOST_RULES", most)
    r = random.Random(5)
    rows = []
    for k in range(600):
        host, page = r.choice(["casino", "bet", "news", "shop"]), r.choice(["win", "read", "buy"])
        bad = r.random() < {"casino": 0.9, "bet": 0.5, "news": 0.05, "shop": 0.1}[host] + (0.45 if (host, page) in (("bet", "win"), ("shop", "buy")) else 0)
        rows.append((f"http://{host}-{k % 3}.com/{page}/{k}?ref=x", bad if k % 50 else None))
    rows += [(None, True), ("no url", False), ("http:///", None)]
    table = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = {x["url"]: frozenset(x["t"]) for x in table.select("url", url_filters.tokens_of(F.col("url")).alias("t")).collect()}
    mined = url_filters.mine_rules(table)
    want = brute_rules([(tokens[u], b) for u, b in rows])
    got = {frozenset(x["tokens"]): x["confidence"] for x in mined.collect()}
    assert len(want) >= 3 and any(len(s) > 1 for s in want) and got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    found = url_filters.judge_urls(table.withColumn("page_id", F.monotonically_increasing_id()), table)
    assert found.count() == len(rows)
    best = lambda u: max((c for s, c in want.items() if s <= tokens[u]), default=None)
    expected = sorted((url_filters_host(u), best(u)) for u, _ in rows if best(u) is not None)
    assert sorted((x["host"], x["confidence"]) for x in found.filter("verdict = 'block'").collect()) == [(h, pytest.approx(c)) for h, c in expected]


def url_filters_host(url):
    return url.split("://")[1].split("/")[0].lower()


def test_url_query_on_its_table(spark):
    got = entry.queries()["op7_url_filters"](spark, SF).collect()
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for r in got:
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert r["rule"] == (max(fits)[1] if fits else None) and (not fits or r["verdict"] == max(fits)[2]) and r["verdict"] in ("allow", "block")


# 8 html


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a b"), ("<script>x()</script><style>p{}</style>", ""),
        ("<body class='has-sidebar'><header>Site</header><nav>menu</nav><div class=ad>ad</div><article><header><h1>T &lt;x&gt;</h1></header><p>Hello <b>w</b>orld<br>again<p>Short.<div class='comments'><p>reader</div>"
         "<form>f</form><p>end\n  here</article><aside>side</aside><div id=cookie-notice>We use</div><footer>foot</footer>", "T <x> Hello world again Short. end here"),
        ("<div id=w><div class=menu>a b</div><div class=content><p>One two three four five six.</p><p>x</p></div></div>", "One two three four five six. x"),
        ("<main><p>m one</p></main><div><p>outside</p></div>", "m one"), ("<article><p>unclosed <i>tags", "unclosed tags"), ("<article><![x[ <p>a</p><!-- c --></article>", "a"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><div class=post><h1>The title of it</h1><div class=text><p>One two three four five six seven eight.</div></div>", "The title of it One two three four five six seven eight."),
        ("<body><div><p>" + "a " * 85 + "</div><div><p>" + "b " * 15 + "</div>", ("a " * 85 + "b " * 15).strip()),
        ("<article><p>First article of it</article><article><p>Second one, a bit longer</article>", "First article of it Second one, a bit longer"),
        ("<html><head><title>T</title><body><p>The body's text", "The body's text"), ("<head><title>T</title><p>The body's text", "The body's text"),
        ("<body><form><div>menu</div><article><p>Text in a form</article></form>", "Text in a form"),
        ("<body><div class=sidebar-right><p>All text of the page</div>", "All text of the page"), ("<div class=widget-content><main><p>Main text</main></div>", "Main text"),
        ("<article><p>Story</article><div class=comments><article><p>A reader writes at length about it</article></div>", "Story"),
    ],
)
def test_main_text_is_whole(html, text):
    assert html_extract.main_text(html) == text


def test_html_query_equals_the_articles(spark, duck):
    import html as entities

    got = {r["page_id"]: r for r in entry.queries()["op8_html_extract"](spark, SF).collect()}
    for page_id, url, source in duck.sql("SELECT page_id, url, html FROM pages").fetchall():
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", "\0", re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", article)).replace("\0", " ")).split())
        assert (got[page_id]["text"], got[page_id]["n_chars"], got[page_id]["url"]) == (want, len(want), url)


def test_html_table_edges(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>a", None), (1, "u", "<p>a", None)], "page_id bigint, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect()) == [("1", "a", 1), ("1", "a", 1), ("None", "", 0)]
    assert html_extract.extract_pages(pages.filter("false")).count() == 0


# 9 lines


def brute_lines(texts, least=10):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    first: dict[str, int] = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            k, d = key(line), -1 if i is None else i
            first[k] = min(first.get(k, d), d)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == (-1 if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup_equals_brute_force(spark, docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(line_dedup, "SAMPLE", 1.0)
        monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    r = random.Random(9)
    texts = corpus() + [(200 + k, "\n".join(r.choice(["A common line", "a COMMON line  ", "another one here", "tiny", "", f"unique line {k} {j}"]) for j in range(r.randint(1, 30)))) for k in range(40)]
    found = line_dedup.digest(documents(spark, texts)).collect()
    assert sorted((str(x["doc_id"]), x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in found) == brute_lines(texts)


def test_line_dedup_keeps_columns_and_uses_no_python(spark, docs, empty):
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and line_dedup.digest(empty).count() == 0
    plan = line_dedup.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_html_smoothing_decides(monkeypatch):
    """No article element, a list of links without a marked class inside the content: it goes by its smoothed ratio, a lone link line stays."""
    prose = "".join(f"<p>Sentence number {k} of a long paragraph that says something about the matter at hand, in many words.</p>" for k in range(4))
    links = "".join(f"<li><a href='/{k}'>Other page {k}</a></li>" for k in range(8))
    page = f"<html><body><div><h1>Title</h1>{prose}<p><a href='/x'>A link line of its own</a></p>{prose}<ul>{links}</ul><p>Short end.</p></div></body></html>"
    text = html_extract.main_text(page)
    assert text.startswith("Title Sentence number 0") and "A link line of its own" in text and "Other page 3" not in text and text.endswith("Short end.")
    monkeypatch.setattr(html_extract, "smoothed", lambda ratios: np.ones(len(ratios)))
    assert "Other page 3" in html_extract.main_text(page)


# 10 quality


def test_quality_rejects_bad_and_toxic_documents(spark):
    """Trained on the even labelled documents, judged on the odd ones: rates of rejection, and a model that grows with the text."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.judge_documents(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rate = {r["k"]: r["rate"] for r in found.groupBy(F.expr("IF(quality = 0, 'bad', IF(toxic = 1, 'toxic', 'trusted'))").alias("k")).agg(F.avg(1 - F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate["bad"] >= 0.95 and rate["toxic"] >= 0.65 and rate["trusted"] < 0.02


def brute_kneser_ney(texts, known):
    """p(v, w) and the model's figures from the definition; words that are not known are one class."""
    lines = [["", *[w if w in known else None for w in word_model.cut(t)], ""] for t in texts]
    n = collections.Counter(p for s in lines for p in zip(s, s[1:]))
    c = [sum(k == x for k in n.values()) for x in range(5)]
    y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
    d = [min(max(k - (k + 1) * y * (c[k + 1] / c[k] if c[k] else 0), 0.05), k - 0.05) for k in (1, 2, 3)]
    off = lambda k: d[min(k, 3) - 1]
    before = collections.Counter(w for _, w in n)
    b1, b2 = (sum(k == x for k in before.values()) for x in (1, 2))
    d0 = min(max(b1 / (b1 + 2 * b2), 0.05), 0.95)
    symbols = {"", None, *known}
    free = (len(n) - sum(k - d0 for k in before.values())) / len(symbols)
    low = {w: ((before[w] - d0 if before[w] else 0) + free) / len(n) for w in symbols}
    total = {v: sum(k for (x, _), k in n.items() if x == v) for v in symbols}
    back = {v: sum(off(k) for (x, _), k in n.items() if x == v) / total[v] if total[v] else 1 for v in symbols}
    return symbols, lambda v, w: ((n[v, w] - off(n[v, w])) / total[v] if n[v, w] else 0) + back[v] * low[w]


@pytest.mark.parametrize("most", [(1000, 1000, 3), (6, 1000, 2), (6, 2, 5), (1000, 0, 4)])
def test_word_model_equals_brute_force(spark, monkeypatch, most):
    """Scores of seen and unseen texts against the definition, with all words and pairs common, some of them, and none."""
    monkeypatch.setattr(word_model, "VOCABULARY", most[0])
    monkeypatch.setattr(word_model, "PAIRS", most[1])
    monkeypatch.setattr(word_model, "CHUNK", 12)
    texts = ["the cat sat on the mat the cat", "A dog ran off with the hat. The cat sat on", "the mat", "the cat sat on a rug", "on the mat on the cat the rug ran"]
    model, pairs = word_model.learn(spark.createDataFrame([(t, False) for t in texts] + [("the bad cat", True)], "text string, toxic boolean"), most[2])
    counts = collections.Counter(w for t in texts for w in word_model.cut(t))
    of = {word_model.word_hash(w): w for w in counts}
    known = {of[h] for h in model.hashes.tolist()}
    assert len(known) <= most[0] and (len(known) == len(counts) or max(counts[w] for w in counts if w not in known) <= min(counts[w] for w in known))
    assert len(model.keys) <= most[1]
    symbols, p = brute_kneser_ney(texts, known)
    assert all(abs(sum(p(v, w) for w in symbols) - 1) < 1e-9 for v in symbols)
    asked = [*texts, "the the unheard of cat sat", "zebra", None, "", "the " * 40 + "mat"]
    got = word_model.score(spark.createDataFrame(list(enumerate(asked)), "k int, text string"), model, pairs)
    others = max(len(counts) - len(known), 1)
    for r in got.collect():
        words = word_model.cut(asked[r["k"]])
        line = ["", *[w if w in known else None for w in words], ""]
        logs = [math.log(p(v, w)) - (math.log(others) if w is None else 0) for v, w in zip(line, line[1:])] if words else []
        assert r["n"] == len(logs) and (r["score"] is None if not logs else abs(r["score"] + sum(logs) / len(logs)) < 1e-5)
        assert r["repeats"] == sum(words[k] in (words[k - 1], words[k - 2]) for k in range(2, len(words)))
    assert got.count() == len(asked)


def test_word_model_packs_any_numbers():
    for x in ([], [0], [1, 2, 3], [2**40, 5, 0, 2**62]):
        assert word_model.unpacked(word_model.packed(np.array(x, np.int64))).tolist() == x
    n = np.array([1, 2, 1023, 1024, 1025, 5000, 10**9])
    assert (np.diff(word_model.bins(n)) >= 0).all() and word_model.least_bin({1: 10, 2: 5, 7: 3}, 8) == 2 and word_model.least_bin({}, 5) == 1


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.judge_documents(empty, none).count() == 0
    assert quality.judge_documents(docs, none).filter("kept").count() == docs.count()
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (4, 1, 0), (4, 0, 0), (None, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    kinds = {r["doc_id"]: r["_toxic"] for r in quality.labelled(docs.select("doc_id", "text"), labels).collect()}
    assert [kinds[k] for k in (1, 2, 4, 5)] == [False, None, None, False] and kinds[None] is None
    got = quality.judge_documents(docs, labels)
    assert got.count() == docs.count() and got.filter("perplexity is null and not kept").count() == 0
    assert quality.without_rejected(docs, labels).columns == docs.columns
    clash = docs.withColumn("_lang", F.lit("x")).withColumn("_key", F.lit(1)).withColumn("c0", F.lit(2))
    again = quality.without_rejected(clash, labels)
    assert again.columns == clash.columns and again.filter("_lang = 'x' and _key = 1 and c0 = 2").count() == again.count() == quality.without_rejected(docs, labels).count()


# 11 vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((i, [math.floor(4096 * x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e))
    if not kept:
        return []
    x = np.array([k[1] for k in kept]).reshape(len(kept), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        away = ((x[:, :, None, :] - book[None]) ** 2).sum(axis=3)
        nearest = away.argmin(axis=2)
        for j, k in itertools.product(range(parts), range(book.shape[1])) if turn < rounds else ():
            if (own := nearest[:, j] == k).any():
                book[j, k] = x[own, j].sum(axis=0) // own.sum()
    errors, by_label = away.min(axis=2).sum(axis=1).tolist(), collections.Counter()
    for (*_, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = sha(",".join(map(str, book.ravel().tolist())))
    return sorted((k[0], "".join(f"{c:02x}" for c in near), e, by_label[k[2]], digest) for k, near, e in zip(kept, nearest.tolist(), errors, strict=True))


def coded(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("n", [0, 3, 16, 400])
def test_vector_codes_equal_brute_force(spark, n):
    """Null, zero, broken and repeated vectors, ties, null labels, fewer vectors than entries, extra columns."""
    r = np.random.default_rng(n)
    rows = [(int(i) * 3, np.round(r.normal(size=16), 1).tolist(), int(r.integers(0, 3)) or None) for i in r.permutation(n)]
    rows += [(1, None, 1), (2, [None] + [0.0] * 15, 1), (4, [math.nan] * 16, 1), (5, [math.inf] + [0.0] * 15, 2)]
    rows += [(6 * n + 1, [0.0] * 16, 7), (6 * n + 2, [0.0] * 16, None), (6 * n + 3, [-50.0] * 16, None)] if n else []
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "vec_id bigint, embedding array<double>, label int, q string, error int").repartition(3)
    assert coded(vector_codes.digest(*vector_codes.encode_vectors(df))) == brute_codes(rows)


@pytest.mark.parametrize("kind", ["normal", "grid", "copies"])
def test_cover_trees_assign_like_all_comparisons(kind):
    r = np.random.default_rng(5)
    x = {"normal": r.normal(size=(3000, 8)) * 1000, "grid": r.integers(-2, 3, (3000, 8)) * 1000, "copies": np.repeat(r.normal(size=(30, 8)) * 1000, 100, axis=0)}[kind].astype(np.int64)
    entries = x[r.integers(0, 3000, 16)]
    entries[3] = entries[1]
    tree = vector_codes.Tree.unpack(vector_codes.Tree.build(x).pack())
    nearest = ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (tree.codes(x, entries) == nearest).all()
    counts, sums = tree.sums(x, entries)
    assert counts.tolist() == np.bincount(nearest, minlength=16).tolist() and all((sums[k] == x[nearest == k].sum(axis=0)).all() for k in range(16))
    compared = []
    tree.assign(x, entries, lambda start, end, to: compared.append(len(start) if end is None else 0))
    assert sum(compared) < len(x) or kind == "grid"  # whole subtrees go without their points


def test_codes_decode_to_near_vectors(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=16).tolist(), 0) for i in range(100)]
    codes, book = vector_codes.encode_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    for c in codes.collect():
        assert ((vector_codes.decode(c.code, book) - np.floor(4096 * np.array(rows[c.vec_id][1]))) ** 2).sum() == c.error


def test_vectors_that_do_not_divide_are_refused(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1.0] * 10, 0)], "vec_id bigint, embedding array<double>, label int"))


# 12 periodic runs


def brute_runs(w, least_words=24, least_periods=3):
    found = []
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_words, least_periods * q):
                own = w[i : i + length]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating(seed):
    """Short texts of few words with planted repetitions, so that many runs touch and overlap."""
    r = random.Random(seed)
    w = [r.choice("abcde"[: r.choice([1, 2, 2, 3, 5])]).encode() for _ in range(r.randrange(90))]
    for _ in range(r.randrange(3) if len(w) > 3 else 0):
        a, p = r.randrange(len(w)), r.randrange(1, 12)
        for i in range(a + p, min(len(w), a + r.randrange(10, 70))):
            w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    texts = [repeating(k) for k in range(800)]
    for w, got in zip(texts, periodic_runs.runs_of(texts), strict=True):
        assert list(map(tuple, got.tolist())) == brute_runs(w)
        if w:
            every = periodic_runs.find_in([x[0] for x in w], 2, 2)
            assert list(map(tuple, every.tolist())) == brute_runs(w, 2, 2)


def test_runs_query_equals_brute_force(spark):
    """The whole table: digests, greatest run and collapsed text of every document, planted tails included."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    met = 0
    for i, text in texts.items():
        w = queries.repeat_tail(i, [x.encode() for x in SPACE.findall(text or "")])
        if len(w) > 3000:
            continue  # the brute force takes squares; long texts are in the next test
        runs, r = brute_runs(w), got[i]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        met += len(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best) and r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert met > 5


def test_runs_of_odd_texts(spark, docs, empty):
    """Nulls, white space, one word thousands of times, a long text of one period, repeated rows and clashing names."""
    got = {(r.doc_id, r.n_runs, r.length, r.period, r.collapsed_text) for r in periodic_runs.find_runs(docs).collect()}
    assert {(5, 0, None, None, ""), (6, 0, None, None, ""), (7, 0, None, None, ""), (12, 1, 120, 2, "A a"), (None, 0, None, None, "")} <= got
    long = documents(spark, [(1, "x " * 50_000), (2, " ".join(words(5000, 3) * 4)), (3, "é\x00b " * 8), (4, "a b " * 12 + "a c")])
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(long).collect()}
    assert got == {1: [(0, 50_000, 1)], 2: [(0, 20_000, 5000)], 3: [], 4: [(0, 25, 2)]}
    assert periodic_runs.find_runs(empty).count() == 0


# 13 token files


def library_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.model_path(queries.TOKENIZER))
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library():
    """All kinds of white space and marks at every border, special tokens inside words, contractions."""
    r = random.Random(3)
    letters = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​ab'sS1٣é漢😀.,!?<") + ["<|endoftext|>", "  ", " ", " ", " ", "'s", "'ll", "word", "word."]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(5000)] + [None, "", " ", "a" * 3000, "the end. " * 2000, "x\n\ny " * 50]
    encoder = token_files.Encoder(queries.model_path(queries.TOKENIZER))
    for _ in range(2):  # with and without remembered words
        assert [x.tolist() for x in encoder.texts(texts)] == library_ids(texts)


@pytest.mark.parametrize("widths", [(1, 1, 2), (2, 2), (4,), (1, 1, 1, 1)])
def test_direct_codes_go_round(widths):
    r = np.random.default_rng(1)
    for n, high in itertools.product((0, 1, 511, 512, 513, 3000), (1, 256, 257, 50257, 1 << 32)):
        ids = r.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        ids[: n // 3] = 3
        r.shuffle(ids)
        codes = token_files.Codes(token_files.pack(ids, widths))
        assert len(codes) == n and (codes.all() == ids).all() and all(codes.at(k) == ids[k] for k in range(n))
    with pytest.raises(IndexError):
        codes.at(n)
    with pytest.raises(ValueError, match="do not fit"):
        token_files.pack(np.array([70_000]), (1, 1))


def numbered(rows):
    """doc_id, start, n_tokens and checksum by definition; null ids come first, equal ids by length and checksum."""
    found = sorted(((-1 if i is None else i), len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4")), i) for i, x in rows)
    starts = itertools.accumulate((n for _, n, *_ in found), initial=0)
    return [(i, s, n, c) for (_, n, c, i), s in zip(found, starts, strict=False)]


def test_token_files_query_equals_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in entry.queries()["op13_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == numbered(zip([r.doc_id for r in rows], library_ids([r.text for r in rows]), strict=True))


def test_token_files_of_odd_texts(spark, docs, empty, monkeypatch):
    """Nulls, repeated ids, many parts and segments; any place is read on its own."""
    monkeypatch.setattr(token_files, "PART", 5000)
    path = token_files.write_tokens(token_files.encode_documents(docs, queries.model_path(queries.TOKENIZER)))
    texts = corpus()
    ids = library_ids([t for _, t in texts])
    got = sorted(token_files.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [tuple(r)[:4] for r in got] == numbered(zip([i for i, _ in texts], ids, strict=True))
    flat = [x for r in got for x in r.ids]
    places = [0, 1, 777, 5000, len(flat) - 1, len(flat), -1]
    assert sorted(map(tuple, token_files.read_at(spark, path, places).collect())) == [(p, flat[p]) for p in places if 0 <= p < len(flat)]
    assert spark.read.parquet(f"{path}/directory").count() > 2
    path = token_files.write_tokens(token_files.encode_documents(empty, queries.model_path(queries.TOKENIZER)))
    assert token_files.read_documents(spark, path).count() == 0 and token_files.read_at(spark, path, []).count() == 0


def test_html_nested_marked_elements_are_read_once():
    """Hundreds of nested marked elements, of which each wraps the page: all speak, and no page is parsed again for one."""
    began = time.perf_counter()
    text = html_extract.main_text("<body>" + '<div class="widget">' * 400 + "<p>word and more words</p>" * 3000 + "</div>" * 400)
    assert text == " ".join(["word and more words"] * 3000) and time.perf_counter() - began < 3
    # a marked element beside the text stays silent, one around all of it speaks, with what is marked in it and small
    assert html_extract.main_text('<div class="widget"><p>' + "long text " * 50 + '</p><div class="ad">Buy it</div></div><div class="ad">Now</div>') == " ".join(["long text"] * 50)
