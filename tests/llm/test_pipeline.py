"""The stages of the pipeline against what each is for."""

from __future__ import annotations

import corpus_pipeline
from contentgauge.llm import decontaminate, queries
from contentgauge.llm.common import materialize
from tests.conftest import SF
from tests.llm.test_operators import brute_components, brute_hits, brute_lines, sha


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = materialize(stage(spark, kept, SF))
        assert kept.columns == columns
        seen.append((name, before, kept))
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    _, before, after = seen[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    assert after.join(labels, "doc_id", "left_semi").count() >= 0.98 * before.join(labels, "doc_id", "left_semi").count()

    _, before, after = seen[1]
    assert sorted((str(i), sha(t)) for i, t in rows(after)) == [(i, s) for i, _, _, s in brute_lines(rows(before))]
    assert after.filter("n_chars <> length(text)").count() == 0

    _, before, after = seen[2]
    assert sorted(str(i) for i, _ in rows(after)) == sorted(i for i, _, c in brute_components(rows(before)) if i == c)

    _, before, after = seen[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows(after)) == sorted(i for i, t in rows(before) if not brute_hits(t, items, decontaminate.WINDOW)[1])

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    want = dict(rows(kept))
    assert len(last) == len(want) and all(r["ids"] == library.encode(want[r["doc_id"]]) and r["decoded"] == want[r["doc_id"]] for r in last)


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and 0 < got.count() <= 200
