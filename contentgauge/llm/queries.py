"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contentgauge.llm import decontaminate, embedding_dedup, html_extract, jaccard_join, line_dedup, periodic_runs, piece_codec, quality, substring_dedup, token_counts, token_files, url_filters, vector_codes
from contentgauge.llm.common import table

MODEL, TOKENIZER = "piece_bpe_32k.model", "byte_bpe_50k.json"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_path())


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), model_path(), digests=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge_urls(pages, url_filters.labelled_urls(pages, table(spark, sf_dir, "labels")))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.encode_vectors(table(spark, sf_dir, "embeddings")))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all documents, by a checksum of the id, repeat the words from some place on; a null id is none of them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"), repeat_tail, digests=True)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(token_files.encode_documents(table(spark, sf_dir, "documents"), model_path(TOKENIZER)))
    return token_files.read_documents(spark, path)


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round written out: the nearest entry by squared distance, then floored means; entries without parts stay."""
    nearest = """a{k} AS MATERIALIZED (SELECT vec_id, j, x, arg_min(i, (d, i)) AS i, min(d) AS d FROM (
    SELECT p.vec_id, p.j, p.x, b.i, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{k} AS b ON p.j = b.j) GROUP BY vec_id, j, x),"""
    moved = """s{k} AS (SELECT j, i, m, sum(c) AS s, count(*) AS n FROM (SELECT j, i, unnest(x) AS c, generate_subscripts(x, 1) AS m FROM a{k}) GROUP BY j, i, m),
m{k} AS (SELECT j, i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY m) AS c FROM s{k} GROUP BY j, i),
b{n} AS MATERIALIZED (SELECT b.j, b.i, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN m{k} AS m USING (j, i)),"""
    steps = "\n".join(nearest.format(k=k) + "\n" + moved.format(k=k, n=k + 1) for k in range(rounds)) + "\n" + nearest.format(k=rounds)
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, j, q[j * len(q) // {parts} + 1:(j + 1) * len(q) // {parts}] AS x FROM v, range({parts}) AS r(j)),
b0 AS MATERIALIZED (SELECT j, dense_rank() OVER (ORDER BY vec_id) - 1 AS i, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})),
{steps}
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, i)) AS codebooks_sha256 FROM b{rounds}),
e AS (SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label FROM e JOIN v USING (vec_id), h"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_token_counts, op3_sentencepiece, op4_substring_dedup, op5_embedding_dedup,
        op6_jaccard_join, op7_url_filters, op8_html_extract, op9_line_dedup, op10_quality_classifier,
        op11_vector_codes, op12_periodic_runs, op13_token_files,
    )
}

ORACLES: dict[str, str] = {
    # the item's and the document's words, windows by list slices, hits as a distinct list of positions
    "op1_decontaminate": r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[k:k + 9], ' ') AS g, least(len(w), 10) AS n FROM b, generate_series(1, greatest(len(w) - 9, 1)) AS s(k) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, lens, generate_series(1, len(w) - n + 1) AS s(k)),
hit AS (SELECT DISTINCT doc_id, item, k, dw.n AS n FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS g FROM d, generate_series(1, len(w) - 19) AS s(k)),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 19)) AS p FROM late),
w AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL) AS kept
      FROM w LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM d, generate_series(1, greatest(len(w) - 4, 1)) AS s(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op11_vector_codes": _vector_codes_sql(),
}
