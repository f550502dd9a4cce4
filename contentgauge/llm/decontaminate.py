"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgauge.llm.common import join_ids, materialize

WINDOW = 10
#: Bytes of benchmark text in one automaton; a larger benchmark is dealt into several, each scanned in turn.
SHARD_BYTES = 8 << 20

#: ASCII letters to lower case, all other ASCII but digits to a space; bytes of other characters stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_RESULT = "doc_id bigint, row_key bigint, n_words bigint, hits array<struct<start:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII non-alphanumerics, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_NORMAL).split() if text else []


class Matcher:
    """The automaton over word numbers: words outside the benchmark are 0 and match nothing."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, who in owners.items():
            self.automaton.add_word(seq, (len(seq), frozenset(who)))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges [start, end) inside any occurrence, and the items that occur."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return ranges, items
        get = self.number.get
        for end, (n, who) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            start, end = end + 1 - n, end + 1
            items |= who
            while ranges and start <= ranges[-1][1]:
                last = ranges.pop()
                start, end = min(start, last[0]), max(end, last[1])
            ranges.append((start, end))
        return ranges, items


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets [start, end) in the original text; normalising keeps every character's place."""
    if not ranges:
        return []
    raw = text.encode()
    flat, bounds, at = raw.translate(_NORMAL), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, byte_at, char_at = [], 0, 0
    for s, e in ranges:
        char_at += len(raw[byte_at : bounds[s][0]].decode())
        n = len(raw[bounds[s][0] : bounds[e - 1][1]].decode())
        out.append((char_at, char_at + n))
        byte_at, char_at = bounds[e - 1][1], char_at + n
    return out


def _scan(shard, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shard.value, window)
        pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            n, hits, items, spans = [], [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                found, who = matcher.find(words)
                n.append(len(words))
                hits.append([{"start": s, "end": e} for s, e in found])
                items.append(sorted(who))
                spans.append([{"start": s, "end": e} for s, e in char_spans(text, found)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(hits, pair), pa.array(items, pa.list_(pa.string())), pa.array(spans, pair)],
                names=["doc_id", "row_key", "n_words", "hits", "items", "spans"],
            )

    return run


def _shards(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """The benchmark in parts of at most SHARD_BYTES (a longer item alone in its part), read part by part."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).filter("item is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * total // SHARD_BYTES if total > SHARD_BYTES else 1
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    return [[(r.item, r.text) for r in items.filter(part == k).collect()] for k in range(n)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Benchmark hits of every document.

    Returns doc_id, n_words, n_hit, items (sorted strings), hits (word ranges), spans (code point ranges of the
    original text), contaminated; one row per input row, in no order, whatever else docs holds.
    A null or empty text has no words; a null doc_id stays null; repeated rows give repeated results; an empty
    benchmark, or items that are null or without words, hit nothing. A benchmark over SHARD_BYTES is scanned in
    several automata whose word ranges are united per row.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = _shards(benchmark)
    if len(shards) == 1:
        rows = rows.withColumn("row_key", F.lit(0).cast("bigint"))
        found = rows.mapInArrow(_scan(sc.broadcast(shards[0]), window), _RESULT)
    else:
        # equal rows give equal results, so they may share a key; copies are counted and dealt out again
        rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
        copies = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("copies"))
        one = rows.dropDuplicates(["doc_id", "row_key"])
        parts = None
        for shard in shards:
            part = one.mapInArrow(_scan(sc.broadcast(shard), window), _RESULT)
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("doc_id", "row_key").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.array_sort(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
        merged = merged.withColumn("hits", _united("hits")).withColumn("spans", _united("spans"))
        same = merged["doc_id"].eqNullSafe(copies["doc_id"]) & (merged["row_key"] == copies["row_key"])
        found = merged.join(copies.hint("shuffle_hash"), same).select(merged["*"], F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + (x["end"] - x["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "hits", "spans", (n_hit > 0).alias("contaminated"))


def _united(name: str):
    """Sorted ranges with overlapping or touching ones joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda a: F.element_at(a, -1)

    def add(a, x):
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(name, empty, add)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a benchmark window; all columns stay.

    Rows of a doc_id go together; rows without text, or without a doc_id, are kept.
    """
    hit = materialize(scan_documents(docs, benchmark, window).filter("contaminated and doc_id is not null").select(F.col("doc_id").alias("_hit")).distinct())
    marked = docs.select(F.col("doc_id").cast("bigint").alias("_hit"), F.struct(*docs.columns).alias("row"))  # whatever their names
    return join_ids(marked, hit, ["_hit"], "left_anti").select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op1."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )

