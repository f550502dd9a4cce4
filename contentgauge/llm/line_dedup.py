"""Line dedup with DataFrame functions only.

Hashes of line keys are range-partitioned and sorted by document and position; the stream of each hash says which
document holds it first, and the lines of later documents are marked. What leaves the operator is a run-length
compressed keep bitmap per document, not text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentgauge.llm.common import materialize

MIN_CHARS = 10
#: Of the keys with at least HOT_LINES lines in a sample, the HOT_KEYS most frequent are hot: their first
#: document comes from a pre-aggregated minimum and not from one sorted stream. Either way gives the same result.
SAMPLE, HOT_LINES, HOT_KEYS = 0.02, 50, 200
_SPACE = " \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)
_KEY = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key() -> list[Column]:
    """Document and hash of the text: rows of one doc_id with different texts have bitmaps of their own."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("_doc"), F.xxhash64("text").alias("_text")]


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """A 128-bit hash, document and position of every line whose key is long enough."""
    lines = docs.select(*_row_key(), F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line"))
    lines = lines.withColumn("_key", line_key(F.col("_line"))).filter(F.length("_key") >= min_chars)
    return lines.select("_doc", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))


def _hot_hashes(lines: DataFrame) -> list[int]:
    counts = lines.sample(SAMPLE, seed=11).groupBy("_h1").count().filter(F.col("count") >= HOT_LINES)
    return [r["_h1"] for r in counts.orderBy(F.desc("count"), "_h1").limit(HOT_KEYS).collect()]


def _later_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines whose key an earlier document holds too: _doc, _text, _pos."""
    lines, parts = materialize(_hashed(docs, min_chars)), []  # read for the sample, the hot keys, the ranges and the streams
    if hot := _hot_hashes(lines):
        own = lines.filter(F.col("_h1").isin(hot))
        first = own.groupBy(*_KEY).agg(F.min("_doc").alias("_first"))  # a row for each hot key
        parts.append(own.join(F.broadcast(first), _KEY))
        lines = lines.filter(~F.col("_h1").isin(hot))
    # ranges of the hash keep all lines of a key in one sorted stream, so the window needs no further exchange
    stream = Window.partitionBy(*_KEY).orderBy("_doc", "_pos")
    parts.append(lines.repartitionByRange("_h1").withColumn("_first", F.first("_doc").over(stream)))
    late = [p.filter("_doc > _first").select("_doc", "_text", "_pos") for p in parts]
    return late[0] if len(late) == 1 else late[0].unionByName(late[1])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Which lines of each document stay.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Lines whose key has at least
    min_chars code points and is also in a smaller doc_id are dropped. Returns _doc, _text (the row key: doc_id, a
    null one before all others, and the text's xxhash64), n_dropped and keep_bitmap: 4-byte run lengths, of lines
    kept and dropped in turn. Documents that keep every line have no row, nor has an empty table. Repeated rows share a bitmap.
    """
    drops = _later_lines(docs, min_chars).groupBy("_doc", "_text").agg(F.array_sort(F.collect_set("_pos")).alias("_at"))
    at = F.col("_at")
    beside = lambda other: F.arrays_zip(at.alias("x"), other.alias("y"))
    starts = F.transform(F.filter(beside(F.concat(F.array(F.lit(-2)), at)), lambda r: r["x"] - r["y"] != 1), lambda r: r["x"])
    ends = F.transform(F.filter(beside(F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(-2)))), lambda r: r["y"] - r["x"] != 1), lambda r: r["x"])
    runs = drops.select("_doc", "_text", F.size(at).cast("bigint").alias("n_dropped"), starts.alias("_starts"), ends.alias("_ends"))
    zipped = F.arrays_zip(F.col("_starts").alias("s"), F.col("_ends").alias("e"), F.concat(F.array(F.lit(-1)), F.col("_ends")).alias("before"))
    lengths = F.flatten(F.transform(F.filter(zipped, lambda r: r["s"].isNotNull()), lambda r: F.array(r["s"] - r["before"] - 1, r["e"] - r["s"] + 1)))
    packed = F.unhex(F.array_join(F.transform(lengths, lambda n: F.lpad(F.hex(n), 8, "0")), ""))
    return runs.select("_doc", "_text", "n_dropped", packed.alias("keep_bitmap"))


def kept_text(text: Column, keep_bitmap: Column) -> Column:
    """The lines that a bitmap keeps, joined by newlines; the text itself where there is no bitmap."""
    lengths = F.transform(F.regexp_extract_all(F.hex(keep_bitmap), F.lit("(.{8})"), 1), lambda x: F.conv(x, 16, 10).cast("int"))
    dropped = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i % 2 == 1, n)))
    kept = F.zip_with(lines_of(text), dropped, lambda line, drop: F.when(~F.coalesce(drop, F.lit(False)), line))
    return F.when(keep_bitmap.isNull(), text).otherwise(F.array_join(kept, "\n"))


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with n_dropped and keep_bitmap (null where all lines stay); one row for each row of docs."""
    bitmaps = keep_bitmaps(docs, min_chars).withColumnRenamed("n_dropped", "_n").withColumnRenamed("keep_bitmap", "_bitmap")
    doc, text = _row_key()
    joined = docs.withColumns({"_doc": doc, "_text": text}).join(bitmaps.hint("shuffle_hash"), ["_doc", "_text"], "left")
    return joined.select(*docs.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_dropped"), F.col("_bitmap").alias("keep_bitmap"))


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text that its bitmaps keep; all rows and columns stay. Null texts stay null."""
    found = with_bitmaps(docs, min_chars)
    return found.withColumn("text", kept_text(F.col("text"), F.col("keep_bitmap"))).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op9."""
    found = with_bitmaps(docs.select("doc_id", "text"))
    return found.select(
        F.col("doc_id"), F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"), "n_dropped",
        F.sha2(F.coalesce(kept_text(F.col("text"), F.col("keep_bitmap")), F.lit("")), 256).alias("kept_sha256"),
    )
