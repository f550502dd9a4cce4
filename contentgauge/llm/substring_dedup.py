"""Substring dedup: seed and extend over winnowed anchors.

The seeds of a text are its winnowed anchors: of every WINDOW words in a row the runs of SEED words, and of these the
leftmost with the least hash. Windows in a row with the same anchor are one segment, the anchor extended both ways.
Documents are joined on anchors in two steps. Segments that are equal as a whole repeat in all their windows, and
only the first is kept. First segments that share an anchor but not the whole are extended window by window. Every
repeated window is found, as equal windows have equal anchors; overlapping ones unite to the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentgauge.llm.common import materialize

WINDOW, SEED = 20, 6
#: Keys with at least HOT_ROWS rows in a sample of documents, up to HOT_KEYS of them, are reduced by salts first.
SAMPLE, HOT_ROWS, HOT_KEYS, SALTS = 0.02, 50, 200, 32
#: Code points whose words are worked on together.
CHUNK = 2_000_000
_NO_ID = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Polynomial hashes, modulo 2^64, of any run of words."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        up, self.back = _powers(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n, at least, of a base and of its inverse."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        steps = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), b, np.uint64)]))
        _POWERS[base] = steps(base), steps(pow(base, -1, 1 << 64))
    return _POWERS[base]


class Segments:
    """Words of some texts, their segments and the hashes of runs of words. Words are numbered through all texts."""

    def __init__(self, texts: list[str | None]):
        self.words = [t.encode().split() if t else [] for t in texts]
        sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        n, windows = int(self.begin[-1]), np.maximum(sizes - WINDOW + 1, 0)
        self.last = self.begin[:-1] + windows  # behind each text's last window
        self.text = np.repeat(np.arange(len(texts)), windows)
        total = np.cumsum(windows)
        at = np.arange(len(self.text)) + np.repeat(self.begin[:-1] - (total - windows), windows)
        if not len(at):
            self.low = self.high = self.of = self.anchor = self.first = self.second = np.zeros(0, np.int64)
            return
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, n)
        self.rolling = [_Rolling(hashes, _BASES[0]), _Rolling(_mix(hashes + np.uint64(1)), _BASES[1])]
        seed = np.arange(n - SEED + 1)
        seeds = self.rolling[0].of(seed, seed + SEED)
        place = np.lib.stride_tricks.sliding_window_view(seeds, WINDOW - SEED + 1).argmin(axis=1)[at] + at
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.text[1:] != self.text[:-1])
        cut = np.flatnonzero(new)
        self.low, self.of = at[cut], self.text[cut]
        self.high = at[np.concatenate([cut[1:], [len(at)]]) - 1]
        self.anchor = seeds[place[cut]].view(np.int64)
        self.first, self.second = self.hashes(self.low, self.high + WINDOW)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for each run of words: int64 and int32."""
        return self.rolling[0].of(start, end).view(np.int64), (self.rolling[1].of(start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def repeats_inside(self) -> np.ndarray:
        """Which segments their text already held before."""
        out = np.zeros(len(self.low), bool)
        order = np.lexsort((self.second, self.first, self.of))  # stable, so that equal ones stay in order of place
        x, y = order[1:], order[:-1]
        out[x] = (self.of[x] == self.of[y]) & (self.first[x] == self.first[y]) & (self.second[x] == self.second[y])
        return out

    def marked(self, marks: list[list[dict] | None], segments: bool) -> np.ndarray:
        """Numbers of the segments, or first words of the windows, that marks (start and hash, by text) name.

        The hash is asked for as rows of one doc_id may have other texts.
        """
        rows = [(k, m["start"], m["h1"]) for k, ms in enumerate(marks) for m in ms or ()]
        if not rows or not len(self.low):
            return np.zeros(0, np.int64)
        text, start, h1 = np.array(rows, np.int64).T
        start = start + self.begin[text]
        inside = start < self.last[text]
        start, h1 = start[inside], h1[inside]
        if not segments:
            return start[self.hashes(start, start + WINDOW)[0] == h1]
        at = np.minimum(np.searchsorted(self.low, start), len(self.low) - 1)
        return np.unique(at[(self.low[at] == start) & (self.first[at] == h1)])


_SEGMENT = "anchor bigint, h1 bigint, h2 int, doc bigint, start int"


def _emit(s: Segments, docs: pa.Array, text: np.ndarray, anchor: np.ndarray, h1: np.ndarray, h2: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    own = (start - s.begin[text]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(h1), pa.array(h2), docs.take(pa.array(text)), pa.array(own)], names=["anchor", "h1", "h2", "doc", "start"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Segments]]:
    """Runs of rows of about CHUNK characters, and a longer text alone."""
    for b in batches:
        at = 0
        sizes = np.cumsum([len(t or "") for t in b.column("text").to_pylist()]) // CHUNK
        for end in [*(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(b)]:
            part = b.slice(at, end - at)
            at = end
            if len(part):
                yield part, Segments(part.column("text").to_pylist())


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first occurrence in its text of each segment."""
    for b, s in _parts(batches):
        if len(s.low):
            new = ~s.repeats_inside()
            yield _emit(s, b.column("doc"), s.of[new], s.anchor[new], s.first[new], s.second[new], s.low[new])


def _find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the segments to extend, with their own hash in the anchor's place."""
    for b, s in _parts(batches):
        chosen = s.marked(b.column("extend").to_pylist(), segments=True)
        if len(chosen):
            sizes = s.high[chosen] - s.low[chosen] + 1
            at = np.arange(sizes.sum()) + np.repeat(s.low[chosen] - (np.cumsum(sizes) - sizes), sizes)
            h1, h2 = s.hashes(at, at + WINDOW)
            yield _emit(s, b.column("doc"), np.repeat(s.of[chosen], sizes), h1, h1, h2, at)


def _find_ranges(with_text: bool):
    """Maximal repeats of each text, the text without them and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b, s in _parts(batches):
            depth = np.zeros(s.begin[-1] + 1, np.int64)
            if len(s.low):
                gone = s.repeats_inside()
                gone[s.marked(b.column("late").to_pylist(), segments=True)] = True
                at = s.marked(b.column("windows").to_pylist(), segments=False)
                np.add.at(depth, np.concatenate([s.low[gone], at]), 1)
                np.add.at(depth, np.concatenate([s.high[gone], at]) + WINDOW, -1)
            removed = np.cumsum(depth)[:-1] > 0
            n_removed, ranges, kept = [], [], []
            for k, words in enumerate(s.words):
                own = removed[s.begin[k] : s.begin[k + 1]]
                n_removed.append(n := int(np.count_nonzero(own)))
                if not n:
                    ranges.append([])
                    kept.append(b" ".join(words))
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2)
                ranges.append([{"start": x, "end": y} for x, y in edges.tolist()])
                kept.append(b" ".join(compress(words, (~own).tolist())))
            columns = {
                "doc_id": b.column("doc_id"), "n_words": pa.array(np.diff(s.begin)), "n_removed": pa.array(n_removed, pa.int64()), "ranges": pa.array(ranges, span),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
            if with_text:
                columns["kept"] = pa.array([x.decode() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _hot(rows: DataFrame) -> list[int]:
    counts = rows.groupBy("anchor").count().filter(F.col("count") >= HOT_ROWS)
    return [r["anchor"] for r in counts.orderBy(F.desc("count"), "anchor").limit(HOT_KEYS).collect()]


def _with_first(rows: DataFrame, hot: list[int]) -> DataFrame:
    """rows with late: an equal run (anchor, h1, h2) starts earlier.

    Rows of hot anchors are ordered in salted streams first. Only the first row of each salt goes on to the stream of
    its anchor; the others are late whatever comes from there. All other rows go there at once.
    """
    run = ["anchor", "h1", "h2"]
    here = F.struct("doc", "start")
    late = here > F.first(here).over(Window.partitionBy(*run).orderBy("doc", "start"))
    if not hot:
        return rows.repartition("anchor").withColumn("late", late)
    salted = rows.filter(F.col("anchor").isin(hot)).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    salted = salted.repartition("anchor", "salt").withColumn("late", here > F.first(here).over(Window.partitionBy(*run, "salt").orderBy("doc", "start"))).drop("salt")
    ahead = rows.filter(~F.col("anchor").isin(hot)).unionByName(salted.filter(~F.col("late")).drop("late"))
    return ahead.repartition("anchor").withColumn("late", late).unionByName(salted.filter("late"))


def find_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Words covered by a run of WINDOW words that also starts earlier: in a smaller doc_id, or before in the document.

    Returns doc_id, n_words, n_removed, ranges (maximal repeats as word ranges), kept_sha256 (of the other
    words, joined by one space) and, with_text, kept (those words); one row per input row. Words are runs of characters other than ASCII white space. A null or
    short text has no windows. A null doc_id comes before all others; rows of one doc_id count as one document, so
    repeated rows remove nothing from each other.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    texts = rows.select("doc", "text")
    segments = texts.mapInArrow(_find_segments, _SEGMENT)
    hot = _hot(texts.sample(SAMPLE, seed=4).mapInArrow(_find_segments, _SEGMENT))
    known = _with_first(segments, hot)
    # first segments of an anchor that differ are extended
    whole = Window.partitionBy("anchor")
    first = known.filter(~F.col("late")).withColumn("several", F.min("h1").over(whole) != F.max("h1").over(whole))
    known = first.unionByName(known.filter("late").withColumn("several", F.lit(False)))
    mark = F.struct("start", "h1")
    marks = known.filter("late or several").groupBy("doc").agg(F.collect_list(F.when(F.col("late"), mark)).alias("late"), F.collect_list(F.when(~F.col("late"), mark)).alias("extend"))
    marks = materialize(marks)
    extend = marks.filter(F.size("extend") > 0).select("doc", "extend")
    windows = texts.join(extend.hint("shuffle_hash"), "doc").mapInArrow(_find_windows, _SEGMENT)
    later = _with_first(windows, hot=[]).filter("late").groupBy("doc").agg(F.collect_list(mark).alias("windows"))
    later = materialize(later)
    found = rows.join(marks.select("doc", "late").hint("shuffle_hash"), "doc", "left").join(later.hint("shuffle_hash"), "doc", "left")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, ranges array<struct<start:int,end:int>>, kept_sha256 string" + ", kept string" * with_text
    return found.select("doc_id", "text", "late", "windows").mapInArrow(_find_ranges(with_text), schema)

