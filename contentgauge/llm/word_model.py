"""Word model: interpolated modified Kneser-Ney of order 2, and words that mark toxic documents.

The most common trusted words have numbers (all others are one class); their figures fit in a few MB and every task
has them. Counts of word pairs grow with the text and never lie in one place: they are dealt over shards, packed. The
logarithm of a text's probability is a sum of one figure for each word and one for each pair that the model has seen,
so each pair is looked up alone: texts send a chunk's pairs to the shards, with the texts that hold them, and get sums
by text back. The most common pairs, a bounded number, are known to all tasks and not sent, so that no shard is hot.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from operator import eq, or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgauge.llm.common import materialize

#: Most words with a number of their own, most pairs and most marking words that all tasks hold.
VOCABULARY, PAIRS, MARKS = 131_072, 262_144, 65_536
#: Words that are sorted together, texts at most.
CHUNK, TEXTS = 750_000, 60_000
#: Words of trusted text for each shard, where the session's number of shuffle partitions gives it more.
WORDS_IN_SHARD = 8_000_000
#: A word marks toxic documents if they hold it so many times as often as trusted ones, with a chance of at most exp(-EVIDENCE) that any word does so without cause.
TOXIC_RATIO, EVIDENCE = 5, 3
WORD = re.compile(r"\w+|[^\w\s]")
#: Bits of a word's number. 0 stands before and after a text, 1 for all words without a number.
BITS = 18
MASK = (1 << BITS) - 1

_STAT = ("total", "types", "n1", "n2", "n3", "n4", "before")


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Model:
    """What every task holds: figures of single words and of the most common pairs."""

    hashes: np.ndarray  # ascending int64; the word at k has the number k + 2
    mark_hashes: np.ndarray
    mark_weights: np.ndarray
    splits: np.ndarray  # by number: over how many shards the pairs behind a word are dealt
    shards: int
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by number, as a context
    back: np.ndarray = field(default_factory=lambda: np.zeros(0))
    p: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the lower order
    single: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log(p * back); of a word without a number, not of their class
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of the most common pairs, ascending
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def pair_values(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log p(w | v) - log(back(v) p(w)) of pairs seen n times."""
        v, w = keys >> BITS, keys & MASK
        lower = self.back[v] * self.p[w]
        return np.log(((n - self.discounts[np.minimum(n, 3)]) / self.total[v] + lower) / lower)

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        """The pairs behind one word lie together, but those of common words are dealt by the second word too."""
        v, w = (keys >> BITS).astype(np.uint64), (keys & MASK).astype(np.uint64)
        part = _mixed(w) % self.splits[keys >> BITS].astype(np.uint64)
        return (_mixed(v * np.uint64(65_537) + part) % np.uint64(self.shards)).astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(30))


class _Numbers(dict):
    """The number of a word, and above its BITS the place of a marking word, from 1."""

    def __init__(self, model: Model):
        super().__init__()
        self.known = dict(zip(model.hashes.tolist(), range(2, len(model.hashes) + 2), strict=True))
        for k, h in enumerate(model.mark_hashes.tolist()):
            self.known[h] = self.known.get(h, 1) | (k + 1) << BITS

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = self.known.get(word_hash(word), 1)
        return got


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = word_hash(word)
        return got


def cut(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def numbered(words: list[str], table: dict) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words))


def repeats(words: list[str]) -> int:
    """Words that are the same as one of the two before them."""
    return sum(map(or_, map(eq, words[2:], words[1:]), map(eq, words[2:], words)))


def pair_keys(numbers: np.ndarray) -> np.ndarray:
    """Pairs of a text's words, with its start and its end."""
    ends = np.zeros(len(numbers) + 2, np.int64)
    ends[1:-1] = numbers
    return ends[:-1] << BITS | ends[1:]


def packed(x: np.ndarray) -> bytes:
    """Small numbers, byte by byte."""
    return zlib.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def count_words(texts: DataFrame) -> DataFrame:
    """w (hash), n (in trusted texts), good and bad (trusted and toxic texts that hold it) of texts(text, toxic)."""
    schema = pa.schema([(c, pa.int64()) for c in ("w", "n", "good", "bad")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, size = _Hashes(), {True: [], False: []}, 0

        def emit():
            word, at = np.unique(np.concatenate(parts[True] + parts[False]), return_inverse=True)
            bad = sum(map(len, parts[True]))
            once = [np.concatenate([np.zeros(0, np.int64), *map(np.unique, parts[t])]) for t in (False, True)]
            docs = [np.bincount(np.searchsorted(word, x), minlength=len(word)) for x in once]
            yield _batch(schema, word, np.bincount(at[bad:], minlength=len(word)), *docs)

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                got = numbered(cut(text), hashes)
                parts[toxic].append(got)
                size += len(got)
                if size >= CHUNK:
                    yield from emit()
                    parts, size = {True: [], False: []}, 0
        if size:
            yield from emit()

    return texts.select("text", "toxic").mapInArrow(run, "w bigint, n bigint, good bigint, bad bigint").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])


def bins(n: np.ndarray) -> np.ndarray:
    """Counts in bins that only large ones share; a few thousand bins hold any counts."""
    return np.where(n < 1024, n, 1024 + np.floor(64 * (np.log2(np.maximum(n, 1)) - 10))).astype(np.int64)


_BIN = "IF(n < 1024, n, 1024 + CAST(FLOOR(64 * (LOG2(n) - 10)) AS BIGINT))"


def least_bin(sizes: dict[int, int], most: int) -> int:
    """The least bin from which on at most so many are left."""
    left, least = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        if (left := left + sizes[k]) > most:
            break
        least = k
    return least


def toxic_marks(words: DataFrame, good: int, bad: int) -> DataFrame:
    """w and weight (log ratio) of at most MARKS words that mark toxic documents, from words(w, good, bad) and the numbers of texts."""
    found = words.filter("bad > 0").withColumn("mean", bad * (F.col("good") + 1) / F.lit(good + 1))
    tested = found.count()
    # Chernoff's bound on the chance of so many documents, over all words that are tested
    evidence = F.col("bad") * F.log(F.col("bad") / F.col("mean")) - F.col("bad") + F.col("mean")
    marks = found.withColumn("evidence", evidence).filter((F.col("bad") >= TOXIC_RATIO * F.col("mean")) & (F.col("evidence") >= float(np.log(max(tested, 1))) + EVIDENCE))
    return marks.orderBy(F.desc("evidence"), "w").limit(MARKS).select("w", F.log(F.col("bad") / F.col("mean")).alias("weight"))


_PACK = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def count_pairs(texts: DataFrame, model: Model) -> DataFrame:
    """Pairs of texts(text) and how often they stand there: shard, keys (ascending, as differences) and counts, packed."""
    handed = texts.sparkSession.sparkContext.broadcast(model)

    def rows(keys, counts):
        at = handed.value.shard_of(keys)
        order = np.argsort(at, kind="stable")
        keys, counts, at = keys[order], counts[order], at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        for lo, hi in zip(starts, [*starts[1:], len(at)], strict=True):
            yield _batch(_PACK, [at[lo]], [packed(np.diff(keys[lo:hi], prepend=0))], [packed(counts[lo:hi])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parts, size = _Numbers(handed.value), [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                parts.append(pair_keys(numbered(cut(text), numbers) & MASK))
                size += len(parts[-1])
                if size >= CHUNK:
                    yield from rows(*np.unique(np.concatenate(parts), return_counts=True))
                    parts, size = [], 0
        if parts:
            yield from rows(*np.unique(np.concatenate(parts), return_counts=True))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, shard = [], 0, None

        def summed():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        for b in batches:
            for r in b.to_pylist():
                shard = r["shard"]
                parts.append((np.cumsum(unpacked(r["keys"])), unpacked(r["counts"])))
                size += len(parts[-1][0])
                if size > 2 * WORDS_IN_SHARD:
                    parts = [summed()]
                    size = len(parts[0][0])
        if parts:
            keys, counts = summed()
            for k in range(0, len(keys), 1_000_000):
                yield _batch(_PACK, [shard], [packed(np.diff(keys[k : k + 1_000_000], prepend=0))], [packed(counts[k : k + 1_000_000])])

    schema = "shard int, keys binary, counts binary"
    return texts.select("text").mapInArrow(run, schema).repartitionById(model.shards, "shard").mapInArrow(merged, schema)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for r in b.to_pylist():
            yield np.cumsum(unpacked(r["keys"])), unpacked(r["counts"])


def word_figures(pairs: DataFrame) -> DataFrame:
    """Per number: total and types of the pairs behind it, how many of these stand 1, 2, 3 and 4 times, and before, the number of words before it."""
    schema = pa.schema([("word", pa.int64()), *[(c, pa.int64()) for c in _STAT]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _opened(batches):
            v, at = np.unique(keys >> BITS, return_inverse=True)
            of = lambda hit: np.bincount(at[hit], minlength=len(v))  # noqa: B023, E731
            yield _batch(schema, v, np.bincount(at, n).astype(np.int64), np.bincount(at), *[of(n == k) for k in (1, 2, 3, 4)], np.zeros(len(v), np.int64))
            w, before = np.unique(keys & MASK, return_counts=True)
            yield _batch(schema, w, *[np.zeros(len(w), np.int64)] * 6, before)

    found = pairs.mapInArrow(run, "word bigint, " + ", ".join(f"{c} bigint" for c in _STAT))
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in _STAT])


def common_pairs(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and counts of the most common pairs, at most PAIRS."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n in _opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(bins(n), return_counts=True)], names=["bin", "size"])

    of = {r["bin"]: r["size"] for r in pairs.mapInArrow(sizes, "bin bigint, size bigint").groupBy("bin").agg(F.sum("size").alias("size")).collect()}
    least = least_bin(of, PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _opened(batches):
            hit = bins(n) >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(n[hit])], names=["key", "n"])

    got = pairs.mapInArrow(run, "key bigint, n bigint").toArrow()
    keys, n = (got.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    return keys[order], n[order]


def learn(texts: DataFrame, shards: int | None = None) -> tuple[Model, DataFrame]:
    """The model of texts(text, toxic), texts neither null nor empty, and its pairs (count_pairs). Toxic texts only give marking words."""
    spark = texts.sparkSession
    words = materialize(count_words(texts))
    of = {r["bin"]: r["size"] for r in words.filter("n > 0").groupBy(F.expr(_BIN).alias("bin")).agg(F.count("*").alias("size")).collect()}
    known = words.filter("n > 0").filter(F.expr(_BIN) >= least_bin(of, VOCABULARY)).select("w", "n").toArrow()
    order = np.argsort(known.column("w").to_numpy())
    hashes, n = known.column("w").to_numpy()[order], known.column("n").to_numpy()[order]
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("int")), F.lit(0))).first()
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    marks = toxic_marks(words, sizes.get(False, 0), sizes.get(True, 0)).toArrow()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // WORDS_IN_SHARD)
    share = np.r_[sizes.get(False, 0), total - n.sum(), n] / max(total, 1)
    model = Model(hashes, marks.column("w").to_numpy(), marks.column("weight").to_numpy(), 1 + np.floor(4 * shards * share).astype(np.int64), shards)
    pairs = materialize(count_pairs(texts.filter("not toxic"), model))
    got = word_figures(pairs).toArrow()
    stat = {c: np.zeros(len(hashes) + 2) for c in _STAT}
    for c in _STAT:
        stat[c][got.column("word").to_numpy()] = got.column(c).to_numpy()
    estimate(model, stat, kinds - len(hashes))
    model.keys, n = common_pairs(pairs)
    model.values = model.pair_values(model.keys, n).astype(np.float32)
    return model, pairs


def estimate(model: Model, stat: dict[str, np.ndarray], others: int) -> None:
    """Discounts, weights of contexts and lower-order probabilities; others is the number of different trusted words without a number."""
    count = [0.0, *[stat[f"n{k}"].sum() for k in (1, 2, 3, 4)]]
    y = count[1] / (count[1] + 2 * count[2]) if count[1] + count[2] else 0.5
    ratio = lambda k: count[k + 1] / count[k] if count[k] else 0.0
    model.discounts = np.array([0.0, *[min(max(k - (k + 1) * y * ratio(k), 0.05), k - 0.05) for k in (1, 2, 3)]])
    held = stat["n1"] * model.discounts[1] + stat["n2"] * model.discounts[2] + (stat["types"] - stat["n1"] - stat["n2"]) * model.discounts[3]
    model.total = np.maximum(stat["total"], 1)
    model.back = np.where(stat["total"] > 0, held / model.total, 1.0)
    before = stat["before"]
    b1, b2 = (before == 1).sum(), (before == 2).sum()
    d0 = min(max(b1 / (b1 + 2 * b2), 0.05), 0.95) if b1 + b2 else 0.5
    types = before.sum()
    seen = np.where(before > 0, before - d0, 0)
    model.p = (seen + (types - seen.sum()) / len(before)) / types if types else np.full(len(before), 1 / len(before))
    single = model.p * model.back
    single[1] /= max(others, 1)
    model.single = np.log(single)


_ASK = pa.schema([("shard", pa.int32()), ("tag", pa.int32()), ("chunk", pa.string()), ("size", pa.int32()), *[(c, pa.binary()) for c in ("keys", "counts", "texts")]])
_SHAPE = "shard int, tag int, chunk string, size int, keys binary, counts binary, texts binary"


def ask(texts: DataFrame, model) -> DataFrame:
    """By shard, the uncommon pairs of a chunk of texts(text, ...) with the texts that hold them (tag 1); and what is known of its texts already, beside their other columns (tag 2)."""
    others = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        numbers, found, keys, kept, size, n_chunks = _Numbers(own), [], [], [], 0, 0
        weights = np.r_[0.0, own.mark_weights]

        def emit():
            chunk = f"{TaskContext.get().partitionId()}-{n_chunks}"
            key, text = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            at = own.shard_of(key)
            order = np.lexsort((text, key, at))
            key, text, at = key[order], text[order], at[order]
            ends = np.searchsorted(at, np.arange(own.shards + 1))
            for s in np.unique(at):
                k, t = key[ends[s] : ends[s + 1]], text[ends[s] : ends[s + 1]]
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                yield _batch(_ASK, [s], [1], [chunk], [len(keys)], [packed(np.diff(k[first], prepend=0))], [packed(np.diff(np.r_[first, len(k)]))], [packed(t)])
            table = pa.Table.from_batches(kept)
            for name, column in zip(("n", "known", "toxic", "repeats"), zip(*found, strict=True), strict=True):
                table = table.append_column(f"_{name}", pa.array(column, pa.float64()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield _batch(_ASK, [n_chunks % own.shards], [2], [chunk], [len(keys)], [zlib.compress(sink.getvalue().to_pybytes(), 1)], [b""], [b""])

        for b in batches:
            start = 0
            for k, text in enumerate(b.column("text").to_pylist()):
                words = cut(text)
                codes = numbered(words, numbers)
                ids, marks = codes & MASK, np.unique(codes >> BITS)
                pairs = pair_keys(ids) if len(ids) else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(own.keys, pairs), max(len(own.keys) - 1, 0))
                hit = own.keys[at] == pairs if len(own.keys) else np.zeros(len(pairs), bool)
                known = own.single[ids].sum() + own.single[0] + own.values[at[hit]].sum(dtype=np.float64) if len(ids) else 0.0
                found.append((len(pairs), known, weights[marks].max(initial=0.0), repeats(words)))
                keys.append(pairs[~hit])
                size += len(pairs)
                if size >= CHUNK or len(keys) >= TEXTS:
                    kept.append(b.select(others).slice(start, k + 1 - start))
                    yield from emit()
                    start, found, keys, kept, size, n_chunks = k + 1, [], [], [], 0, n_chunks + 1
            if start < b.num_rows:
                kept.append(b.select(others).slice(start))
        if keys:
            yield from emit()

    return texts.select("text", *others).mapInArrow(run, _SHAPE)


def score(texts: DataFrame, model: Model, pairs: DataFrame) -> DataFrame:
    """texts(text, ...) without the text, with n (words and the end), score (mean -log p), toxic (weight of the heaviest marking word) and repeats.

    A null or empty text has n 0, a null score, no toxic words and no repeats. Names that begin with _ are taken.
    """
    handed = texts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("chunk", pa.string()), ("head", pa.bool_()), ("a", pa.binary()), ("b", pa.binary())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by text from the rows of one shard: first the model's, then what is asked."""
        own, parts, keys, values = handed.value, [], None, None
        for b in batches:
            for r in b.to_pylist():
                if r["tag"] == 0:
                    k = np.cumsum(unpacked(r["keys"]))
                    parts.append((k, own.pair_values(k, unpacked(r["counts"]))))
                    continue
                if r["tag"] == 2:
                    yield _batch(schema, [r["chunk"]], [True], [r["keys"]], [b""])
                    continue
                if keys is None:
                    keys, values = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.array([-1]), np.zeros(1))
                    parts = []
                asked = np.cumsum(unpacked(r["keys"]))
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                value = np.where(keys[at] == asked, values[at], 0.0)
                sums = np.bincount(unpacked(r["texts"]), np.repeat(value, unpacked(r["counts"])), r["size"])
                if len(held := np.flatnonzero(sums)):
                    yield _batch(schema, [r["chunk"]], [False], [packed(np.diff(held, prepend=0))], [sums[held].astype(np.float32).tobytes()])

    names = [f.name for f in texts.schema if f.name != "text"]
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text"], "n bigint", "score double", "toxic double", "repeats double"])

    def added(rows: pa.Table) -> pa.Table:
        """The texts of a chunk with their sums over the shards."""
        table = extra = None
        for r in rows.to_pylist():
            if r["head"]:
                table = pa.ipc.open_stream(zlib.decompress(r["a"])).read_all()
        extra = np.zeros(table.num_rows)
        for r in rows.to_pylist():
            if not r["head"]:
                extra[np.cumsum(unpacked(r["a"]))] += np.frombuffer(r["b"], np.float32)
        n = table.column("_n").to_numpy()
        score = -(table.column("_known").to_numpy() + extra) / np.maximum(n, 1)
        return pa.table([*[table.column(c) for c in names], pa.array(n.astype(np.int64)), pa.array(score, mask=n == 0), table.column("_toxic"), table.column("_repeats")], names=[*names, "n", "score", "toxic", "repeats"])

    held = pairs.select("shard", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("chunk"), F.lit(0).alias("size"), "keys", "counts", F.lit(None).cast("binary").alias("texts"))
    dealt = held.unionByName(ask(texts, handed)).repartitionById(model.shards, "shard").sortWithinPartitions("tag")
    return dealt.mapInArrow(look_up, "chunk string, head boolean, a binary, b binary").groupBy("chunk").applyInArrow(added, shape)
