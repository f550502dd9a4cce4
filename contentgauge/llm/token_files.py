"""Token files of directly addressable codes.

The ids of all documents, in doc_id order, are one sequence. It is cut into segments of whole documents; a segment
splits every id into chunks, level by level: level 0 has the lowest bits of all ids, each further level the next bits of
those ids that are not used up. A continuation bitmap on each level says which ids go on, and a rank directory of ones
before every block of the bitmap says where. Any id is so read from a few bytes at computed places, and nothing is
decoded before it.

A segment is a row of a Parquet table, so that Spark's committer makes the files on any store and a lost executor costs
its tasks only: part (range of documents), offset (ids of the part before it), n_tokens, doc_ids, sizes and codes. A
directory beside it has each part's start in the whole sequence.

Layout of codes, little-endian: magic, number of levels (u4), number of ids (u8); for each level its width in bytes (u4)
and number of chunks (u8); then for each level its chunks, and, for all but the last, its bitmap (lowest bit first, whole
blocks) and rank directory (u4 for each block).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgauge.llm.common import materialize, shared_dir

MAGIC = b"DAC1"
#: Bytes of the chunks of each level; the last level takes what is left of an id.
WIDTHS = (1, 1, 2)
#: Bits of a bitmap between two entries of its rank directory.
BLOCK = 512
#: Ids from which a segment is closed, and code points of texts that are encoded together.
SEGMENT, CHUNK = 1 << 18, 5_000_000
#: Ids of a part; there are at most so many parts, larger ones beyond, so that the directory stays small.
PART, PARTS = 1 << 23, 100_000
#: Words whose ids a worker remembers, twice: those of the present term and of the one before.
MEMO = 700_000
_HEAD, _LEVEL = struct.Struct("<4sIQ"), struct.Struct("<IQ")


def pack(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The codes of ids from 0 to 2^32 - 1."""
    rest, levels = np.asarray(ids, np.uint32), []
    for k, width in enumerate(widths):
        last = k == len(widths) - 1 or not (rest >> np.uint32(8 * width) if width < 4 else rest[:0]).any()
        chunk = (rest & np.uint32((1 << 8 * width) - 1)).astype(f"<u{width}")
        if last and width < 4 and (rest >> np.uint32(8 * width)).any():
            raise ValueError("ids do not fit the levels")
        goes_on = rest >= 1 << 8 * width if width < 4 else np.zeros(len(rest), bool)
        body = chunk.tobytes()
        if not last:
            bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
            bits[: len(rest)] = goes_on
            ones = bits.reshape(-1, BLOCK).sum(axis=1)
            body += np.packbits(bits, bitorder="little").tobytes() + (np.cumsum(ones) - ones).astype("<u4").tobytes()
        levels.append((width, len(rest), body))
        rest = rest[goes_on] >> np.uint32(8 * width) if not last else rest[:0]
        if last:
            break
    return _HEAD.pack(MAGIC, len(levels), len(ids)) + b"".join(_LEVEL.pack(w, n) for w, n, _ in levels) + b"".join(b for *_, b in levels)


class Codes:
    """Reads packed codes in place."""

    def __init__(self, data: bytes):
        magic, n_levels, self.n = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at, self.levels = _HEAD.size + n_levels * _LEVEL.size, []
        for k in range(n_levels):
            width, n = _LEVEL.unpack_from(data, _HEAD.size + k * _LEVEL.size)
            chunks = np.frombuffer(data, f"<u{width}", n, at)
            at += width * n
            bits = ranks = None
            if k < n_levels - 1:
                blocks = -(-n // BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
                ranks = np.frombuffer(data, "<u4", blocks, at + len(bits))
                at += len(bits) + 4 * blocks
            self.levels.append((8 * width, chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def at(self, place: int) -> int:
        """One id: a chunk a level, and a rank within one block of the bitmap where the id goes on."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = shift = 0
        for width, chunks, bits, ranks in self.levels:
            value |= int(chunks[place]) << shift
            if bits is None or not bits[place >> 3] >> (place & 7) & 1:
                return value
            block = place // BLOCK
            within = int.from_bytes(bits[block * BLOCK // 8 : (place >> 3) + 1].tobytes(), "little")
            within &= (1 << place - block * BLOCK) - 1
            place, shift = int(ranks[block]) + within.bit_count(), shift + width
        return value

    def all(self) -> np.ndarray:
        """Every id, uint32."""
        out, rest, shift = np.zeros(self.n, np.uint32), np.arange(self.n), 0
        for width, chunks, bits, _ in self.levels:
            if shift:
                out[rest] |= chunks.astype(np.uint32) << np.uint32(shift)
            else:
                out[:] = chunks
            if bits is not None:
                rest = rest[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
            shift += width
        return out


#: Before a single space between two characters that are no white space, the tokenizer's pre-tokens always end.
BORDER = re.compile(r"(?<=\S)(?= \S)")
#: Closing marks that are a pre-token of their own behind a letter, at the end of a word.
MARKS = ".,;:!?"


class Encoder:
    """The library's ids of texts; words that come again are encoded once.

    A text is cut where a word ends and one space and another word follow. A byte-level pre-token never goes over such a
    place, nor does its look-ahead, and no special token holds a space, so the ids of the parts are the text's. New
    words without white space inside go to the library many at a time, behind a space each: of a word's tokens only the
    first begins with a space, which tells them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work; idle threads would only cost
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = self.library.get_vocab()
        self.type = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # a byte-level vocabulary writes the space so
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Words are told apart and numbered by Arrow; per word, Python sees the different ones only."""
        cut = pc.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), " ")
        told, ends = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        numbers, words = told.indices.to_numpy().astype(np.int64), told.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMO:
            # words met since the last change are kept for another term, others go
            self.before, self.known, new = self.known, {}, words
        known, before = self.known, self.before
        for w in new:
            if w in before:
                known[w] = before.pop(w)
        self._learn([w for w in new if w not in known])
        # the first word of a text has no space before it, so it is an entry of its own
        heads = [words[k] for k in numbers[ends[:-1]].tolist()] if texts else []
        own = dict.fromkeys(heads)
        place = {h: len(words) + k for k, h in enumerate(own)}
        numbers[ends[:-1]] = [place[h] for h in heads]
        data = [*map(self.known.get, words), *self._apart(list(own))]
        odd = np.array([x is None for x in data[: len(words)]] + [h[-1:].isspace() for h in own], bool)
        data = [x or b"" for x in data]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // self.type.itemsize
        flat, starts = np.frombuffer(b"".join(data), self.type), np.cumsum(sizes) - sizes
        n = sizes[numbers]
        done = np.cumsum(n)
        ids = flat[np.repeat(starts[numbers] - (done - n), n) + np.arange(int(n.sum()))]
        bounds = np.concatenate([[0], done[ends[1:] - 1]]).tolist()
        out = [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
        # other white space at a border: only some spaces are places to cut at
        for k in np.flatnonzero(np.logical_or.reduceat(odd[numbers], ends[:-1])).tolist() if texts else ():
            out[k] = np.frombuffer(b"".join(self._apart(BORDER.split(texts[k]))), self.type)
        return out

    def _apart(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.type).tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """The ids of words as they are behind a space; words that begin or end with white space, or are none, are left out."""
        plain = [w for w in words if w and w.isprintable()]
        if len(plain) < len(words):
            odd = [w for w in words if not w.isprintable()]
            plain += [w for w in odd if w.split() == [w]]
            inner = [w for w in odd if len(w.split()) > 1 and not (w[0].isspace() or w[-1].isspace())]
            self.known.update(zip(inner, self._apart([f" {w}" for w in inner]), strict=True))
        marked = [w for w in plain if w[-1] in MARKS and w[-2:-1].isalpha()]
        stems = {w[:-1] for w in marked}
        self._learn_plain(list((stems | set(plain).difference(marked)) - self.known.keys()))
        tail, known = dict(zip(MARKS, self._apart(list(MARKS)), strict=True)), self.known
        known.update([(w, known[w[:-1]] + tail[w[-1]]) for w in marked])

    def _learn_plain(self, words: list[str]) -> None:
        size = self.type.itemsize
        for k in range(0, len(words), 10_000):
            some = words[k : k + 10_000]
            lines = [" " + " ".join(some[j : j + 30]) for j in range(0, len(some), 30)]
            ids = np.array(list(chain.from_iterable([x.ids for x in self.library.encode_batch_fast(lines, add_special_tokens=False)])), self.type)
            ends = (np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * size).tolist()
            data = ids.tobytes()
            self.known.update(zip(some, [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))


@cache
def encoder_of(path: str) -> Encoder:
    """The encoder of this worker, whose words are remembered from task to task."""
    return Encoder(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """doc_id, n_tokens, crc32 and ids (zstd over 16 or 32 bits an id) of every whole text, written out once; one row per input row.

    The end id closes every document. A null text is an empty one. place numbers the rows, to tell repeated ids apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, codec = encoder_of(tokenizer_path), pa.Codec("zstd", 1)
        end = np.array([] if end_id is None else [end_id], encoder.type)
        for b in batches:
            column, at = b.column("text"), 0
            while at < b.num_rows:
                texts, size = [], 0
                while at < b.num_rows and (size < CHUNK or not texts):
                    texts.append(column[at].as_py())
                    size, at = size + len(texts[-1] or ""), at + 1
                ids = [np.concatenate([x, end]) for x in encoder.texts(texts)]
                crc = [zlib.crc32(x.astype("<u4")) for x in ids]
                packed = [codec.compress(x.tobytes(), asbytes=True) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at - len(texts), len(texts)), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array([encoder.type.itemsize] * len(ids), pa.int32()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_tokens", "crc32", "id_bytes", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, crc32 bigint, id_bytes int, ids binary")
    return materialize(found.withColumn("place", F.monotonically_increasing_id()))


def write_tokens(encoded: DataFrame, path: str | None = None) -> str:
    """Writes the token files of encoded documents under path (by default in the shared folder) and returns it.

    Documents are ordered by doc_id, null first, rows of one id by n_tokens, crc32 and place. Ranges hold about PART ids
    each; a row is moved once, as compressed ids.
    """
    path = path or f"{shared_dir(encoded.sparkSession)}/tokens-{uuid.uuid4().hex}"
    n_parts = min(1 + (encoded.agg(F.sum("n_tokens")).first()[0] or 0) // PART, PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codec, offset, held, ids, n = TaskContext.get().partitionId(), pa.Codec("zstd"), 0, [], [], 0

        def segment() -> pa.RecordBatch:
            codes = pack(np.concatenate(ids)) if ids else pack(np.zeros(0, np.uint32))
            row = [pa.array([x], pa.int64()) for x in (part, offset, n)]
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (held, [len(x) for x in ids])]
            return pa.RecordBatch.from_arrays([*row, *lists, pa.array([codes], pa.binary())], names=["part", "offset", "n_tokens", "doc_ids", "sizes", "codes"])

        for b in batches:
            for doc_id, count, width, data in zip(*(b.column(c) for c in ("doc_id", "n_tokens", "id_bytes", "ids")), strict=True):
                held.append(doc_id.as_py())
                count, width = count.as_py(), width.as_py()
                ids.append(np.frombuffer(codec.decompress(data.as_py(), count * width), f"<u{width}").astype(np.uint32))
                n += count
                if n >= SEGMENT:
                    yield segment()
                    offset, held, ids, n = offset + n, [], [], 0
        if held:
            yield segment()

    keys = ["doc_id", "n_tokens", "crc32", "place"]
    ranges = encoded.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "id_bytes", "ids")
    ranges.mapInArrow(run, "part bigint, offset bigint, n_tokens bigint, doc_ids array<bigint>, sizes array<bigint>, codes binary").write.option("compression", "zstd").parquet(f"{path}/segments")
    spark = encoded.sparkSession
    # a row for each part, at most PARTS
    start, rows = 0, []
    for part, n in sorted(map(tuple, spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens")).collect())):
        rows.append((part, start, n))
        start += n
    spark.createDataFrame(rows, "part bigint, start bigint, n_tokens bigint").coalesce(1).write.parquet(f"{path}/directory")
    return path


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, with_ids, ids of every document in token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                sizes = np.array(b.column("sizes")[k].as_py(), np.int64)
                ids, ends = Codes(b.column("codes")[k].as_py()).all(), np.cumsum(sizes)
                bounds = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                columns = [b.column("doc_ids")[k].values, pa.array(b.column("start")[k].as_py() + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(ids[x:y]) for x, y in bounds], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([ids[x:y].astype(np.int64) for x, y in bounds], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _segments(spark, path).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their start in the whole sequence. The directory has at most PARTS rows and is broadcast."""
    directory = spark.read.parquet(f"{path}/directory").select("part", F.col("start").alias("_base"))
    return spark.read.parquet(f"{path}/segments").join(F.broadcast(directory), "part").withColumn("start", F.col("_base") + F.col("offset"))


def read_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """place and id for a list of places in the whole sequence. Only segments that hold one are read, and of these only the codes of the places."""
    sought = np.array(sorted(set(places)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column("start"), b.column("codes"), strict=True):
                codes, start = Codes(data.as_py()), start.as_py()
                own = sought[np.searchsorted(sought, start) : np.searchsorted(sought, start + len(codes))].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([codes.at(p - start) for p in own], pa.int64())], names=["place", "id"])

    low, high = F.col("start"), F.col("start") + F.col("n_tokens")
    holds = F.exists(F.lit(sought.tolist()), lambda x: (x >= low) & (x < high)) if len(sought) else F.lit(False)
    return _segments(spark, path).where(holds).select("start", "codes").mapInArrow(run, "place bigint, id bigint")
