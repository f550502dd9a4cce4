"""SentencePiece encoding and decoding: merge rounds over flat numpy symbol arrays."""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgauge.llm import pieces

#: Symbols outside the vocabulary are single code points behind this offset.
_RAW = 1 << 21
_NONE = np.int64(1 << 40)
#: Symbols from which on a word is merged on its own, so that a round costs what it merges.
LONG = 400
#: Words whose ids a task remembers at once, of at most so many characters.
MEMO, SHORT = 200_000, 60
codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class Codec:
    def __init__(self, vocabulary: pieces.Vocabulary):
        self.vocabulary = v = vocabulary
        rank = {p.replace(pieces.SPACE, " "): r for p, r in v.rank.items()}
        ids = {p.replace(pieces.SPACE, " "): i for p, i in v.ids.items()}
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.chars, self.char_ids = np.array([c for c, _ in single], np.int64), np.array([i for _, i in single], np.int64)
        symbol = lambda p: ids.get(p, _RAW + ord(p) if len(p) == 1 else -1)
        pairs = [(a << 22 | b, r, ids[p]) for p, r in rank.items() for k in range(1, len(p)) if (a := symbol(p[:k])) >= 0 and (b := symbol(p[k:])) >= 0]
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array([x[k] for x in pairs], np.int64) for k in range(3))
        self.tied = np.bincount(list(rank.values())) > 1  # ranks that several pieces share
        # characters that stand side by side in no piece: a word falls apart between them
        inside = np.unique(np.array([ord(a) << 21 | ord(b) for p in rank for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.inside = inside if len(inside) else np.array([-1])
        self.known: dict[str, np.ndarray] = {}
        self.byte_ids = np.array(v.byte_ids, np.int64)
        surface = {i: p.replace(pieces.SPACE, " ").encode() for i, p in enumerate(v.pieces)}
        surface |= {i: b"" for i in v.control} | {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        surface[v.unknown] = " ⁇ ".encode()
        self.surface = [surface[i] for i in range(len(v.pieces))]

    def _merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds. symbols and word (ascending word numbers) are flat and as long as each other.

        Every round takes the least pair rank of each word, merges all its pairs of that rank from the left at
        once, and compacts; words without a pair left are put aside.
        """
        done = []
        while len(symbols):
            key = np.full(len(symbols), -1, np.int64)
            key[:-1] = np.where(word[:-1] == word[1:], symbols[:-1] << 22 | symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], _NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == _NONE
            if over.any():
                done.append((symbols[over], word[over]))
                go = ~over
                symbols, word, rank, least, at = symbols[go], word[go], rank[go], least[go], at[go]
                if not len(symbols):
                    break
            hit = rank == least
            # of pairs that overlap in a run, every second one from the left
            place = np.arange(len(hit))
            first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - first) % 2 == 0
            # a rank that several pieces share goes one merge at a time, as the merge may make a pair of the same rank
            if (many := hit & self.tied[np.where(hit, rank, 0)]).any():
                marked = np.flatnonzero(many)
                hit[marked[np.r_[False, word[marked[1:]] == word[marked[:-1]]]]] = False
            symbols = np.where(hit, self.made[at], symbols)
            keep = ~np.r_[False, hit[:-1]]
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, word
        symbols, word = np.concatenate([s for s, _ in done]), np.concatenate([w for _, w in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same rounds over one long word, whose symbols are linked and whose pairs are kept by rank.

        A round takes the pairs of the least rank that are still there, merges them from the left and ranks the new
        neighbours only.
        """
        symbols, n = symbols.copy(), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def pairs(at):
            key = symbols[at] << 22 | symbols[after[at]]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[k] == key, self.ranks[k], _NONE), self.made[k]

        def add(at):
            rank, _ = pairs(at)
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, part in zip(rank[starts].tolist() if len(rank) else [], np.split(at, starts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        add(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[(symbols[at] >= 0) & (after[at] < n)]
            rank, made = pairs(at) if len(at) else (at, at)
            at, made = at[rank == r], made[rank == r]
            if not len(at):
                continue
            # of pairs that overlap in a run, every second one from the left
            chained = np.r_[False, after[at[:-1]] == at[1:]]
            place = np.arange(len(at))
            first = np.maximum.accumulate(np.where(chained, 0, place))
            take = (place - first) % 2 == 0
            if self.tied[r]:
                take[1:] = False
            left, at, made = at[~take], at[take], made[take]
            gone = after[at]
            symbols[at], symbols[gone] = made, -1
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            near = np.concatenate([at[inner], before[at][before[at] >= 0]])
            if self.tied[r]:
                near = np.concatenate([near, left[symbols[left] >= 0]])
                near = near[after[near] < n]
            add(np.unique(near))
        return symbols[symbols >= 0]

    def _bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary become their UTF-8 bytes' ids."""
        raw = np.flatnonzero(symbols >= _RAW)
        if not len(raw):
            return symbols, word
        coded = [chr(c).encode() for c in (symbols[raw] - _RAW).tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[raw] = [len(x) for x in coded]
        out, word = np.repeat(symbols, sizes), np.repeat(word, sizes)
        out[out >= _RAW] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return out, word

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and where each word's ids end."""
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.chars, cps), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == cps, self.char_ids[at], cps + _RAW)
        word = np.repeat(np.arange(len(words)), sizes)
        # parts of words that no piece joins are merged like words
        pair = cps[:-1] << 21 | cps[1:]
        k = np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)
        part = np.cumsum(np.r_[0, (word[1:] != word[:-1]) | (self.inside[k] != pair)]) if len(cps) else word
        length = np.bincount(part)
        long = np.flatnonzero(length >= LONG)
        ends = np.cumsum(length)
        short = length[part] < LONG
        merged = [self._merge(symbols[short], part[short])]
        for p in long.tolist():
            got = self._merge_long(symbols[ends[p] - length[p] : ends[p]])
            merged.append((got, np.full(len(got), p, np.int64)))
        ids, part = (np.concatenate(x) for x in zip(*merged, strict=True))
        if len(long):
            order = np.argsort(part, kind="stable")
            ids, part = ids[order], part[order]
        owner = word[ends - 1]
        ids, word = self._bytes(ids, owner[part] if len(part) else part)
        return ids, np.cumsum(np.bincount(word, minlength=len(words)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; equal words are merged once, those that are known from texts before not again."""
        cut = [pieces.words(t, self.vocabulary) for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        new = list({w for ws in cut for w in ws} - self.known.keys())
        ids, ends = self.encode_words(new)
        got = dict(zip(new, np.split(ids.astype(np.int32), ends[:-1]), strict=True)) if new else {}
        self.known |= {w: x.copy() for w, x in got.items() if len(w) <= SHORT}
        find = self.known.get
        return [np.concatenate([x if (x := find(w)) is not None else got[w] for w in ws]) if ws else np.zeros(0, np.int32) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces are silent, the dummy prefix goes, a byte that is no part of UTF-8 is U+FFFD."""
        data = b"".join([self.surface[i] for i in ids.tolist()])
        first = next((i for i in ids.tolist() if i not in self.vocabulary.control), None)
        if first is not None and self.vocabulary.pieces[first].startswith(pieces.SPACE):
            data = data[1:]
        return data.decode("utf-8", "one_byte")


def encode_documents(docs: DataFrame, model_path: str, decode: bool = True, digests: bool = False) -> DataFrame:
    """Token ids of every text and what they decode to.

    Returns doc_id, n_tokens, ids (array<int>) and, with decode, decoded; with digests, ids_sha256 and decoded_sha256
    of the same ids and text instead of them, made where they are, so that they needn't travel. One row per input
    row. A null or empty text has no ids and decodes to the empty text. Null and repeated doc_ids stay as they are.
    """
    handed = docs.sparkSession.sparkContext.broadcast(pieces.load(model_path))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(handed.value)
        for b in batches:
            doc_ids, at = b.column("doc_id"), 0
            for texts in pieces.chunks(b.column("text")):
                ids = codec.encode(texts)
                columns = {"doc_id": doc_ids.slice(at, len(texts)), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
                at += len(texts)
                decoded = [codec.decode(x) for x in ids] if decode else []
                if digests:
                    columns["ids_sha256"] = pa.array([sha(",".join(map(str, x.tolist())).encode()) for x in ids], pa.string())
                    if decode:
                        columns["decoded_sha256"] = pa.array([sha(x.encode()) for x in decoded], pa.string())
                else:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                    if decode:
                        columns["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, " + (", ".join(["ids_sha256 string"] + ["decoded_sha256 string"] * decode) if digests else ", ".join(["ids array<int>"] + ["decoded string"] * decode))
    return rows.mapInArrow(run, schema)
