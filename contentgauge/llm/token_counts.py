"""Token counts: prefix dynamic programming over the byte-pair vocabulary.

For every prefix of a text the last token of the prefix's encoding is the longest vocabulary piece t that ends there
such that the encoding of what is before t ends in a token u with (u, t) compatible: merging u + t as a text of its own
gives back u, t. The count is then one more than at the prefix before t. One pass so gives the exact token count of
every prefix, from which truncation points and budgets are read without encoding again.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgauge.llm import pieces

LIMIT = 4096
#: Code points whose words are worked on together: words in order share more beginnings the more there are.
CHUNK = 3_000_000
#: Words and token pairs whose results a task remembers at once.
MEMO = 300_000


class PrefixCounter:
    def __init__(self, vocabulary: pieces.Vocabulary):
        self.vocabulary = vocabulary
        self.rank = {p.replace(pieces.SPACE, " "): r for p, r in vocabulary.rank.items()}
        # by a piece's last three characters, the lengths of the pieces that end so, longest first
        sizes: dict[str, set[int]] = {}
        for p in self.rank:
            if len(p) > 2:
                sizes.setdefault(p[-3:], {1, 2}).add(len(p))
        self.sizes = {end: sorted(of, reverse=True) for end, of in sizes.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def split(self, token: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes this one; none for a single character."""
        if len(token) == 1:
            return None
        if token not in self.halves:
            parts = list(token)
            while len(parts) > 2:
                best, at = min(((self.rank.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
                if best == 1 << 60:
                    raise ValueError(f"merges don't reach the piece {token!r}")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (parts[0], parts[1])
        return self.halves[token]

    def compatible(self, left: str, right: str) -> bool:
        """No merge goes over the border of left and right before both are complete.

        Merges inside left and right are undone from the last to the first; a merge over the border that comes
        earlier than the one just undone (or as early and further left) would have been made.
        """
        key = (left, right)
        if key in self.fits:
            return self.fits[key]
        a, b, limit, over = left, right, 1 << 60, True
        done = None
        while done is None:
            across = self.rank.get(a + b, 1 << 60)
            if across < limit or across == limit and not over:
                done = False
                break
            ra, rb = (self.rank[a] if len(a) > 1 else -1), (self.rank[b] if len(b) > 1 else -1)
            if ra < 0 and rb < 0:
                done = True
            elif ra > rb or ra == rb and rb < 0:
                # left's last merge ends at the border and lies further left: at equal rank it goes first
                a, limit, over = self.split(a)[1], ra, True
            else:
                # right's last merge lies further right: at equal rank the merge over the border goes first
                b, limit, over = self.split(b)[0], rb, False
        if len(self.fits) >= MEMO:
            self.fits.clear()
        self.fits[key] = done
        return done

    def learn(self, words: list[str]) -> None:
        """int32 token counts of each word's prefixes of 1, 2, ... characters.

        Words are taken in order, so that the state of a beginning shared with the word before is kept.
        """
        rank, sizes, compatible, known, short = self.rank, self.sizes, self.compatible, self.fits.get, (2, 1)
        before, last, count = "", [""], [0]
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for size in sizes.get(word[end - 3 : end], short) if end > 2 else short:
                    start = end - size
                    if start < 0:
                        continue
                    token = word[start:end]
                    if size > 1 and token not in rank:
                        continue
                    if start:
                        left = last[start]
                        if (fits := known((left, token))) is None:
                            fits = compatible(left, token)
                        if not fits:
                            continue
                    last.append(token)
                    count.append(count[start] + (len(token.encode()) if size == 1 and token not in rank else 1))
                    break
            before = word
            self.known[word] = array("i", count[1:]).tobytes()

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token counts of the prefixes of 0, 1, ... code points of each text, int64.

        The dummy prefix belongs to the first character; the empty text has no tokens.
        """
        cut = [pieces.words(t, self.vocabulary) for t in texts]
        new = {w for ws in cut for w in ws} - self.known.keys()
        if len(self.known) + len(new) > MEMO:
            # words met since the last change are kept for another term, others go
            self.before, self.known = self.known, {}
            new = {w for ws in cut for w in ws}
        again = new & self.before.keys()
        for w in again:
            self.known[w] = self.before.pop(w)
        self.learn(list(new - again))
        return [self._joined(ws) for ws in cut]

    def _joined(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(1, np.int64)
        got = list(map(self.known.__getitem__, words))
        flat = np.frombuffer(b"".join(got), np.int32).astype(np.int64)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ends = np.cumsum(sizes)
        flat += np.repeat(np.concatenate([[0], np.cumsum(flat[ends - 1])[:-1]]), sizes)
        flat[0] = 0  # the dummy prefix alone is the empty text
        return flat


def pack(counts: np.ndarray) -> bytes:
    """Prefix counts as compressed steps."""
    return zlib.compress(np.diff(counts).astype(np.int16).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(data), np.int16), dtype=np.int64)])


def tokens_in(data: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars code points, from packed prefix counts."""
    return int(unpack(data)[n_chars])


def longest_prefix(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most limit tokens."""
    return int(np.flatnonzero(counts <= limit)[-1])


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, keep_prefixes: bool = False) -> DataFrame:
    """Exact token counts of every text.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), fit_chars (code points of the longest
    prefix of at most limit tokens) and, with keep_prefixes, prefix_counts (packed counts of every prefix); one row
    per input row. A null text counts as empty: 0 bytes, 0 tokens. Null and repeated doc_ids stay as they are.
    """
    handed = docs.sparkSession.sparkContext.broadcast(pieces.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(handed.value)
        for b in batches:
            n_bytes, n_tokens, fit, packed = [], [], [], []
            for texts in pieces.chunks(b.column("text"), CHUNK):
                for text, counts in zip(texts, counter.texts(texts), strict=True):
                    n_bytes.append(len((text or "").encode()))
                    n_tokens.append(int(counts[-1]))
                    fit.append(longest_prefix(counts, limit))
                    packed.append(pack(counts) if keep_prefixes else None)
            columns = [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fit, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "fit_chars"]
            if keep_prefixes:
                columns, names = [*columns, pa.array(packed, pa.binary())], [*names, "prefix_counts"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, fit_chars bigint" + ", prefix_counts binary" * keep_prefixes
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
