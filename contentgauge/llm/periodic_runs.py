"""Periodic runs of words: suffix-tree longest common extensions of Lyndon roots.

A run is a stretch of words that repeats its first q words, as far as it goes both ways. Every run holds a Lyndon root:
the longest Lyndon word that starts at some position, under one of the two orders of the words. Longest Lyndon words end
where the next smaller suffix starts, so the ranks of suffixes give them; each is carried on to both sides by longest
common extensions, which are string depths of lowest common ancestors in the Ukkonen trees of the words and of their
reversal, looked up in constant time on Euler tours.

Before trees are built, whole documents are reduced to the stretches that can hold a run: in a run of at least 24 words
and three periods every window of eight words occurs again within a third of the stretch, and the windows of many
documents are compared at once. The reduction drops no run, as equal windows have equal hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a window of the reduction; a run of LEAST_WORDS and LEAST_PERIODS has a stretch of recurring windows.
WINDOW = 8
#: Words of documents that are reduced together; a longer document is reduced alone.
CHUNK = 400_000
#: Tour entries whose minima are kept together.
BLOCK = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Tour:
    """Minimum of string depths between two places of an Euler tour: a sparse table over blocks, prefix and suffix minima in them."""

    def __init__(self, depths: np.ndarray):
        n = -(-len(depths) // BLOCK)
        rows = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        rows[: len(depths)] = depths
        self.flat, rows = rows, rows.reshape(n, BLOCK)
        self.before = np.minimum.accumulate(rows, axis=1).ravel()
        self.after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 2 << (len(self.table) - 1) <= n:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.after[low], self.before[high])
        between = last - first - 1
        for level in range(len(self.table)):
            at = np.flatnonzero((between >= 1 << level) & (between < 2 << level))
            if len(at):
                table = self.table[level]
                out[at] = np.minimum(out[at], np.minimum(table[first[at] + 1], table[last[at] - (1 << level)]))
        at = np.flatnonzero(first == last)
        if len(at):
            low, high = low[at], high[at]
            found = self.flat[low]
            for step in range(1, int((high - low).max()) + 1):
                found = np.minimum(found, self.flat[np.minimum(low + step, high)])
            out[at] = found
        return out


class SuffixTree:
    """Ukkonen's tree of a list of symbols from 1 up, closed by the sentinel 0, with the Euler tour of its leaves in order."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        child, width, depth, leaf_of = self._grow([*symbols, 0])
        self._walk(child, width, depth, leaf_of)

    @staticmethod
    def _grow(s: list[int]) -> tuple[dict[int, int], int, list[int], list[int]]:
        """Edges by node * width + first symbol, and by node the string depth and the suffix of leaves (else -1)."""
        width, n = max(s) + 1, len(s)
        child: dict[int, int] = {}
        get = child.get
        start, end, link, depth, leaf_of = [0], [0], [0], [0], [-1]
        node, edge, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(s):
            unlinked = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = get(key)
                if below is None:
                    child[key] = len(start)
                    parent = node
                else:
                    first = start[below]
                    size = end[below] - first
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    met = s[first + length]
                    if met == c:
                        if unlinked:
                            link[unlinked] = node
                        length += 1
                        break
                    parent = child[key] = len(start)
                    start.append(first)
                    end.append(first + length)
                    link.append(0)
                    depth.append(waiting - 1)
                    leaf_of.append(-1)
                    start[below] = first + length
                    child[parent * width + met] = below
                    child[parent * width + c] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                depth.append(n - i + waiting - 1)
                leaf_of.append(i - waiting + 1)
                if unlinked:
                    link[unlinked] = parent
                unlinked = parent if below is not None else 0
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return child, width, depth, leaf_of

    def _walk(self, child: dict[int, int], width: int, depth: list[int], leaf_of: list[int]) -> None:
        """The depths met on a walk around the tree, children by symbol; where each suffix's leaf is on it, and its rank."""
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        nodes = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        from_ = np.searchsorted(keys[order], np.arange(len(depth) + 1) * width).tolist()
        tour, place, suffixes, stack = [], [0] * (self.n + 1), [], [0]
        while stack:
            x = stack.pop()
            if x < 0:  # back in the parent
                tour.append(depth[~x])
                continue
            if (suffix := leaf_of[x]) >= 0:
                place[suffix] = len(tour)
                suffixes.append(suffix)
            else:
                for k in range(from_[x + 1] - 1, from_[x], -1):
                    stack.append(nodes[k])
                    stack.append(~x)
                stack.append(nodes[from_[x]])
            tour.append(depth[x])
        self.tour, self.place = Tour(np.array(tour, np.int32)), np.array(place, np.int64)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[suffixes] = np.arange(self.n + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the different suffixes a and b have in common at their starts; position n is the empty suffix."""
        return self.tour.least(self.place[a], self.place[b]).astype(np.int64)


def lyndon_ends(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position, where the longest Lyndon word from there ends, under the order and under its reverse (-1: at no smaller suffix)."""
    ranks, n = rank.tolist(), len(rank) - 1
    ends = []
    for sign in (1, -1):
        out, open_ = [-1] * n, []
        for i, r in enumerate(ranks):
            r *= sign
            while open_ and ranks[open_[-1]] * sign > r:
                out[open_.pop()] = i
            open_.append(i)
        ends.append(np.array(out, np.int64))
    # the sentinel is least in the order and greatest in the reverse, so it ends words of the first only
    return ends[0], ends[1]


def find_in(symbols: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows start, length, period of all runs with at least so many words and periods (two or more), by start and period."""
    n = len(symbols)
    if n < max(least_words, least_periods):
        return np.zeros((0, 3), np.int64)
    there, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    at = np.arange(n)
    found = []
    for ends in lyndon_ends(there.rank):
        start = at[(ends >= 0) & ((ends - at) * least_periods <= n)]
        end = ends[start]
        right = there.common(start, end)
        left = back.common(n - start, n - end)
        first, period = start - left, end - start
        length = end + right - first
        keep = (length >= least_periods * period) & (length >= least_words)
        found.append(np.column_stack([first, period, length])[keep])
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def _stretches(flags: np.ndarray, least: int) -> np.ndarray:
    """Rows from, to (exclusive) of the stretches of true flags that have at least so many."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    pairs = edges.reshape(-1, 2)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


def recurring(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows from, to of the stretches of words, within one document each, that alone can hold runs.

    hashes has the words of documents of the given sizes one after another. A window stays if an equal one of its
    document is no further than a third of its stretch of such windows, until nothing more goes.
    """
    n = len(hashes)
    if n < LEAST_WORDS:
        return np.zeros((0, 2), np.int64)
    with np.errstate(over="ignore"):
        grams, width, power = hashes.view(np.uint64) * _MIX, 1, _MIX
        grams ^= grams >> np.uint64(29)
        while width < WINDOW:
            grams = grams[:-width] * power + grams[width:]
            width, power = 2 * width, power * power
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inside = doc[: len(grams)] == doc[WINDOW - 1 :]
        grams = (grams ^ (grams >> np.uint64(31))) * _MIX + doc[: len(grams)].astype(np.uint64)
    at = np.flatnonzero(inside)
    order = at[np.argsort(grams[at], kind="stable")]
    same = grams[order[1:]] == grams[order[:-1]]
    gap = np.where(same, order[1:] - order[:-1], n)
    away = np.full(len(grams), n, np.int64)
    away[order[1:]] = gap
    away[order[:-1]] = np.minimum(away[order[:-1]], gap)
    least = LEAST_WORDS - WINDOW + 1
    flags = inside & (away < n)
    # windows of different documents lie WINDOW - 1 places apart, so no stretch of flags goes over a border
    while True:
        pairs = _stretches(flags, least)
        reach = np.zeros(len(flags) + 1, np.int64)
        third = (pairs[:, 1] - pairs[:, 0] + WINDOW - 1) // LEAST_PERIODS
        np.add.at(reach, pairs[:, 0], third)
        np.add.at(reach, pairs[:, 1], -third)
        left = flags & (away <= np.cumsum(reach)[:-1])
        if left.sum() == flags.sum():
            return pairs + np.array([0, WINDOW - 1])
        flags = left


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Rows start, length, period of every text's runs, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[np.ndarray]] = [[] for _ in texts]
    stretches = recurring(hashes, sizes)
    for doc, (a, b) in zip(np.searchsorted(starts, stretches[:, 0], "right") - 1, stretches.tolist(), strict=True):
        a, b = a - int(starts[doc]), b - int(starts[doc])
        known: dict[bytes, int] = {}
        found = find_in([known.setdefault(w, len(known) + 1) for w in texts[doc][a:b]])
        out[doc].append(found + np.array([a, 0, 0]))
    return [np.concatenate(x) if x else np.zeros((0, 3), np.int64) for x in out]


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()])


FIELDS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint"


def find_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, digests: bool = False) -> DataFrame:
    """The periodic runs of words of every whole text; one row per input row.

    Words are runs of characters other than ASCII white space. Returns doc_id, n_runs, start, length, period and
    exponent_milli of the run with the greatest length / period (null without a run), and runs (all of them, by start,
    then period) and collapsed_text (every run cut to its first period, words joined by one space); with digests, in
    place of the last two, runs_sha256 and collapsed_sha256. rewrite changes a document's words first.
    A null or empty text has no words and no runs. Null and repeated doc_ids stay as they are; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, ids, n_words = [], [], 0
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                held.append(rewrite(doc_id.as_py(), words) if rewrite else words)
                ids.append(doc_id.as_py())
                n_words += len(words)
                if n_words >= CHUNK:
                    yield _rows(ids, held, digests)
                    held, ids, n_words = [], [], 0
            if ids:
                yield _rows(ids, held, digests)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    more = "runs_sha256 string, collapsed_sha256 string" if digests else "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string"
    return rows.mapInArrow(run, f"{FIELDS}, {more}")


def _rows(ids: list[int | None], texts: list[list[bytes]], digests: bool) -> pa.RecordBatch:
    runs, longs = runs_of(texts), pa.int64()
    best = [greatest(r) for r in runs]
    columns = [pa.array(ids, longs), pa.array([len(r) for r in runs], longs), *(pa.array([x and x[k] for x in best], longs) for k in range(3)), pa.array([x and 1000 * x[1] // x[2] for x in best], longs)]
    kept = [collapsed(words, r) for words, r in zip(texts, runs, strict=True)]
    if digests:
        listed = ["".join(f"{s},{n},{p}\n" for s, n, p in r.tolist()).encode() for r in runs]
        columns += [pa.array([hashlib.sha256(x).hexdigest() for x in part]) for part in (listed, kept)]
        names = ["runs_sha256", "collapsed_sha256"]
    else:
        kind = pa.list_(pa.struct([("start", longs), ("length", longs), ("period", longs)]))
        columns += [pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in runs], kind), pa.array([x.decode() for x in kept], pa.string())]
        names = ["runs", "collapsed_text"]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", *names])
