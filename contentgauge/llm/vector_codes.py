"""Vector codes: Lloyd's rounds over cover trees, one codebook for each part of the vectors.

Components become integers, vectors are cut into equal parts, and each part is coded by the nearest entry of its
codebook. Each block of a partition's vectors gets one cover tree per part, built once and written out: a node stands
for the points of a ball, which lie next to each other, so cumulative sums over them give a node's count and sum at
once. In a round a node whose ball lies nearer to one entry than to all others by the triangle inequality goes to it
whole; only the others hand their remaining entries down, and leaves that stay ambiguous compare exactly. Tasks return
sums for each entry, so nothing but the bounded codebooks passes through the driver, and integers keep sums exact in
any order. Distances that decide are squares of integers; the roots in the triangle inequality have a margin.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentgauge.llm.common import join_hot, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block, which has trees of its own; points of a node that is not divided further.
BLOCK, LEAF = 4096, 16
#: What rounding can change in a sum of distances.
MARGIN = 1 + 1e-9


class Tree:
    """A cover tree over the rows of points: order has the rows so that a node's are from start to end, children follow their parents.

    A node's ball is around center, one of its points; every child's center is further than half the parent's radius
    from the centers chosen before it, and its points are those within that distance of no earlier one.
    """

    FIELDS = ("order", "start", "end", "center", "radius", "first", "n_children")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n = len(points)
        order = np.arange(n)
        start, end, center, radius, first, n_children = [0], [n], [0], [0.0], [0], [0]
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            rows = order[a:b].copy()
            away = ((points[rows] - points[center[at]]) ** 2).sum(axis=1)
            reach = int(away.max()) if len(away) else 0
            radius[at] = float(np.sqrt(reach)) * MARGIN
            if b - a > LEAF and reach:
                first[at], place, left = len(start), a, rows
                while len(left):
                    near = away * 4 <= reach
                    took = left[near]
                    order[place : place + len(took)] = took
                    start.append(place)
                    end.append(place + len(took))
                    center.append(int(took[0]) if n_children[at] else center[at])
                    radius.append(0.0)
                    first.append(0)
                    n_children.append(0)
                    n_children[at] += 1
                    place += len(took)
                    left = left[~near]
                    if len(left):
                        away = ((points[left] - points[left[0]]) ** 2).sum(axis=1)
            at += 1
        longs = {"order": order, "start": start, "end": end, "center": center, "first": first, "n_children": n_children}
        return cls(radius=np.array(radius), **{k: np.array(v, np.int32) for k, v in longs.items()})

    def assign(self, points: np.ndarray, entries: np.ndarray, tell) -> None:
        """Calls tell(nodes' starts, ends, entries) for the nodes that go whole and tell(rows, rows' entries) for single points."""
        if not len(points):
            return
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        while len(nodes):
            away = ((points[self.center[nodes]][:, None, :] - entries[None]) ** 2).sum(axis=2)
            root, ball = np.sqrt(away), self.radius[nodes][:, None]
            root[~open_] = np.inf
            low, high = root / MARGIN - ball, (root * MARGIN + ball).min(axis=1, keepdims=True)
            open_ &= low <= high
            whole = open_.sum(axis=1) == 1
            tell(self.start[nodes[whole]], self.end[nodes[whole]], open_[whole].argmax(axis=1))
            leaf = ~whole & (self.n_children[nodes] == 0)
            for size in np.unique(self.end[nodes[leaf]] - self.start[nodes[leaf]]):
                some = nodes[leaf & (self.end[nodes] - self.start[nodes] == size)]
                places = (self.start[some][:, None] + np.arange(size)).ravel()
                for k in range(0, len(places), BLOCK):
                    rows = self.order[places[k : k + BLOCK]]
                    exact = ((points[rows][:, None, :] - entries[None]) ** 2).sum(axis=2)
                    tell(places[k : k + BLOCK], None, exact.argmin(axis=1))
            down = ~whole & ~leaf
            sizes = self.n_children[nodes[down]]
            base = np.repeat(self.first[nodes[down]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) if len(sizes) else np.zeros(0, np.int64)
            nodes, open_ = base + np.arange(int(sizes.sum())), np.repeat(open_[down], sizes, axis=0)

    def sums(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the number and the sum of the points nearest to it."""
        counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[self.order], axis=0)])

        def tell(start, end, to):
            end = start + 1 if end is None else end
            np.add.at(counts, to, end - start)
            np.add.at(sums, to, running[end] - running[start])

        self.assign(points, entries, tell)
        return counts, sums

    def codes(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of every point, the first of equals."""
        out = np.zeros(len(points), np.int64)

        def tell(start, end, to):
            if end is None:
                out[self.order[start]] = to
            else:
                sizes = end - start
                out[self.order[np.repeat(start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] if len(sizes) else []] = np.repeat(to, sizes)

        self.assign(points, entries, tell)
        return out

    def pack(self) -> bytes:
        data = io.BytesIO()
        np.savez(data, **{k: getattr(self, k) for k in self.FIELDS})
        return data.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as found:
            return cls(**{k: found[k].astype(np.int64) if k != "radius" else found[k] for k in cls.FIELDS})


def kept_vectors(rows: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """vec_id, label and q, the integer components floor(scale * x), of the usable vectors, and their length; native.

    Dropped are vectors that are null or hold null or non-finite components, those of another length than the vector of
    the smallest vec_id, and those with components so large that an error could not fit a long (|x| of 46,000 at 64
    components).
    """
    fine = F.coalesce(F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))  # NaN is above infinity
    found = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).where(fine & (F.size("e") > 0))
    first = found.orderBy(F.asc_nulls_last("vec_id"), "e").first()
    size = len(first.e) if first else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    largest = float(math.isqrt((1 << 63) // size) // 2 - 1)
    within = (F.size("e") == size) & F.forall("e", lambda x: F.abs(x) * F.lit(float(scale)) < F.lit(largest))
    return found.where(within).select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("q")), size


def plant_trees(kept: DataFrame, size: int, parts: int = PARTS) -> DataFrame:
    """Written blocks of up to BLOCK vectors of a partition: vec_ids, labels, q (int32, row by row) and one packed tree for each part."""
    ids, labels, width = kept.schema["vec_id"].dataType, kept.schema["label"].dataType, size // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                b = batch.slice(k, BLOCK)
                q = b.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(b.num_rows, size)
                trees = [Tree.build(q[:, j : j + width].astype(np.int64)).pack() for j in range(0, size, width)]
                ends = pa.array([0, b.num_rows], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.concat_arrays([b.column(c)])) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([q.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], names=["vec_ids", "labels", "q", "trees"])

    schema = T.StructType().add("vec_ids", T.ArrayType(ids)).add("labels", T.ArrayType(labels)).add("q", T.BinaryType()).add("trees", T.ArrayType(T.BinaryType()))
    return materialize(kept.mapInArrow(run, schema))


def _parts_of(q: bytes, book: np.ndarray) -> list[np.ndarray]:
    parts, _, width = book.shape
    rows = np.frombuffer(q, np.int32).reshape(-1, parts * width).astype(np.int64)
    return [rows[:, j * width : (j + 1) * width] for j in range(parts)]


def next_book(blocks: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round. Each task sends one row for each component of an entry, so at most book.size come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
        for b in batches:
            for q, trees in zip(b.column("q"), b.column("trees"), strict=True):
                for j, (points, tree) in enumerate(zip(_parts_of(q.as_py(), book), trees, strict=True)):
                    n, total = Tree.unpack(tree.as_py()).sums(points, book[j])
                    counts[j] += n
                    sums[j] += total
        at = np.argwhere(counts > 0)
        part, entry = np.repeat(at, book.shape[2], axis=0).T
        place = np.tile(np.arange(book.shape[2]), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, entry, place, counts[part, entry], sums[part, entry, place])], names=["part", "entry", "place", "n", "total"])

    found = blocks.select("q", "trees").mapInArrow(run, "part bigint, entry bigint, place bigint, n bigint, total bigint")
    found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = book.copy()
    for r in found.collect():
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def learn_book(blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from the given codebooks (part, entry, component); entries that no part is nearest to stay."""
    book = first
    for _ in range(rounds):
        book = next_book(blocks, book)
    return book


def book_sha256(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def assign_codes(blocks: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of every vector of the blocks."""
    ids, labels = (blocks.schema[c].dataType.elementType for c in ("vec_ids", "labels"))
    hexes = [f"{k:02x}" for k in range(256)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                codes, error = [], 0
                for j, (points, tree) in enumerate(zip(_parts_of(b.column("q")[k].as_py(), book), b.column("trees")[k], strict=True)):
                    codes.append(Tree.unpack(tree.as_py()).codes(points, book[j]))
                    error = error + ((points - book[j][codes[-1]]) ** 2).sum(axis=1)
                text = ["".join([hexes[c] for c in row]) for row in np.column_stack(codes).tolist()]
                yield pa.RecordBatch.from_arrays([b.column("vec_ids")[k].values, b.column("labels")[k].values, pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, T.StructType().add("vec_id", ids).add("label", labels).add("code", T.StringType()).add("error", T.LongType()))


def encode_vectors(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors of rows(vec_id, embedding, label) and the codebooks that decode them.

    Codebooks start as the parts of the vectors with the smallest vec_ids (of equal ids the smaller vector first, null
    ids last); with fewer vectors than entries they are smaller. Ties go to the lower index. Repeated rows stay; an
    empty table, or one without a usable vector, gives no rows. Up to 256 entries.
    """
    kept, size = kept_vectors(rows, parts, scale)
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()
    first = np.array([r.q for r in start], np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    blocks = plant_trees(kept, size, parts)
    book = learn_book(blocks, first, rounds if start else 0)
    return assign_codes(blocks, book), book


def digest(codes: DataFrame, book: np.ndarray) -> DataFrame:
    """The codes with label_error, the error of all vectors of the same label (null is one of them), and the codebooks' hash."""
    codes = materialize(codes.withColumn("_label", F.to_json(F.struct("label"))))
    totals = materialize(codes.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("held")))
    return join_hot(codes, totals, "_label").select("vec_id", "label", "code", "error", "label_error", F.lit(book_sha256(book)).alias("codebooks_sha256"))


def decode(code: str, book: np.ndarray) -> np.ndarray:
    """The integer components that a code stands for."""
    return np.concatenate([book[j][int(code[2 * j : 2 * j + 2], 16)] for j in range(len(book))])
