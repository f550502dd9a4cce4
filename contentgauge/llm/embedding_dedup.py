"""Embedding near-dedup: lattice hashing with E8.

Several tables of random projections to eight dimensions; a vector's cell is its nearest point of the lattice E8.
Vectors are filed under their own cell and under the neighbouring cells that are nearest to them; vectors that meet
in a cell are compared by cosine in double precision. A pair is counted in one cell only, and a cell gives counts
and a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgauge.llm.common import HOT_KEYS, join_hot, join_ids, materialize
from contentgauge.llm.components import connected_components

COSINE = 0.98
#: Tables, neighbouring cells probed in each, and the lattice's scale against projections of unit vectors.
TABLES, PROBES, SCALE, SEED = 3, 2, 0.45, 8
#: Vectors of a cell that are compared in one task step; a larger cell is dealt out in pairs of blocks.
BLOCK = 2048
#: Rows of a cell that are compared with the others at once.
STRIP = 64


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def nearest(points: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: the better of the nearest points of D8 and of D8 + 1/2."""

    def even(x):
        whole = np.rint(x)
        off = x - whole
        odd = np.flatnonzero(whole.sum(axis=1) % 2 != 0)
        worst = np.abs(off[odd]).argmax(axis=1)
        whole[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return whole

    a, b = even(points), even(points - 0.5) + 0.5
    return np.where((((points - a) ** 2).sum(axis=1) <= ((points - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(vectors: np.ndarray) -> np.ndarray:
    """Cell numbers of unit vectors, by vector, table and probe (0: the own cell)."""
    shortest, out = minimal_vectors(), np.empty((len(vectors), TABLES, 1 + PROBES), np.int64)
    mix = np.random.default_rng(SEED).integers(1 << 62, size=8, dtype=np.int64) | 1
    number = lambda lattice: ((2 * lattice).astype(np.int64) * mix).sum(axis=-1)
    for t in range(TABLES):
        plane = np.random.default_rng((SEED, vectors.shape[1], t)).standard_normal((vectors.shape[1], 8))
        y = vectors @ plane * SCALE
        own = nearest(y)
        close = np.argpartition(-((y - own) @ shortest.T), PROBES, axis=1)[:, :PROBES]
        out[:, t, 0] = number(own)
        out[:, t, 1:] = number(own[:, None, :] + shortest[close])
    return out


def unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small numbers stay in range
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = batch.column("embedding").value_lengths().to_numpy()
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n))


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and cell it is filed under."""
    for batch in batches:
        for b in _by_size(batch):
            if not len(b):
                continue
            own = cells(unit(b.column("embedding")))
            n, each = len(b), TABLES * (1 + PROBES)
            take = pa.array(np.repeat(np.arange(n), each))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own.reshape(-1)), pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n)),
                    *[b.column(c).take(take) for c in ("label", "cid", "n", "embedding")], pa.array(list(np.repeat(own.reshape(n, -1), each, axis=0)), pa.list_(pa.int64())),
                ],
                names=["cell", "table", "label", "cid", "n", "embedding", "own"],
            )


def _meet(group: dict[str, np.ndarray], table: int, cell: int, crossed: bool) -> tuple[list, list]:
    """Counts of links by vector and a spanning forest, for the pairs of one cell (or two blocks of it) that are counted here.

    The pairs are worked through in strips of STRIP rows, so that memory follows the cell's size and not its pairs.
    """
    vectors, own, cid, n, block = group["vectors"], group["own"], group["cid"], group["n"], group["block"]
    counts, component, forest = np.zeros(len(cid)), np.arange(len(cid)), []
    for at in range(0, len(cid), STRIP):
        similar = vectors[at : at + STRIP] @ vectors[at:].T >= COSINE
        similar &= np.arange(similar.shape[1]) > np.arange(similar.shape[0])[:, None]
        if crossed:
            similar &= block[at : at + STRIP, None] != block[at:]
        a, b = np.nonzero(similar)
        if not len(a):
            continue
        a, b = a + at, b + at
        # cells in which the two meet, table by table: the own cell of the one, if the other is filed there
        at_a = (own[b] == own[a][:, :, :1]).any(axis=2)
        at_b = (own[a] == own[b][:, :, :1]).any(axis=2)
        first = (at_a | at_b).argmax(axis=1)
        rows = np.arange(len(a))
        ca, cb = own[a, first, 0], own[b, first, 0]
        where = np.where(at_a[rows, first] & at_b[rows, first], np.minimum(ca, cb), np.where(at_a[rows, first], ca, cb))
        here = (at_a | at_b).any(axis=1) & (first == table) & (where == cell)
        a, b = a[here], b[here]
        if not len(a):
            continue
        counts += np.bincount(a, n[b], len(cid)) + np.bincount(b, n[a], len(cid))
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        for s, e in zip(starts, [*starts[1:], len(a)], strict=True):
            x, found = a[s], b[s:e]
            new, place = np.unique(component[found], return_index=True)
            joined = new != component[x]
            forest += [(x, y) for y in found[place[joined]].tolist()]
            component[np.isin(component, new[joined])] = component[x]
    linked = np.flatnonzero(counts)
    return [(int(cid[x]), None, int(counts[x])) for x in linked], [(int(cid[x]), int(cid[y]), None) for x, y in forest]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group is compared when its last row has come."""
    key = ["label", "size", "table", "cell", "left", "right"]

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        _, first = np.unique(t.column("cid").to_numpy(), return_index=True)  # two probes may share a number
        t = t.take(pa.array(first))
        if len(t) < 2:
            return
        own = t.column("own").flatten().to_numpy().reshape(len(t), TABLES, 1 + PROBES)
        group = {"vectors": unit(t.column("embedding")), "own": own} | {c: t.column(c).to_numpy() for c in ("cid", "n", "block")}
        table, cell = t.column("table")[0].as_py(), t.column("cell")[0].as_py()
        counts, forest = _meet(group, table, cell, t.column("left")[0].as_py() != t.column("right")[0].as_py())
        if counts:
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b, "n": n} for a, b, n in counts + forest], schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    last, parts = None, []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in key])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            now = tuple(keys[:, s].tolist())
            if now != last:
                if parts and sum(map(len, parts)) > 1:
                    yield from done(parts)
                last, parts = now, []
            parts.append(batch.slice(s, e - s))
    if parts and sum(map(len, parts)) > 1:
        yield from done(parts)


def link_vectors(embeddings: DataFrame) -> DataFrame:
    """Near-duplicates among vectors of equal label.

    Returns vec_id, n_links (other rows whose vector has a cosine of at least COSINE), component_id (the smallest
    vec_id reachable by links, itself included), kept (vec_id = component_id); one row per input row. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing, nor
    do vectors of different lengths. Equal vectors are one class and are compared once; repeated rows count as
    vectors of their own. A null vec_id counts as a link of others but is no component's id unless alone.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fit = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(fit, F.col("embedding")))
    usable = rows.filter("embedding is not null")
    classes = materialize(usable.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn("cid", F.monotonically_increasing_id()))
    links = _links(classes)
    counts = links.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = connected_components(links.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    known = classes.join(roots.hint("shuffle_hash"), "cid", "left").join(counts.hint("shuffle_hash"), "cid", "left")
    known = materialize(known.select("label", "embedding", "n", "first", F.coalesce("root", "cid").alias("root"), F.coalesce("others", F.lit(0)).alias("others")))
    least = materialize(known.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("held")))
    known = materialize(join_hot(known, least, "root").select("label", "embedding", F.col("n").alias("copies"), "others", "component"))
    # vectors with so many copies that there are few of them are broadcast
    common = F.col("copies") * HOT_KEYS >= (known.agg(F.sum("copies")).first()[0] or 0)
    hot, rest = F.broadcast(known.filter(common)), known.filter(~common)
    key = ["label", "embedding"]
    found = usable.join(hot, key).unionByName(usable.join(hot.select(*key), key, "left_anti").join(rest.hint("shuffle_hash"), key))
    found = found.select("vec_id", (F.col("copies") - 1 + F.col("others")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    alone = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame) -> DataFrame:
    """Link counts (a, n; b null) and a spanning forest (a, b; n null) of classes(label, embedding, n, cid)."""
    kind = classes.schema["embedding"].dataType.simpleString()
    schema = f"cell bigint, table int, label bigint, cid bigint, n bigint, embedding {kind}, own array<bigint>"
    filed = classes.select("label", "embedding", "n", "cid").mapInArrow(_file, schema).withColumn("size", F.size("embedding"))
    key = ["label", "size", "table", "cell"]
    large = materialize(filed.groupBy(*key).count().filter(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = join_ids(filed, large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("blocks", "other")
    group = [*key, "left", "right"]
    return materialize(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare, "a bigint, b bigint, n bigint"))
