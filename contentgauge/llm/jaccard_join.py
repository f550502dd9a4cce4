"""N-gram Jaccard join: prefix filtering under several global token orders.

A document is its set of word shingles. Sets that are equal are one class, and a class is joined once. Under any one
order of all shingles, two sets of Jaccard similarity of at least THRESHOLD share a shingle among the first
n - ceil(THRESHOLD * n) + 1 of each. Classes meet where they share such a prefix shingle under the first order, and
must also share one under each further order, fit in size, and pass a lower bound of their difference by parity
sketches; what is left is verified on the whole sets. All orders put frequent shingles last, by counts over all rows.
Links are asked for only as far as they connect: pairs already connected are not verified again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentgauge.llm.common import join_hot, join_ids, materialize
from contentgauge.llm.components import connected_components
from contentgauge.llm.substring_dedup import _BASES, _mix, _Rolling

SHINGLE = 5
#: Similarity of at least PART / WHOLE.
PART, WHOLE = 4, 5
#: Orders whose prefixes are intersected with those of the first.
FURTHER_ORDERS = 2
#: Shingles that every order puts last, the most frequent first out; a bound of a broadcast, not of what is joined.
MOST_FREQUENT = 500_000
#: Rows that hold a shingle in one batch before its count is reported.
REPORTED = 4
#: Classes that meet in one task step; a larger group first meets LEADERS of it, and then in pairs of blocks.
BLOCK, LEADERS = 1024, 16
#: Pairs for each class of a group that are all given on; of more, a spanning forest.
DENSE, FOREST_ROUNDS = 4, 3


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of A-Z lower-cased words; of fewer words the whole sequence; uint64."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    rolling = _Rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n), _BASES[0])
    size = min(n, SHINGLE)
    at = np.arange(n - size + 1)
    return np.unique(rolling.of(at, at + size))


def node_of(own: np.ndarray) -> int:
    """The class of a set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def prefix_size(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


def most_apart(n: int, m: int) -> int:
    """Elements that two linked sets of sizes n and m can have on their own, together."""
    return n + m - 2 * -(-PART * (n + m) // (PART + WHOLE))


class Orders:
    """Global orders: by frequency, then by a hash of the order's own."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray]):
        self.tokens, self.counts = frequent

    def prefixes(self, own: np.ndarray, orders: range) -> list[np.ndarray]:
        count = np.zeros(len(own), np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
            count = np.where(self.tokens[at] == own, self.counts[at], 0)
        return [own[np.lexsort((_mix(own + np.uint64(k)), count))[: prefix_size(len(own))]] for k in orders]


def sketch(own: np.ndarray) -> bytes:
    """Parities of the shingles in at least two bits for each."""
    bits = 1 << max(6, (2 * len(own) - 1).bit_length())
    parity = np.bincount(((own >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def apart(a: tuple[int, int], b: tuple[int, int]) -> int:
    """A lower bound of the size of the difference of two sets, from sketches (bits, number)."""
    (m, x), (n, y) = a, b
    while m != n:  # the longer one is folded
        if m > n:
            m >>= 1
            x = (x >> m) ^ (x & ((1 << m) - 1))
        else:
            n >>= 1
            y = (y >> n) ^ (y & ((1 << n) - 1))
    return (x ^ y).bit_count()


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and set size of each row (number null), and shingles (node null) with the rows of a batch that hold them."""
    for b in batches:
        nodes, sizes, tokens = [], [], []
        for text in b.column("text").to_pylist():
            own = shingles(text)
            nodes.append(node_of(own) if len(own) else None)
            sizes.append(len(own))
            tokens.append(own)
        token, count = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        token, count = token[count >= REPORTED], count[count >= REPORTED]
        names = ["doc_id", "node", "n", "token"]
        kinds = [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes, kinds[1]), pa.array(sizes, kinds[2]), pa.nulls(len(nodes), kinds[3])], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(token), kinds[0]), pa.nulls(len(token), kinds[1]), pa.array(count, kinds[2]), pa.array(token.view(np.int64), kinds[3])], names=names)


def _prefix_rows(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(frequent.value)
        for b in batches:
            nodes, n, parts = [], [], [np.zeros(0, np.uint64)]
            for text in b.column("text").to_pylist():
                own = shingles(text)
                if len(own):
                    nodes.append(node_of(own))
                    n.append(len(own))
                    parts += orders.prefixes(own, range(1))
            sizes = [len(p) for p in parts[1:]]
            each = lambda values, kind: pa.array(np.repeat(np.array(values, kind), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), each(nodes, np.int64), each(n, np.int32)], names=["token", "node", "n"])

    return run


def _records(frequent):
    """What classes are filtered by: size, sketch, and 16 bits of each prefix shingle under the further orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(frequent.value)
        for b in batches:
            columns: list[list] = [[] for _ in range(3 + FURTHER_ORDERS)]
            for text in b.column("text").to_pylist():
                own = shingles(text)
                row = [node_of(own), len(own), sketch(own)] if len(own) else [None, 0, b""]
                further = orders.prefixes(own, range(1, 1 + FURTHER_ORDERS)) if len(own) else [own] * FURTHER_ORDERS
                row += [np.unique((p >> np.uint64(7)).astype(np.uint16)).tobytes() for p in further]
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64()] + [pa.binary()] * (1 + FURTHER_ORDERS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "sketch", *_FURTHER])

    return run


_FURTHER = [f"order{k}" for k in range(1, 1 + FURTHER_ORDERS)]
_RECORD = "node bigint, n bigint, sketch binary, " + ", ".join(f"{c} binary" for c in _FURTHER)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [x for x in map(shingles, b.column("text").to_pylist()) if len(x)]
        yield pa.RecordBatch.from_arrays([pa.array(list(map(node_of, own)), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "own"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("own").to_pylist(), b.column("other").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep.append(WHOLE * same >= PART * (len(x) + len(y) - same))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _candidates(rows: list[dict], crossed: bool, everything: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of a group that pass all filters and are not connected; whether these are all such pairs."""
    further = [[frozenset(np.frombuffer(r[c], np.uint16).tolist()) for r in rows] for c in _FURTHER]
    sketches = [(8 * len(r["sketch"]), int.from_bytes(r["sketch"], "little")) for r in rows]
    root, size, block = ([r[c] for r in rows] for c in ("root", "n", "block"))
    roots, sizes, blocks = (np.array(x, np.int64) for x in (root, size, block))
    parent = {r: r for r in root}

    def partners(i):
        """Rows before i that are not connected to it and near enough in size."""
        own, n, part = root[i], size[i], block[i]
        if i < 32:
            return [j for j in range(i) if root[j] != own and WHOLE * min(n, size[j]) >= PART * max(n, size[j]) and not (crossed and block[j] == part)]
        fit = (roots[:i] != own) & (WHOLE * np.minimum(sizes[:i], n) >= PART * np.maximum(sizes[:i], n))
        return np.flatnonzero(fit & (blocks[:i] != part) if crossed else fit).tolist()

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs, forest = [], []
    for i in range(1, len(rows)):
        own, n, (bits, parity) = root[i], size[i], sketches[i]
        ours = [f[i] for f in further]
        for j in partners(i):
            m = size[j]
            for x, f in zip(ours, further, strict=True):
                if x.isdisjoint(f[j]):
                    break
            else:
                b, other = sketches[j]
                if ((parity ^ other).bit_count() if b == bits else apart(sketches[i], sketches[j])) > most_apart(n, m):
                    continue
                pairs.append((rows[i]["node"], rows[j]["node"]))
                if (p := top(own)) != (q := top(root[j])):
                    parent[p] = q
                    forest.append(pairs[-1])
    whole = everything or len(pairs) <= DENSE * len(rows)
    return (pairs if whole else forest), whole


def _meet(everything: bool, sampled: bool):
    """Candidate pairs (a, b) of groups that come sorted, and (b null) the shingle a of groups that gave a forest only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, rows):
            rows = list({r["node"]: r for r in rows}.values())
            pairs, whole = _candidates(rows, key[1] != key[2] and not sampled, everything)
            out.extend({"a": max(p), "b": min(p)} for p in pairs)
            if not whole or sampled and rows[0]["blocks"] > 1:
                out.append({"a": key[0], "b": None})

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        last, rows, out = None, [], []
        for b in batches:
            for r in b.to_pylist():
                key = (r["token"], r["left"], r["right"])
                if key != last:
                    if len(rows) > 1:
                        done(last, rows)
                    last, rows = key, []
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if len(rows) > 1:
            done(last, rows)
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: as many whole steps of frequency as MOST_FREQUENT holds."""
    step = F.floor(4 * F.log2("n")).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # some 100 rows
        if (held := held + r["count"]) > MOST_FREQUENT:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.filter(step >= least).toArrow()
    token, count = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    return token[np.argsort(token)], count[np.argsort(token)]


def _meeting_rows(docs: DataFrame, frequent) -> DataFrame:
    """token, node, place, size: classes that share a prefix shingle, without shingles that the same classes share as another.

    In the order of sizes a class stays if the next smaller or the next larger one is near enough in size to be
    linked: if any class of the group is, one of these two is.
    """
    rows = docs.select("text").mapInArrow(_prefix_rows(frequent), "token bigint, node bigint, n int")
    by = Window.partitionBy("token").orderBy("n", "node")
    rows = rows.repartition("token").withColumn("before", F.lag("node").over(by)).filter("before is null or node <> before")  # equal sets in several rows are one
    rows = rows.withColumn("smaller", F.lag("n").over(by)).withColumn("larger", F.lead("n").over(by))
    rows = rows.filter((WHOLE * F.col("smaller") >= PART * F.col("n")) | (WHOLE * F.col("n") >= PART * F.col("larger")))
    rows = materialize(rows.select("token", "node"))
    groups = rows.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("y"))
    groups = groups.groupBy("x", "y", "size").agg(F.min("token").alias("token")).select("token", "size")
    rows = rows.join(groups.hint("shuffle_hash"), "token")
    mixed = Window.partitionBy("token").orderBy(F.xxhash64("token", "node"))
    return materialize(rows.withColumn("place", F.row_number().over(mixed) - 1))


def _round(rows: DataFrame, records: DataFrame, roots: DataFrame | None, number: int) -> DataFrame:
    """Candidates of one round over the groups in rows."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if number == 0:  # large groups: every block meets the leaders
        rows = rows.withColumn("left", F.explode(F.when(F.col("place") < LEADERS, every).otherwise(F.array("block")))).withColumn("right", F.col("left"))
    else:
        rows = rows.withColumn("other", F.explode(every)).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other")
    full = rows.join(records.hint("shuffle_hash"), "node")
    full = full.withColumn("root", F.col("node")) if roots is None else full.join(roots.withColumnRenamed("root", "known").hint("shuffle_hash"), "node", "left").withColumn("root", F.coalesce("known", "node"))
    keep = ["token", "left", "right", "block", "blocks", "node", "n", "root", "sketch", *_FURTHER]
    dealt = full.select(*keep).repartition("token", "left", "right").sortWithinPartitions("token", "left", "right")
    return materialize(dealt.mapInArrow(_meet(number >= FOREST_ROUNDS, number == 0), "a bigint, b bigint"))


def link_documents(docs: DataFrame) -> DataFrame:
    """Connected components of near-duplicates by word shingles.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included); one row per
    input row. A text without words, or a null one, has no shingles and links with nothing; its component is its own
    id. Equal sets are linked. Rows of one doc_id with different texts link on their own; a null doc_id is a row like
    others but is never a component's id unless all of it is null.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    read = materialize(rows.mapInArrow(_classify, "doc_id bigint, node bigint, n bigint, token bigint"))
    own = read.filter("token is null").select("doc_id", "node", F.col("n").alias("n_shingles"))
    frequent = sc.broadcast(_frequent(read.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n"))))

    classes = materialize(own.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    # documents of which no row is its class's first
    copies = join_hot(own, classes.withColumn("held", F.col("copies")), "node").groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False))).alias("copy")).filter("copy").select("doc_id")
    single = join_ids(rows, materialize(copies), ["doc_id"], "left_anti")
    meeting = _meeting_rows(single, frequent)

    def texts_of(nodes: DataFrame) -> DataFrame:
        """Texts of the classes nodes(node), one row or more for each; rows without a doc_id are all among them."""
        ids = classes.join(nodes.distinct().hint("shuffle_hash"), "node", "left_semi").select(F.col("first").alias("doc_id")).filter("doc_id is not null").distinct()
        return join_ids(rows, materialize(ids), ["doc_id"]).select("text").unionByName(rows.filter("doc_id is null").select("text"))

    records = texts_of(meeting.select("node")).mapInArrow(_records(frequent), _RECORD)
    records = materialize(records.filter("node is not null").dropDuplicates(["node"]))
    links, asked, roots, number = None, None, None, 0
    while True:
        found = _round(meeting, records, roots, number)
        pairs = found.filter("b is not null").distinct()
        if asked is not None:
            pairs = pairs.join(asked.hint("shuffle_hash"), ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        sets = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))).mapInArrow(_sets, "node bigint, own binary")
        sets = materialize(sets.dropDuplicates(["node"]))
        both = pairs.join(sets.select(F.col("node").alias("a"), "own").hint("shuffle_hash"), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("other")).hint("shuffle_hash"), "b")
        new = materialize(both.select("a", "b", "own", "other").mapInArrow(_verify, "a bigint, b bigint"))
        links = new if links is None else links.unionByName(new)
        asked = pairs if asked is None else asked.unionByName(pairs)
        roots = connected_components(links)
        open_groups = materialize(found.filter("b is null").select(F.col("a").alias("token")).distinct())
        number += 1
        if open_groups.isEmpty():
            break
        meeting = materialize(meeting.join(open_groups.hint("shuffle_hash"), "token", "left_semi"))

    known = materialize(classes.join(roots.hint("shuffle_hash"), "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")))
    least = materialize(known.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("held")))
    known = materialize(join_hot(known, least, "root").select("node", "component", F.col("copies").alias("held")))
    return join_hot(own, known, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document, the smallest doc_id, of each component; all columns stay.

    Rows of a doc_id go together, if one of them is linked to a smaller doc_id; rows without a doc_id are kept.
    """
    gone = materialize(link_documents(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    marked = docs.select(F.col("doc_id").cast("bigint").alias("_gone"), F.struct(*docs.columns).alias("row"))  # whatever their names
    return join_ids(marked, gone, ["_gone"], "left_anti").select("row.*")
