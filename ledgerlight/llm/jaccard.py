"""N-gram Jaccard join by count vectors in R-trees, exact for links of 0.75 and more on five-word shingles.

Shingle hashes fall into groups; a text is the point of its group counts. The sum of coordinate minima of two points
bounds their overlap from above, and so does the sum against the upper corner of a tree node for all texts below it.

Which points meet in a tree: two sets that link share a shingle among the first n/4 + 1 of either under any common
order, so each such shingle is a bucket. The order puts shingles of crowded hash groups last (document counts of
32,768 groups over all texts: a table of fixed size), so that passages of many documents rarely make a bucket.
Within a bucket each text meets the one that shares most buckets with others, in a group of copies mostly their
original. These pairs are verified and joined to components; buckets that still hold several components are searched,
with R-trees over tiles of bounded size, for links between components. So a group of m near copies costs m checks a
bucket and not m * m, and no link that matters to the components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.llm import shingles
from ledgerlight.llm.components import components
from ledgerlight.llm.storage import sieved, stored

DIMENSIONS = 1024        # coordinates of a point
ORDER_BITS = 15          # hash groups for the order of shingles
TILE = 2048              # points in a tree at most, about
LEAF, FANOUT = 32, 16


def enough(overlap, size_a, size_b):
    """100 * overlap >= 75 * union."""
    return 7 * overlap >= 3 * (size_a + size_b)


class RTree:
    """Points packed by size, then by the coordinate that varies most, into leaves; upper levels hold corner maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * FANOUT
        for lo in range(0, len(order), slab):
            part = order[lo:lo + slab]
            axis = int(points[part].var(axis=0).argmax())
            order[lo:lo + slab] = part[np.argsort(points[part, axis], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels, top, low, high, width = [], self.points, self.sizes, self.sizes, LEAF
        while len(top) > 1 or not self.levels:
            cut = np.arange(0, len(top), width)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high, width))
            width = FANOUT

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions (in the input) of the points that the bound doesn't rule out."""
        found = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, width = self.levels[depth]
            fits = (4 * high[found] >= 3 * size) & (3 * low[found] <= 4 * size)
            found = found[fits]
            bound = np.minimum(top[found], point).sum(axis=1, dtype=np.int64)
            found = found[enough(bound, size, low[found])]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            found = (found[:, None] * width + np.arange(width)).ravel()
            found = found[found < below]
        sizes = self.sizes[found]
        keep = (4 * sizes >= 3 * size) & (3 * sizes <= 4 * size)
        found = found[keep]
        return self.order[found[enough(np.minimum(self.points[found], point).sum(axis=1, dtype=np.int64), size, self.sizes[found])]]


def decoded(points: list[bytes]) -> np.ndarray:
    """Group counts by row. Empty bytes stand for counts beyond 255: such a point is the top corner, and the bound lets it through."""
    out = np.full((len(points), DIMENSIONS), 65535, np.uint16)
    given = [i for i, p in enumerate(points) if p]
    out[given] = np.frombuffer(b"".join(points), np.uint8).reshape(len(given), DIMENSIONS)
    return out


def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        keys, sizes, points = [], [], []
        for codes in shingles.shingle_sets(batch.column(1)):
            keys.append(shingles.set_key(codes))
            sizes.append(len(codes))
            point = np.bincount((codes & np.uint64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS)
            points.append(point.astype(np.uint8).tobytes() if point.max() < 256 else b"")
            counts += np.bincount((codes >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
        yield features_batch(batch.column(0), batch.column(2), keys, sizes, points, None)
    yield features_batch(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), [None], [None], [None], [counts])


def features_batch(ids, rows, keys, sizes, points, counts) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    rest = [pa.array(x if x is not None else [None] * len(keys), k) for x, k in zip((keys, sizes, points, counts), kinds)]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), rows, *rest], ["doc_id", "row", "key", "n", "point", "counts"])


def row_of(text: str) -> Column:
    """What tells apart rows that share a doc_id."""
    return F.xxhash64(text)


def features(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """(doc_id, row, key, n, point) for each row of (doc_id, text), row being row_of(text), and how many shingles of all texts fall into each order group."""
    both = stored(docs.withColumn("row", row_of("text")).mapInArrow(features_of, "doc_id long, row long, key long, n long, point binary, counts array<long>"), "features")
    crowd = both.where("counts is not null").select(F.posexplode("counts").alias("g", "c")).groupBy("g").agg(F.sum("c").alias("c"))
    order = [0] * (1 << ORDER_BITS)
    for g, c in crowd.collect():   # one row for each of a fixed number of groups
        order[g] = c
    return both.where("counts is null").drop("counts"), order


def signatures(docs: DataFrame, order: list[int]) -> DataFrame:
    """(token, key, n): the first n/4 + 1 shingles of each text, rare hash groups first."""
    crowd = np.array(order, np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, keys, sizes, known, waiting = [], [], [], set(), 0
            ids = batch.column(0)
            for row, codes in enumerate(shingles.shingle_sets(batch.column(1))):
                key = shingles.set_key(codes)
                if len(codes) and ids[row].is_valid and key not in known:
                    known.add(key)
                    first = np.argsort(crowd[codes >> np.uint64(64 - ORDER_BITS)], kind="stable")[:len(codes) // 4 + 1]
                    tokens.append(codes[first].view(np.int64))
                    keys.append(np.full(len(first), key))
                    sizes.append(np.full(len(first), len(codes)))
                    waiting += len(first)
                if waiting > 1 << 18:
                    yield signature_batch(tokens, keys, sizes)
                    tokens, keys, sizes, waiting = [], [], [], 0
            if waiting:
                yield signature_batch(tokens, keys, sizes)

    return docs.mapInArrow(of, "token long, key long, n long")


def signature_batch(tokens, keys, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, sizes)], ["token", "key", "n"])


def buckets(marks: DataFrame) -> DataFrame:
    """(token, key, n, members) of tokens with at least two different sets."""
    along = Window.partitionBy("token").orderBy("n", "key")
    once = marks.withColumn("before", F.lag("key").over(along)).where("before is null or before <> key")
    chained = once.withColumn("after", F.lead("key").over(along)).where("before is not null or after is not null")
    return chained.withColumn("members", F.count("*").over(Window.partitionBy("token"))).select("token", "key", "n", "members")


def centred(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of set keys: in each bucket every set with the one whose tokens meet most others."""
    known = shared.groupBy("key").agg(F.sum("members").alias("known"))
    inside = Window.partitionBy("token").orderBy(F.desc("known"), "key")
    met = (shared.join(known, "key").withColumn("centre", F.first("key").over(inside)).withColumn("n_centre", F.first("n").over(inside))
           .where("key <> centre and 4 * least(n, n_centre) >= 3 * greatest(n, n_centre)"))
    return met.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of set keys those whose count vectors allow a link."""
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (decoded(batch.column(c).to_pylist()) for c in ("pa", "pb"))
            a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array(enough(np.minimum(p, q).sum(axis=1, dtype=np.int64), a, b)))

    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(bound, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of set keys those that link, compared on their texts."""
    needed = stored(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
                    .join(classes.select("key", F.col("doc").alias("doc_id")), "key"), "needed")
    texts = needed.join(sieved(docs, F.col("doc_id"), needed.select("doc_id")), "doc_id").select("key", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for x, y, ka, kb in zip(shingles.shingle_sets(batch.column("ta")), shingles.shingle_sets(batch.column("tb")), a, b):
                common = len(x) + len(y) - len(shingles.distinct(np.concatenate([x, y])))
                good.append(shingles.set_key(x) == ka and shingles.set_key(y) == kb and enough(common, len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.mapInArrow(compare, "a long, b long").distinct()


def across(shared: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of set keys in a common bucket, of different components, that the R-tree bound lets through."""
    rooted = shared.select("token", "key", "n").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    kinds = rooted.groupBy("token").agg(F.count("*").alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1"),
                                        F.bit_xor(F.xxhash64("key")).alias("x0"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x1"))
    # many tokens have the same members: one of them is enough
    mixed = kinds.where("r0 <> r1").groupBy("members", "x0", "x1").agg(F.min("token").alias("token"))
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    rows = (rooted.join(mixed.select("token", "members"), "token").withColumn("tiles", tiles)
            .withColumn("tile", F.pmod(F.xxhash64("key", F.lit(2)), F.col("tiles")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("token", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "key", "root", "n"))
    rows = rows.join(classes.select("key", "point"), "key")
    rows = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return rows.select("token", "lo", "hi", "tile", "key", "root", "n", "point").mapInArrow(tile_pairs, "a long, b long").distinct()


def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, lo, hi): an R-tree over the first tile of each, searched with the points of the second."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        group = np.stack([held.column(c).to_numpy() for c in ("token", "lo", "hi")], 1) if len(held) else np.zeros((0, 3))
        cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        if len(cut):
            yield searched(held.slice(0, int(cut[-1])), cut)
            held = held.slice(int(cut[-1]))
    if held is not None and len(held):
        yield searched(held, np.array([len(held)]))


def searched(rows: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
    lo, hi, tile, key, root, size = (rows.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "tile", "key", "root", "n"))
    points = decoded(rows.column("point").to_pylist())
    left, right, start = [], [], 0
    for stop in cut:
        at = np.arange(start, stop)
        start = stop
        own = at[tile[at] == lo[at]]
        if not len(own):
            continue
        tree = RTree(points[own], size[own])
        for q in at[tile[at] == hi[at]]:
            found = own[tree.search(points[q], size[q])]
            found = found[(root[found] != root[q]) & ((lo[q] != hi[q]) | (found < q))]
            left.append(key[found])
            right.append(np.full(len(found), key[q]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, row, key, n_shingles, component_id, component_key) for each row of `docs` (doc_id long, text string; other columns are ignored).

    Words are runs without ASCII white space, A-Z lower-cased; shingles have five words, a shorter text is one shingle.
    Two rows link when 100 * overlap >= 75 * union; component_id is the smallest doc_id reachable by links.
    Rows without words (null, empty or blank text) have 0 shingles and their own doc_id. Rows with a null doc_id link
    with nothing and have a null component_id. Repeated rows stay repeated; rows that share a doc_id but not the text
    are separate members that carry the same id. component_key is the key of the component's set with the smallest doc_id (of
    several the smallest key; null where component_id isn't that of a set) and tells components with the same id apart;
    row is row_of(text). An empty table gives an empty result.
    Sets are told apart by 64-bit hashes of shingles and sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described, order = features(docs)
    classes = stored(described.where("doc_id is not null and n > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("point").alias("point")), "classes")
    shared = stored(buckets(signatures(docs, order)), "buckets")
    first = stored(centred(shared), "pairs")
    near = stored(verified(stored(bounded(first, classes), "pairs"), classes, docs), "links")
    roots = stored(components(near).select(F.col("node").alias("key"), "root"), "roots")
    rest = stored(across(shared, roots, classes).join(first, ["a", "b"], "left_anti"), "pairs")
    far = stored(verified(rest, classes, docs), "links")
    # a member is a set; its doc_id comes first, so that the smallest member has the component's smallest doc_id
    ids = classes.select("key", F.struct("doc", "key").alias("member"))
    named = near.union(far).join(ids.select(F.col("key").alias("a"), F.col("member").alias("ma")), "a").join(
        ids.select(F.col("key").alias("b"), F.col("member").alias("mb")), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    last = components(named).select(F.col("node.key").alias("key"), "root")
    known = ids.join(last, "key", "left").select("key", F.coalesce("root", "member").alias("component"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return described.join(known, "key", "left").select(
        "doc_id", "row", "key", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component.doc")).alias("component_id"),
        F.when(~alone, F.col("component.key")).alias("component_key"))
