"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A random rotation spreads a vector's length over all coordinates; its code is their signs, packed, with two numbers: the
norm, and the inner product of the unit vector with its own code. A query is rotated and cut to QUERY_BITS bit planes, so
its inner product with a code is a few bit counts, and divided by the second number it estimates the inner product of
the unit vectors without bias. The error is at most BOUND standard deviations of about sqrt((1 - p * p) / (p * p * (D - 1)))
for a code of inner product p, except by rare chance: a vector is reranked with the original numbers if estimate plus
error reaches the query's 20th best so far. Queries and vectors meet in blocks of bounded size; every vector is indexed,
and the rotation needs no training.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_BITS = 5
BOUND = 2.5
NEAREST = 20
CELL_NUMBERS = 1 << 20       # numbers of vectors (or of queries) in a cell, about
QUERIES, VECTORS = 128, 2048  # in a block of estimates
SEED = 7


def rotation(dimension: int) -> np.ndarray:
    """A random orthogonal matrix, a multiple of 64 wide; vectors count as padded with zeros."""
    width = -(-dimension // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))
    return (q * np.sign(np.diag(r)))[:dimension]


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest component's size of each vector, and the vectors divided by it, whose squares neither vanish nor overflow."""
    size = np.abs(vectors).max(axis=1)
    return size, vectors / size[:, None]


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (rows of 64-bit words), norms, and the inner product of each unit vector with its code."""
    size, units = scaled(vectors)
    turned = units @ rotation(vectors.shape[1])
    length = np.sqrt((units * units).sum(axis=1))
    own = np.abs(turned).sum(axis=1) / length / np.sqrt(turned.shape[1])
    with np.errstate(over="ignore"):
        return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), size * length, own


def planes(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the rotated unit queries (query, plane, word), their lowest value, step and sum."""
    turned = scaled(queries)[1] @ rotation(queries.shape[1])
    turned /= np.sqrt((turned * turned).sum(axis=1, keepdims=True))
    low = turned.min(axis=1, keepdims=True)
    step = (turned.max(axis=1, keepdims=True) - low) / (2 ** QUERY_BITS - 1)
    step[step == 0] = 1
    levels = np.rint((turned - low) / step).astype(np.uint8)
    bits = (levels[:, None, :] >> np.arange(QUERY_BITS, dtype=np.uint8)[:, None]) & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), low[:, 0], step[:, 0], turned.sum(axis=1)


def estimates(codes: np.ndarray, own: np.ndarray, cut) -> np.ndarray:
    """Estimated inner products of the unit vectors, queries by codes."""
    bits, low, step, total = cut
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    weighed = np.zeros((len(bits), len(codes)), np.int64)
    for plane in range(QUERY_BITS):
        for word in range(codes.shape[1]):
            weighed += np.bitwise_count(bits[:, plane, word, None] & codes[None, :, word]).astype(np.int64) << plane
    positive = low[:, None] * ones + step[:, None] * weighed
    return (2 * positive - total[:, None]) / np.sqrt(codes.shape[1] * 64) / own


def exact(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.empty(len(q))
    for lo in range(0, len(q), 1 << 14):
        out[lo:lo + (1 << 14)] = np.einsum("ij,ij->i", queries[q[lo:lo + (1 << 14)]], vectors[v[lo:lo + (1 << 14)]])
    return np.where(np.isnan(out), -np.inf, out)


def nearest(query_ids, queries, ids, vectors, codes, norms, own, k: int = NEAREST):
    """(query_id, vec_id, score) arrays: the k best of these vectors for each query, the query's own id left out.

    A sum that is no number, as products beyond the range of doubles can give, counts as minus infinity.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        return _nearest(query_ids, queries, ids, vectors, codes, norms, own, k)


def _nearest(query_ids, queries, ids, vectors, codes, norms, own, k):
    spread = BOUND * np.sqrt(np.maximum(0, 1 - own * own) / (own * own) / max(1, codes.shape[1] * 64 - 1))
    best: list[tuple[np.ndarray, np.ndarray]] = []
    for q0 in range(0, len(queries), QUERIES):
        some, names = queries[q0:q0 + QUERIES], query_ids[q0:q0 + QUERIES]
        cut, length = planes(some), coded(some)[1]
        worst = np.full(len(some), -np.inf)
        top = [(np.zeros(0, np.int64), np.zeros(0)) for _ in names]
        for v0 in range(0, len(vectors), VECTORS):
            part = slice(v0, v0 + VECTORS)
            scale = length[:, None] * norms[part]
            guess = estimates(codes[part], own[part], cut) * scale
            other = ids[part] != names[:, None]
            guess[~other] = -np.inf
            high = guess + spread[part] * scale
            if v0 == 0 and guess.shape[1] > k:      # the k best guesses set the first bar
                first = np.argpartition(-guess, k, axis=1)[:, :k]
                at = np.repeat(np.arange(len(some)), k), first.ravel()
                scores = exact(some, vectors[part], *at).reshape(len(some), k)
                valid = np.take_along_axis(other, first, axis=1)
                worst = np.where(valid, scores, -np.inf).min(axis=1)
            sure = ~(high < worst[:, None]) & other     # a bound beyond the numbers' range says nothing
            q, v = np.nonzero(sure)
            scores = exact(some, vectors[part], q, v)
            ends = np.searchsorted(q, np.arange(len(some) + 1))
            for i in range(len(some)):
                lo, hi = ends[i], ends[i + 1]
                if hi > lo:
                    known, values = np.concatenate([top[i][0], ids[part][v[lo:hi]]]), np.concatenate([top[i][1], scores[lo:hi]])
                    order = np.lexsort((known, -values))[:k]
                    top[i] = known[order], values[order]
                    if len(order) == k:
                        worst[i] = max(worst[i], values[order[-1]])
        best += top
    return (np.repeat(query_ids, [len(b[0]) for b in best]), *(np.concatenate([b[i] for b in best]) if best else np.zeros(0, t)
                                                            for i, t in ((0, np.int64), (1, float))))


def fit_to_search(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, dim): one row for each id; vectors null, zero, empty or holding null or non-finite numbers, and null ids, are left out.

    Of rows that repeat an id the one with the smallest vector stays.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = rows.where("vec_id is not null and v is not null").where(F.forall("v", number) & F.exists("v", lambda x: x != 0))
    return good.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def indexed(vectors: DataFrame) -> DataFrame:
    """`vectors` (vec_id, v, dim) with code, norm and own; see coded()."""
    def of(frames):
        for frame in frames:
            parts = []
            for _, same in frame.groupby("dim", sort=False):
                codes, norms, own = coded(np.stack(same["v"].to_numpy()))
                parts.append(same.assign(code=[c.tobytes() for c in codes], norm=norms, own=own))
            if parts:
                yield pd.concat(parts)

    return vectors.mapInPandas(of, "vec_id long, v array<double>, dim int, code binary, norm double, own double")


def searched(queries: DataFrame, index: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of `queries` (vec_id, v, dim) its k best in `index` of the same dimension.

    Nearest first, ties to the smaller vec_id, ranks from 1. Ids of `queries` should differ, as those of fit_to_search() do:
    of rows with one id the k best of all together come back, a vector once for each row that has it among its best.
    Every query meets every code once, so work grows with queries times vectors. Each cell holds a share of the queries and a share of the
    vectors; shares go by a hash of the id, so many copies of one vector are spread like others.
    """
    numbers = index.agg(F.count("*").alias("n"), F.max("dim").alias("d")).first()
    asked = queries.agg(F.count("*")).first()[0]
    share = max(64, CELL_NUMBERS // max(1, numbers["d"] or 1))
    columns, rows = -(-numbers["n"] // share) or 1, -(-asked // share) or 1

    def dealt(df: DataFrame, own: str, mine: int, other: str, many: int) -> DataFrame:
        place: Column = F.pmod(F.xxhash64("vec_id"), F.lit(mine)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        codes = np.frombuffer(b"".join(right["code"]), np.uint64).reshape(len(right), -1)
        found = nearest(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()),
                        codes, right["norm"].to_numpy(), right["own"].to_numpy(), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    asked_cells = dealt(queries, "row", rows, "column", columns).groupBy("dim", "row", "column")
    index_cells = dealt(index, "column", columns, "row", rows).groupBy("dim", "row", "column")
    found = asked_cells.cogroup(index_cells).applyInPandas(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
