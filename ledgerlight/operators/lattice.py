"""Groupings by every one and two of many dimensions, each added up from the smallest grouping that holds it.

A row of a lattice is (grouping, labels, sums): `grouping` names its dimensions, joined by commas, `labels` has their
values. The table is read once, for the finest grouping; that and each coarser level are stored, and the number of rows
of each stored grouping, a line per grouping on the driver, says which one is the smallest parent of the next.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

Dims = tuple[str, ...]
#: writes a table under a name and reads it back
Store = Callable[[DataFrame, str], DataFrame]


def _added(sums: dict[str, str]) -> list[Column]:
    return [F.sum(c).cast(t).alias(c) for c, t in sums.items()]


def _named(dims: Dims) -> str:
    return ",".join(dims)


def _sizes(level: DataFrame) -> dict[Dims, int]:
    return {tuple(r["grouping"].split(",")): r["n"] for r in level.groupBy("grouping").agg(F.count(F.lit(1)).alias("n")).collect()}


def smallest_parents(wanted: list[Dims], sizes: dict[Dims, int]) -> dict[Dims, list[Dims]]:
    """Parent -> the wanted groupings it is the smallest parent of; ties go to the one with fewer dimensions."""
    out: dict[Dims, list[Dims]] = {}
    for dims in wanted:
        holds = [p for p in sizes if set(dims) <= set(p)]
        out.setdefault(min(holds, key=lambda p: (sizes[p], len(p), p)), []).append(dims)
    return out


def derived(rows: DataFrame, children: dict[Dims, list[Dims]], sums: dict[str, str]) -> DataFrame:
    """The groupings `children` of the rows of their parents; rows of other groupings are left out."""
    choice = None
    for parent, kids in children.items():
        each = F.array(*[F.struct(F.lit(_named(k)).alias("grouping"), F.array(*[F.col("labels")[parent.index(d)] for d in k]).cast("array<string>").alias("labels"))
                         for k in kids])
        is_parent = F.col("grouping") == _named(parent)
        choice = F.when(is_parent, each) if choice is None else choice.when(is_parent, each)
    parents = rows.where(F.col("grouping").isin([_named(p) for p in children]))
    copies = parents.select(F.explode(choice).alias("_to"), *sums)
    return copies.groupBy(F.col("_to.grouping").alias("grouping"), F.col("_to.labels").alias("labels")).agg(*_added(sums))


def groupings(cells: DataFrame, dims: list[str], sums: dict[str, str], store: Store, block: int = 3) -> DataFrame:
    """(grouping, labels, sums) by each one and each two of `dims` (columns without a comma in their name) and over all (grouping '').

    Sums add up over rows; a distinct count is one if its ids lie in one row of `cells` each (a flag per client), else
    its sets have to be kept (see distinct). Between the finest grouping and the pairs lies a level of unions of blocks
    of dimensions, ordered by their numbers of values. A dimension with a value for every second row or more, such as an
    id, makes no smaller union and is taken from the finest grouping. An empty table has no grouping but the one over
    all, whose sums are null. Null labels are values like any other.
    """
    whole = tuple(dims)
    finest = store(cells.groupBy(F.lit(_named(whole)).alias("grouping"), F.array(*[F.col(d).cast("string") for d in dims]).alias("labels")).agg(*_added(sums)), "finest")
    counts = finest.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.col("labels")[i]).alias(f"d{i}") for i in range(len(dims))]).first()
    values = {d: counts[f"d{i}"] for i, d in enumerate(dims)}
    order = sorted((d for d in dims if values[d] * 2 < counts["n"]), key=lambda d: (values[d], d))
    blocks = [order[i:i + block] for i in range(0, len(order), block)]
    unions = [tuple(d for d in dims if d in x + y) for x, y in combinations(blocks, 2)] if len(blocks) > 2 else []
    sizes, level = {whole: counts["n"]}, finest
    if unions:
        wide = store(derived(finest, {whole: unions}, sums), "unions")
        sizes, level = sizes | _sizes(wide), finest.unionByName(wide)
    pairs = store(derived(level, smallest_parents(list(combinations(dims, 2)), sizes), sums), "pairs") if len(dims) > 1 else finest
    known = _sizes(pairs) or {whole: 0}
    singles = store(derived(pairs, smallest_parents([(d,) for d in dims], known), sums), "singles")
    first = min(dims, key=lambda d: (values[d], d))
    total = (singles.where(F.col("grouping") == first).agg(*_added(sums))
             .select(F.lit("").alias("grouping"), F.array().cast("array<string>").alias("labels"), *sums))
    parts = singles.unionByName(total)
    return parts.unionByName(pairs) if len(dims) > 1 else parts
