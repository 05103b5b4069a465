"""Difference search by a tree of hashes: two tables are compared by sums over ranges of a key, and rows are read only in
ranges whose sums differ.

A leaf covers `width` values of a whole-number key, a range of the next level `fanout` ranges below it. Every range keeps its
number of rows and two sums of row hashes. They add up, so upper levels come from the leaves, and a change set turns a tree
into that of the changed table without reading the table. Rows without a key are a range of their own on every level.
Repeated rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.operators import changes as ch

SUM = "decimal(38,0)"


@dataclass(frozen=True)
class Shape:
    """How the key is cut. Level 0 holds the leaves; the top level should have few ranges."""

    key: str
    width: int = 1 << 16
    fanout: int = 32
    levels: int = 4

    def range_of(self, level: int) -> Column:
        return F.expr(f"CAST(FLOOR(CAST(`{self.key}` AS DECIMAL(20,0)) / {self.size(level)}) AS BIGINT)")

    def size(self, level: int) -> int:
        return self.width * self.fanout ** level

    def inside(self, level: int, ranges: list[int | None]) -> Column:
        """Rows of these ranges, as bounds of the key that a scan can use; neighbouring ranges are one."""
        key, runs = F.col(self.key), []
        for r in sorted(r for r in ranges if r is not None):
            if runs and runs[-1][1] == r:
                runs[-1][1] = r + 1
            else:
                runs.append([r, r + 1])
        tests = [F.col(self.key).isNull()] if None in ranges else []
        low, high = -(1 << 63), (1 << 63) - 1       # beyond these no whole number needs a bound
        tests += [(key >= F.lit(max(low, a * self.size(level)))) & (key <= F.lit(min(high, b * self.size(level) - 1))) for a, b in runs]
        return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(False)


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ranges whose rows have all gone have no entry."""
    total = rows.groupBy(*by).agg(*[F.sum(c).cast(t).alias(c) for c, t in (("rows", "bigint"), ("a", SUM), ("b", SUM))])
    return total.where("rows <> 0 OR a <> 0 OR b <> 0")


def _leaves(rows: DataFrame, columns: list[str], shape: Shape, sign: Column) -> DataFrame:
    names = sorted(columns)     # the order of columns doesn't count
    hashed = rows.select(shape.range_of(0).alias("range"), sign.alias("sign"), ch.row_hash(names).alias("h"))
    times = lambda side: (F.col(f"h.{side}").cast("decimal(20,0)") * F.col("sign")).cast(SUM)
    return hashed.select(F.lit(0).alias("level"), "range", F.col("sign").cast("bigint").alias("rows"), times("a").alias("a"), times("b").alias("b"))


def _all_levels(leaves: DataFrame, shape: Shape) -> DataFrame:
    out, below = leaves, leaves
    for level in range(1, shape.levels):
        below = _sums(below.select(F.lit(level).alias("level"), F.expr(f"CAST(FLOOR(CAST(range AS DECIMAL(20,0)) / {shape.fanout}) AS BIGINT)").alias("range"), "rows", "a", "b"),
                      ["level", "range"])
        out = out.unionByName(below)
    return out


def tree(rows: DataFrame, shape: Shape) -> DataFrame:
    """(level, range, rows, a, b) of a table; an empty table has an empty tree. Store it next to the table."""
    return _all_levels(_sums(_leaves(rows, rows.columns, shape, F.lit(1)), ["level", "range"]), shape)


def folded(stored: DataFrame, changes: DataFrame, shape: Shape) -> DataFrame:
    """The tree after a change set (operators.changes): minus the old rows, plus the new ones, the table isn't read."""
    signed = ch.signed(changes)
    columns = [c for c in signed.columns if c != "sign"]
    leaves = stored.where("level = 0").select("level", "range", "rows", "a", "b").unionByName(_leaves(signed, columns, shape, F.col("sign")))
    return _all_levels(_sums(leaves, ["level", "range"]), shape)


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(level, range) whose rows differ. Where a range of one level differs, so does the one above it."""
    side = lambda t, n: t.select("level", "range", F.struct("rows", "a", "b").alias("s"), F.lit(n).alias("n"))
    both = side(left, 0).unionByName(side(right, 1)).groupBy("level", "range").agg(
        F.max(F.when(F.col("n") == 0, F.col("s"))).alias("l"), F.max(F.when(F.col("n") == 1, F.col("s"))).alias("r"))
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("level", "range")


def to_open(left: DataFrame, right: DataFrame, shape: Shape, at_most: int = 256) -> tuple[int, list[int | None]]:
    """The finest level at which no more than `at_most` ranges differ, and these ranges.

    The driver sees one number for each level and `at_most` ranges. Where even the top level has more, (levels, []) says
    that the tables have to be compared whole.
    """
    found = differing(left, right)
    counts = {r["level"]: r["count"] for r in found.groupBy("level").count().collect()}
    for level in range(shape.levels):
        if counts.get(level, 0) <= at_most:
            return level, [r["range"] for r in found.where(F.col("level") == level).select("range").collect()]
    return shape.levels, []


def differences(before: DataFrame, after: DataFrame, before_tree: DataFrame, after_tree: DataFrame, keys: list[str],
                shape: Shape, at_most: int = 256) -> DataFrame:
    """The change set between two tables with the same columns, each holding a key once, that reads only ranges that differ.

    `shape.key` is one of the keys. Equal to change_set() over the whole tables, unless two different sets of rows of one
    range have equal numbers of rows and equal sums of both 64-bit hashes.
    """
    level, ranges = to_open(before_tree, after_tree, shape, at_most)
    inside = F.lit(True) if level == shape.levels else shape.inside(level, ranges)
    return ch.change_set(before.where(inside), after.where(inside), keys)
