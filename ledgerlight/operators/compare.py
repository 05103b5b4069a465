"""Comparing two sides: key differences, side-by-side sums, tolerance reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def key_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only, tagged `missing` (left only) or `extra` (right only)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (a.join(b, keys, "left_anti").withColumn("side", F.lit("missing"))
            .unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra"))))


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], value: str,
                 names: tuple[str, str] = ("expected", "actual")) -> DataFrame:
    """Full outer view of two keyed values, absent sides as zero."""
    a = left.select(*keys, F.col(value).alias(names[0]))
    b = right.select(*keys, F.col(value).alias(names[1]))
    return a.join(b, keys, "full").fillna(0, subset=list(names))


def within(expected: Column, actual: Column, tolerance: float) -> Column:
    """Relative tolerance; against an expected zero the difference itself has to be within it."""
    gap = F.abs(expected - actual)
    return F.coalesce(F.when(expected == 0, gap <= tolerance).otherwise(gap / F.abs(expected) <= tolerance),
                      F.lit(False))


def pct_diff(expected: Column, actual: Column) -> Column:
    return F.when(expected != 0, F.abs(expected - actual) / F.abs(expected))


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 0.01,
              ignore_below: float = 1.0) -> DataFrame:
    """Per key: both sides, difference, and whether it matches; keys tiny on both sides are left out."""
    pairs = side_by_side(left, right, [key], value)
    e, a = F.col("expected").cast("double"), F.col("actual").cast("double")
    return (pairs.where((F.abs(e) >= ignore_below) | (F.abs(a) >= ignore_below))
            .select(key, e.alias("expected"), a.alias("actual"), (a - e).alias("diff"),
                    within(e, a, tolerance).alias("matches")))
