"""Change sets: what turns one version of a keyed table into another, with images before and after.

A change set has the key columns, `before` and `after` (structs of all columns; null where the row is missing). It is at
the same time a feed for whatever is built on the table: signed() gives minus the old and plus the new rows, which
additive results add up. Keys may be null; versions hold a key once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def with_keys(df: DataFrame, wanted: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key is in `wanted` (or, with left_anti, is not); a null key equals a null key."""
    other = wanted.select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(other, on, how)


def image(columns: list[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in columns])


def row_hash(columns: list[str]) -> Column:
    """128 bits of a row's values; nulls have a place of their own in them."""
    missing = F.concat_ws("", *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.struct(F.xxhash64(*columns, missing).alias("a"), F.xxhash64(F.lit(1), missing, *reversed(columns)).alias("b"))


def change_set(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows inserted, updated (by row hash) and deleted between two versions with the same columns.

    Only keys and hashes of the two tables are shuffled and compared; whole rows are fetched for keys that differ.
    """
    columns = before.columns
    values = [c for c in columns if c not in keys] or keys
    light = lambda df, side: df.select(*keys, F.when(F.lit(side == 0), row_hash(values)).alias("b"), F.when(F.lit(side == 1), row_hash(values)).alias("a"))
    marks = light(before, 0).unionByName(light(after, 1)).groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    differ = marks.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)
    images = lambda df, side: with_keys(df, differ, keys).select(
        *keys, *[(image(columns) if name == side else F.lit(None).cast(df.select(image(columns).alias("i")).schema["i"].dataType)).alias(name) for name in ("before", "after")])
    both = images(before, "before").unionByName(images(after.select(*columns), "after"))
    return both.groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))


def differing(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """change_set() in one pass that shuffles whole rows: for versions of which most rows differ or that cost to compute."""
    columns = before.columns
    side = lambda df, name: df.select(*columns).select(
        *keys, *[(image(columns) if name == n else F.lit(None).cast(before.schema)).alias(n) for n in ("before", "after")])
    both = side(before, "before").unionByName(side(after, "after"))
    return both.groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def operation() -> Column:
    return F.when(F.col("before").isNull(), INSERT).when(F.col("after").isNull(), DELETE).otherwise(UPDATE)


def signed(changes: DataFrame) -> DataFrame:
    """(sign, columns of the table): minus one for each old row, plus one for each new one."""
    sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("row")))
    return changes.select(F.explode(sides).alias("s")).where("s.row IS NOT NULL").select("s.sign", "s.row.*")


def applied(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`base` with the change set applied; applying it again changes nothing."""
    fresh = changes.where("after IS NOT NULL").select("after.*").select(*base.columns)
    return with_keys(base, changes, keys, "left_anti").unionByName(fresh)
