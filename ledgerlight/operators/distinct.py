"""Distinct counts that add up: exact sets of ids as stored bitmaps, one for each key and range of ids.

A set keeps, for each range of 32,768 ids that it touches, either the places of its ids in the range (at most SPARSE of
them) or a bitmap of 4 KB. Sets of any keys are joined by OR, so the distinct clients of a month, a team or all agents
come from the stored cells without reading what they were made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RANGE_BITS = 15
SPARSE = 512                 # places are two bytes each: beyond this a bitmap of 4 KB is not much more
MASK = (1 << RANGE_BITS) - 1


def id_sets(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(keys, id_range, ids, places, bitmap) of the distinct non-null ids of each key; any 64-bit id will do."""
    where = rows.where(F.col(ident).isNotNull()).select(*keys, F.shiftright(F.col(ident).cast("long"), RANGE_BITS).alias("id_range"),
                                                        F.col(ident).cast("long").bitwiseAND(F.lit(MASK)).alias("place"))
    # at most 32,768 places a group once they are distinct
    sets = where.distinct().groupBy(*keys, "id_range").agg(
        F.count("*").alias("ids"), F.collect_list(F.col("place").cast("short")).alias("places"), F.bitmap_construct_agg("place").alias("bitmap"))
    few = F.col("ids") <= SPARSE
    return sets.select(*keys, "id_range", "ids", F.when(few, F.col("places")).alias("places"), F.when(~few, F.col("bitmap")).alias("bitmap"))


def united(sets: DataFrame, keys: list[str]) -> DataFrame:
    """The sets of coarser `keys` (columns or aliased expressions already in `sets`): all sets of a key joined by OR."""
    spread = sets.where("places IS NOT NULL").select(*keys, "id_range", F.explode(F.col("places").cast("array<long>")).alias("place"))
    sparse = spread.groupBy(*keys, "id_range").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    dense = sets.where("bitmap IS NOT NULL").select(*keys, "id_range", "bitmap")
    both = sparse.unionByName(dense).groupBy(*keys, "id_range").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return both.withColumn("ids", F.bitmap_count("bitmap"))


def counted(sets: DataFrame, keys: list[str], name: str = "clients") -> DataFrame:
    """Distinct ids by `keys` (none: one row over all)."""
    total = united(sets, keys)
    return (total.groupBy(*keys) if keys else total).agg(F.coalesce(F.sum("ids"), F.lit(0)).alias(name))
