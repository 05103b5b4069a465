"""Matching closing deals to the deals that opened the position.

Every exit pairs with every entry of its (position, source), so a position with many deals on both sides has
a product of pairs. All uses of the pairs add up notionals by login and opening time, therefore both sides
are aggregated first and the sums multiplied by the number of entries; no pair is ever materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import money as m

MATCH = ["position_id", "source"]


def _exits(deals: DataFrame) -> DataFrame:
    return (deals.where((F.col("entry") == 1) & m.closed())
            .groupBy(*MATCH, "login")
            .agg(F.sum("notional").alias("notional"), F.count(F.lit(1)).alias("exits"),
                 F.max(F.when(F.col("notional") > 0, 1).otherwise(0)).alias("has_notional")))


def matched_rows(deals: DataFrame, opened: Column, name: str, first_entry_only: bool = False,
                 within: Column | None = None) -> DataFrame:
    """Exits of a (position, source, login) with the entries of one opening moment: notional, pairs and whether any notional is positive.

    `opened` is the grain of the entry time. `first_entry_only` dates an exit by the earliest entry of its
    position instead of counting it once per entry. `within` tests the time an exit is dated by. An opening moment of a
    login may have several rows, for callers that add up.
    """
    within = F.lit(True) if within is None else within
    entries = deals.where(F.col("entry") == 0)
    if first_entry_only:
        entries = (entries.groupBy(*MATCH).agg(F.min("open_time").alias("open_time")).where(within)
                   .select(*MATCH, opened.alias(name), F.lit(1).cast("bigint").alias("entries")))
    else:
        entries = entries.where(within).groupBy(*MATCH, opened.alias(name)).agg(F.count(F.lit(1)).alias("entries"))
    return _exits(deals).join(entries, MATCH).select(
        "login", name, (F.col("notional") * F.col("entries")).alias("notional"),
        (F.col("exits") * F.col("entries")).alias("pairs"), "has_notional")


def matched_volume(deals: DataFrame, opened: Column, name: str, first_entry_only: bool = False) -> DataFrame:
    """Exit notional per (login, opening moment): sum, pair count, and whether any notional is positive."""
    return (matched_rows(deals, opened, name, first_entry_only).groupBy("login", name)
            .agg(F.sum("notional").cast("decimal(28,4)").alias("notional"), F.sum("pairs").alias("pairs"),
                 F.max("has_notional").alias("has_notional")))


def unmatched_exits(deals: DataFrame) -> DataFrame:
    """Closing deals whose position has no opening deal in the same source."""
    exits = deals.where((F.col("entry") == 1) & m.closed())
    entries = deals.where(F.col("entry") == 0).select(*MATCH).distinct()
    return exits.join(entries, MATCH, "left_anti")
