"""Bonus tiers and target ladders as `when` chains over fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Office codes of the two bonus groups.
OFFICE_GROUPS = {"A": ("GMT", "CY", "BU"), "B": ("ABJ-NG", "SA", "LAG-NG")}
# Fixed values: (at least, result) from the top down.
NET_TIERS = {
    "A": ((200000, 0.04), (150000, 0.0375), (100000, 0.035), (75000, 0.03), (50000, 0.02), (20000, 0.015)),
    "B": ((100000, 0.035), (80000, 0.03), (60000, 0.028), (50000, 0.025), (40000, 0.02), (30000, 0.018),
          (20000, 0.015), (10000, 0.01)),
}
VOLUME_TIERS = ((2.0, 0.015), (1.5, 0.0125), (1.0, 0.01), (0.75, 0.005), (0.5, 0.002))
FTD100_MULTIPLIER = ((48, 65), (44, 60), (40, 55), (36, 50), (32, 45), (28, 40), (24, 35), (20, 30),
                     (15, 25), (10, 20), (5, 15))
TARGET_BONUS = ((60, 1500), (50, 1000), (35, 500), (30, 300), (25, 200), (20, 150), (5, 100))
AMOUNT_BONUS = ((5000, 50), (1000, 20), (500, 10))
TARGET_HIT_PCT = 0.005
VOLUME_PER_TARGET = 1650
QUALIFY_SHARE = 0.5
# Monthly targets by whole months of tenure.
NET_LADDER = ((9, 100000), (8, 85000), (7, 75000), (6, 55000), (5, 40000), (4, 30000), (3, 20000), (2, 10000))
FTD100_LADDER = ((7, 35), (6, 30), (5, 25), (4, 20), (3, 15), (2, 10), (1, 5))


def tier(value: Column, table, otherwise=0) -> Column:
    """Result of the first row whose bound the value reaches."""
    chain = None
    for bound, result in table:
        test = value >= F.lit(bound)
        chain = F.when(test, F.lit(result)) if chain is None else chain.when(test, F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def office_group(office: Column) -> Column:
    return (F.when(office.isin(*OFFICE_GROUPS["A"]), "A").when(office.isin(*OFFICE_GROUPS["B"]), "B")
            .otherwise("other"))


def net_bonus_pct(net: Column, group: Column) -> Column:
    return (F.when(group == "A", tier(net, NET_TIERS["A"], 0.0))
            .when(group == "B", tier(net, NET_TIERS["B"], 0.0)).otherwise(F.lit(0.0)))


def volume_bonus_pct(ratio: Column, group: Column) -> Column:
    return F.when((group == "A") & ratio.isNotNull(), tier(ratio, VOLUME_TIERS, 0.0)).otherwise(F.lit(0.0))


def ftd100_multiplier(count: Column) -> Column:
    return tier(count, FTD100_MULTIPLIER)


def target_bonus(count: Column, target: Column) -> Column:
    return F.when((target > 0) & (count >= target), tier(count, TARGET_BONUS)).otherwise(F.lit(0))


def amount_bonus(amount: Column) -> Column:
    """Unknown amounts fall to the top row, as the open-ended CASE of the report does."""
    return F.when(amount.isNull(), F.lit(AMOUNT_BONUS[0][1])).otherwise(tier(amount, AMOUNT_BONUS))


def tenure_months(month: Column, start: Column) -> Column:
    """Whole calendar months from start to the first of the report month, never below zero."""
    months = ((F.year(month) - F.year(start)) * 12 + F.month(month) - F.month(start)
              - F.when(F.dayofmonth(month) < F.dayofmonth(start), 1).otherwise(0))
    return F.greatest(months, F.lit(0))


def net_target(tenure: Column, office: Column, agent: Column, exempt_prefixes=()) -> Column:
    """Ladder by tenure; the general office has none unless the agent's name starts with an exempt prefix."""
    name = F.lower(F.trim(agent))
    general = F.lower(F.trim(office)) == "general"
    for p in exempt_prefixes:
        general = general & ~name.startswith(p.lower())
    return F.when(F.coalesce(general, F.lit(False)), None).otherwise(tier(tenure, NET_LADDER))


def ftd100_target(tenure: Column) -> Column:
    return tier(tenure, FTD100_LADDER)
