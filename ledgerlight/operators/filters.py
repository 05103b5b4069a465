"""Report filters as lists of columns: attribute filters, row-level access, text search, option lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import buckets as b

FULL_ACCESS = ("admin", "general", "marketing")

# Role -> required (dept, office, department).
ROLES = {
    "retention_all": ("Retention", None, None), "sales_all": ("Sales", None, None),
    "retention_gmt": ("Retention", "GMT", None), "retention_cy": ("Retention", "CY", None),
    "retention_abj_ng": ("Retention", "ABJ-NG", None), "retention_lag_ng": ("Retention", "LAG-NG", None),
    "retention_sa": ("Retention", "SA", None),
    "retention_bg_team1": ("Retention", "BG", "BG Team 1"), "retention_bg_team2": ("Retention", "BG", "BG Team 2"),
    "retention_bg_team3": ("Retention", "BG", "BG Team 3"),
    "retention_abj_ng_team1": ("Retention", "ABJ-NG", "NG Team 1"),
    "retention_abj_ng_team2": ("Retention", "ABJ-NG", "NG Team 2"),
    "retention_abj_ng_team3": ("Retention", "ABJ-NG", "NG Team 3"),
    "sales_gmt": ("Sales", "GMT", None), "sales_lag_ng": ("Sales", "LAG-NG", None),
    "sales_abj_ng": ("Sales", "ABJ-NG", None), "sales_sa": ("Sales", "SA", None), "sales_bg": ("Sales", "BG", None),
}


def all_of(tests: list[Column | None]) -> Column:
    kept = [t for t in tests if t is not None]
    return reduce(lambda x, y: x & y, kept) if kept else F.lit(True)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests) if tests else F.lit(False)


def access(role: str, extra_roles=(), agent_id: int | None = None) -> Column:
    """Rows of the agent dimension a user may see; an unknown role sees none."""
    if role in FULL_ACCESS:
        return F.lit(True)
    if role == "agent" and not extra_roles:
        return F.col("agent_id") == F.lit(agent_id)
    granted = [ROLES[r] for r in (role, *extra_roles) if r in ROLES]
    return any_of([
        all_of([F.col(c) == v for c, v in zip(("dept", "office", "department"), need) if v is not None])
        for need in granted])


# filter name -> (dimension it needs, column)
ATTRIBUTES = {
    "marketing_group": ("campaign", "marketing_group"), "legacy_id": ("campaign", "legacy_id"),
    "campaign_name": ("campaign", "name"), "channel": ("campaign", "channel"),
    "sub_channel": ("campaign", "sub_channel"), "affiliate": ("account", "affiliate"),
    "country": ("account", "country"), "office": ("agent", "office_name"), "agent": ("agent", "agent_name"),
    "team": ("agent", "desk_name"),
}


def attribute_filter(chosen: dict, as_of_day: str) -> tuple[Column, set[str]]:
    """(predicate, dimensions it needs) for a set of chosen report filters.

    Lists become IN, `quality` a score band, `aging` a set of buckets, `qualified` an inclusive day range and
    `segment` a segment label.
    """
    tests, needs = [], set()
    for name, values in chosen.items():
        if not values:
            continue
        if name in ATTRIBUTES:
            dim, column = ATTRIBUTES[name]
            tests.append(F.col(column).isin(*([values] if isinstance(values, str) else list(values))))
            needs.add(dim)
        elif name == "quality":
            band = {"High Quality": "high", "Low Quality": "low"}.get(values, "none")
            tests.append(b.score_filter(F.col("score"), bands=[band]))
        elif name == "aging":
            ranged = b.aging_filter(F.col("qualified"), as_of_day, values)
            if ranged is not None:
                tests += [F.col("qualified").isNotNull(), ranged]
        elif name == "qualified":
            first, last = values
            tests.append((F.col("qualified") >= F.lit(first).cast("timestamp_ntz"))
                         & (F.col("qualified") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))
        elif name == "segment":
            tests.append(b.segment_label(F.col("segment"), F.col("score"), F.col("birth_date"), as_of_day)
                         == values)
        else:
            raise KeyError(f"unknown filter {name}")
    return all_of(tests), needs - {"account"}


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns, in any case; blank text keeps all."""
    needle = text.strip().lower()
    if not needle:
        return df
    return df.where(any_of([F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle)
                            for c in columns]))


def options(df: DataFrame, column: str) -> DataFrame:
    """All distinct non-blank values of a filter list; a caller that pages orders and limits them."""
    return (df.select(F.col(column).cast("string").alias("value"))
            .where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct())
