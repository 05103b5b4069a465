"""Registered queries: every operator and report run over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlight.plans import jobs, views
from ledgerlight.sources.driver_tables import Tables

FIRST, LAST, LIVE = "1995-01-01", "2001-07-31", "1999-01-10"

REGISTRY: dict[str, Callable[["Domain"], DataFrame]] = {}


class Domain(Tables):
    """Adapter tables plus the views built on them; everything stays lazy."""

    @cached_property
    def holidays(self) -> DataFrame:
        return jobs.recurring_holidays(self.spark, 1994, 2002)

    @cached_property
    def kpis(self) -> DataFrame:
        return views.daily_kpis(self.money, self.accounts, self.agents)

    @cached_property
    def volume(self) -> DataFrame:
        return views.volume_stats(self.deals, self.positions, self.bridge, self.accounts, self.agents, floor_day=None)

    @cached_property
    def range_kpis(self) -> DataFrame:
        """V1 for reports that tell the last day of FIRST to LAST from the others and no more."""
        return views.daily_kpis(self.money, self.accounts, self.agents, span=(FIRST, LAST))

    @cached_property
    def range_volume(self) -> DataFrame:
        """V2 for the same reports."""
        return views.volume_stats(self.deals, self.positions, self.bridge, self.accounts, self.agents, floor_day=None,
                                  span=(FIRST, LAST))

    @cached_property
    def traders(self) -> DataFrame:
        return views.retention_traders(self.volume)

    @cached_property
    def clients(self) -> DataFrame:
        return jobs.threshold_clients(self.money, self.accounts)

    @cached_property
    def std(self) -> DataFrame:
        return views.second_deposit_clients(self.money, self.accounts)

    @cached_property
    def run_rate(self) -> DataFrame:
        return views.run_rate_base(self.kpis, self.agents)

    @cached_property
    def snapshots(self) -> DataFrame:
        return jobs.equity_snapshots(self.equity, self.bonuses, self.bridge, self.accounts)

    @cached_property
    def resolved(self) -> DataFrame:
        return views.resolved_deals(self.deals)


def query(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Plain output types for comparison: money as double, dates and times as text, counts as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.BooleanType)):
            c = c.cast("bigint") if not isinstance(f.dataType, T.BooleanType) else c.cast("int").cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return flat(REGISTRY[name](Domain(spark, folder)))


def _load() -> None:
    from ledgerlight import catalog_incremental, catalog_operators, catalog_queries, catalog_ranges, catalog_streams  # noqa: F401  register on import


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, folder, n=n: run(n, spark, folder)) for n in REGISTRY}
