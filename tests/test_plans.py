"""Plan properties: no Python, no pair products, pruned and filtered scans, limits before shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import plan
from ledgerlight import catalog
from ledgerlight.catalog import Domain
from ledgerlight.plans import views

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if not n.startswith(("I1_", "I4_", "I5_", "I6_"))))
def test_no_python_and_no_products(spark, name):
    text = plan(catalog.queries()[name](spark, FOLDER))
    assert "Python" not in text and "ArrowEval" not in text
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_ledger_is_reduced_before_it_meets_the_accounts(spark):
    text = plan(Domain(spark, FOLDER).kpis)
    join = text.index("Join [account_id")
    assert "HashAggregate(keys=[account_id" in text[join:]


def test_scans_read_only_what_they_need(spark):
    d = Domain(spark, FOLDER)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(d.deals.groupBy("entry").agg(F.sum("notional"))))
    assert schemas and all("l_tax" not in s and "l_shipdate" not in s for s in schemas)


def test_day_ranges_reach_the_scan(spark, tmp_path, capsys):
    """On stored tables the bounds are plain comparisons, so they are pushed to the files."""
    from ledgerlight.functions import money as m
    path = str(tmp_path / "money")
    Domain(spark, FOLDER).money.write.parquet(path)
    spark.read.parquet(path).where(m.between_days("confirmed", "1998-01-01", "1998-01-31")).select("usd").explain("formatted")
    text = capsys.readouterr().out
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)[1]
    assert "GreaterThanOrEqual(confirmed" in pushed and "LessThan(confirmed" in pushed


def test_deal_matching_joins_aggregates(spark):
    d = Domain(spark, FOLDER)
    text = plan(views.resolved_deals(d.deals))
    join = text.index("Join [position_id")
    assert text[join:].count("HashAggregate(keys=[position_id") >= 4      # partial and final on both sides


def test_traded_notional_is_added_up_once(spark):
    """Positions and closed deals share one table of sums by login and day; the deals are reduced by position before it."""
    d = Domain(spark, FOLDER)
    assert plan(views.traded_notional(d.deals, d.positions, None)).count("HashAggregate(keys=[login") == 2   # partial and final


def test_crossings_of_second_deposits_are_computed_once(spark):
    """All three reads of the crossings end in the same aggregate, so that Spark shares its exchange."""
    d = Domain(spark, FOLDER)
    text = plan(views.second_deposit_clients(d.money, d.accounts).drop("second_deposit_at"))
    assert "HashAggregate(keys=[account_id" in text and not re.search(r"keys=\[account_id#\d+L\], functions=\[\]", text)


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(Domain(spark, FOLDER).money.orderBy(F.desc("usd"), "money_id").limit(5))


def test_bucketed_deals_are_matched_without_a_shuffle(spark, tmp_path):
    from ledgerlight.operators import deals as dl
    from ledgerlight.sources import tables
    d = Domain(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = tables.save_bucketed(d.deals, "deals_by_position", str(tmp_path / "deals"), dl.MATCH, 4)
        text = plan(views.resolved_deals(stored))
        above_join, below = text.split("Join [position_id", 1)
        assert "Exchange" in above_join and "Exchange" not in below       # only the final sums by login move
        cols = ("login", "open_time", "notional", "pairs")
        assert sorted(map(str, views.resolved_deals(stored).select(*cols).collect())) == sorted(map(str, d.resolved.select(*cols).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS deals_by_position")
