"""Change sets, tables kept by them, and views that take in batches of changes."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import frame, rows
from ledgerlight.operators import changes as ch
from ledgerlight.plans import incremental, views
from ledgerlight.schemas import _schema
from ledgerlight.sources import kept, tables
from ledgerlight.streaming import feeds as streams

SMALL = "id:long day:date value:str n:int"


def small(spark, data):
    return spark.createDataFrame(data, _schema(SMALL))


def day(text):
    return datetime.fromisoformat(text).date()


def told(changes):
    return sorted([(r.id, r.op, r.old, r.new) for r in changes.select("id", ch.operation().alias("op"), F.col("before.value").alias("old"), F.col("after.value").alias("new")).collect()], key=repr)


def test_change_set_of_all_kinds(spark):
    d = day("2024-01-05")
    before = small(spark, [(1, d, "a", 1), (2, d, "b", None), (3, None, None, 3), (None, d, "n", 1), (5, d, "e", 1)])
    after = small(spark, [(1, d, "a", 1), (2, d, None, None), (4, d, "d", 4), (None, d, "n", 2), (5, d, "e", 1)])
    assert told(ch.change_set(before, after, ["id"])) == sorted(
        [(2, "update", "b", None), (3, "delete", None, None), (4, "insert", None, "d"), (None, "update", "n", "n")], key=repr)
    assert told(ch.change_set(after, after, ["id"])) == [] and len(told(ch.change_set(before.limit(0), after, ["id"]))) == 5


def test_values_that_move_between_columns_differ(spark):
    """Nulls have a place in the hash: (x, null) is not (null, x)."""
    text = _schema("id:long a:str b:str")
    old, new = spark.createDataFrame([(1, "x", None)], text), spark.createDataFrame([(1, None, "x")], text)
    assert ch.change_set(old, new, ["id"]).count() == 1


def test_applying_twice_changes_nothing(spark):
    d = day("2024-01-05")
    before, after = small(spark, [(1, d, "a", 1), (2, d, "b", 2)]), small(spark, [(2, d, "B", 2), (3, d, "c", 3)])
    changes = ch.change_set(before, after, ["id"])
    once = ch.applied(before, changes, ["id"])
    assert rows(once, "id", "value") == rows(after, "id", "value") == rows(ch.applied(once, changes, ["id"]), "id", "value")
    assert sorted((r.sign, r.id, r.value) for r in ch.signed(changes).collect()) == [(-1, 1, "a"), (-1, 2, "b"), (1, 2, "B"), (1, 3, "c")]


def files(table):
    return {f: os.stat(f).st_ino for f in glob.glob(f"{table.path}/**/*.parquet", recursive=True)}


def table_of(spark, tmp_path):
    return kept.KeptTable(spark, str(tmp_path / "t"), ["id"], _schema(SMALL), "month", lambda c: F.date_format(c("day"), "yyyy-MM"))


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.merged(1, small(spark, [(i, day(f"2024-0{1 + i % 4}-03"), "v", i) for i in range(12)] + [(99, None, "none", 0)]), ["n"])
    assert t.apply(1) == ["2024-01", "2024-02", "2024-03", "2024-04", "none"]
    before = files(t)
    # 1 stays as it is, 2 moves from March to May, 3 (April) goes, 50 is new in January
    delta = small(spark, [(1, day("2024-02-03"), "v", 1), (2, day("2024-05-01"), "moved", 2), (50, day("2024-01-09"), "new", 5)])
    t.merged(2, delta, ["n"], gone=small(spark, [(3, None, None, None), (777, None, None, None)]))
    assert t.apply(2) == ["2024-01", "2024-03", "2024-04", "2024-05"]
    now = files(t)
    assert {f for f in before if f in now} == {f for f in before if "month=2024-02" in f or "month=none" in f}
    ids = {r.id: r.day for r in t.read().collect()}
    assert set(ids) == {*range(12), 50, 99} - {3} and ids[2] == day("2024-05-01")


def test_emptied_partitions_go_and_batches_can_be_run_again(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.merged(1, small(spark, [(1, day("2024-01-01"), "a", 1), (2, day("2024-02-01"), "b", 1)]), ["n"])
    t.apply(1)
    t.merged(2, small(spark, []), ["n"], gone=small(spark, [(2, None, None, None)]))
    again = table_of(spark, tmp_path)      # the job ended between log and table: another process takes it up
    again.merged(2, small(spark, [(5, None, "is not looked at, the batch is logged", 1)]), ["n"])
    assert again.apply(2) == ["2024-02"] and again.apply(2) == ["2024-02"]
    assert rows(again.read(), "id") == [(1,)] and not glob.glob(f"{again.path}/month=2024-02*")


def test_snapshot_sync_reports_deletes_and_refuses_an_empty_one(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "p"), ["id"], _schema(SMALL))
    d = day("2024-01-05")
    assert [x[1] for x in told(t.sync_changes(small(spark, [(1, d, "a", 1), (2, d, "b", 2), (3, d, "c", 3)]), ["n"]))] == ["insert"] * 3
    assert told(t.sync_changes(small(spark, [(2, d, "B", 2), (3, d, "c", 3), (3, d, "c", 1), (4, d, "d", 4)]), ["n"])) == [
        (1, "delete", "a", None), (2, "update", "b", "B"), (4, "insert", None, "d")]
    with pytest.raises(ValueError):
        t.sync_changes(small(spark, []), ["n"])
    assert rows(t.read(), "id") == [(2,), (3,), (4,)]
    assert [x[1] for x in told(t.sync_changes(small(spark, []), ["n"], allow_empty=True))] == ["delete"] * 3


def ledger(seed, ids):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for i in ids:
        at = start + timedelta(hours=rng.randint(0, 24 * 150))
        out.append({"money_id": i, "account_id": rng.choice([1, 2, 3, 4, 5, 6, None]), "approval": rng.choice(["Approved"] * 4 + ["Pending"]),
                    "type": rng.choice(["Deposit", "Deposit", "Withdrawal", "Deposit Cancelled", "Withdrawal Cancelled", "Bonus"]), "owner": rng.choice([10, 11, 12, 13, None]),
                    "ftd": rng.choice([0, 1, None]), "usd": rng.randint(1, 400), "confirmed": at, "created": start + timedelta(days=rng.randint(0, 140)), "deleted": rng.choice([0, None, 0, 1])})
    return out


def accounts(seed):
    rng = random.Random(seed)
    return [{"account_id": i, "is_test": int(rng.random() < 0.2), "account_status": "Sales", "assigned_to": rng.choice([10, 11, None]), "created": datetime(2024, 1, i),
             "qualified": rng.choice([None, datetime(2024, 2, rng.randint(1, 28), 7)])} for i in range(1, 7)]


def typed(spark, name, data, columns):
    from decimal import Decimal
    return frame(spark, name, [{k: Decimal(v) if k == "usd" else v for k, v in r.items()} for r in data]).select(*columns)


def test_views_equal_a_rebuild_after_every_batch(spark, tmp_path):
    """Inserts, updates, deletes and late rows; accounts that are qualified later or turn out to be tests."""
    agents = frame(spark, "agents", [{"agent_id": 10, "agent_name": "A", "dept": "Sales", "team": "Conversion"}, {"agent_id": 11, "agent_name": "B", "dept": "Retention", "department": "x"},
                                     {"agent_id": 12, "agent_name": "Test C"}])
    k = incremental.KeptViews(spark, str(tmp_path / "kept"), agents)
    names = k.money.columns
    everything = {}
    plan = [(ledger(1, range(60)), accounts(1), []), (ledger(2, [*range(0, 30, 2), *range(60, 80)]), accounts(2)[:4], [5, 7, 9]), (ledger(3, [5, 81, 3]), [], [*range(10, 20), 81, 4000])]
    for number, (paid, held, gone) in enumerate(plan, 1):
        money = typed(spark, "money", paid, names)
        ids = spark.createDataFrame([(g,) for g in gone], "money_id long")
        k.batch(number, money, typed(spark, "accounts", held, k.accounts.columns), gone=ids)
        everything |= {r["money_id"]: r for r in paid}
        for g in gone:
            everything.pop(g, None)
        assert rows(k.money.read(), "money_id") == sorted([(i,) for i in everything], key=repr)
        ledgers = k.money.read()
        want = views.daily_kpis(ledgers, k.accounts.read(), agents)
        assert rows(k.kpis.read(), *want.columns) == rows(want, *want.columns)
        rate = views.run_rate_base(want, agents)
        assert rows(k.run_rate.read(), *rate.columns) == rows(rate, *rate.columns)
        second = views.second_deposit_clients(ledgers, k.accounts.read())
        assert rows(k.second.read(), *second.columns) == rows(second, *second.columns)
        totals = streams.daily_totals(ledgers.where("owner IS NOT NULL"))
        assert rows(k.totals.read(), *totals.columns) == rows(totals, *totals.columns)
    # a batch that brings what is there already
    state = {t.path: files(t) for t in k.tables}
    assert k.batch(4, typed(spark, "money", [everything[3]], names), typed(spark, "accounts", [], k.accounts.columns)) == {
        name: [] for name in ("money", "accounts", "days", "kpis", "run_rate", "totals", "second")}
    assert state == {t.path: files(t) for t in k.tables}
