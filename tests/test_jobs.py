"""Edge frames of the derivation jobs and views."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import frame, rows, ts
from ledgerlight.plans import bonuses, campaigns, equity, jobs, scoreboards as sb, views
from ledgerlight.operators import filters


def money(spark, data):
    """(account, minute offset, type, usd[, extra])"""
    t0 = ts("2024-03-01 10:00:00")
    return frame(spark, "money", [
        dict(dict(money_id=i, account_id=a, approval="Approved", type=k, usd=Decimal(str(u)), confirmed=t0 + timedelta(minutes=mins), owner=i + 100, deleted=0),
             **(extra[0] if extra else {})) for i, (a, mins, k, u, *extra) in enumerate(data, 1)])


def accounts(spark, data):
    return frame(spark, "accounts", [dict(account_id=a, account_status=s, qualified=q and ts(q), is_test=0, assigned_to=7) for a, s, q in data])


def test_threshold_clients(spark):
    m = money(spark, [
        (1, 0, "Deposit", 94.99), (2, 0, "Deposit", 95),
        (3, 0, "Deposit", 200), (3, 5, "Withdrawal", 150),                                   # Sales: latest total counts
        (4, 0, "Deposit", 200), (4, 200, "Withdrawal", 150),                                 # qualified before the fall
        (5, 0, "Deposit", 50), (5, 30, "Deposit", 50), (5, 300, "Deposit", 1000),            # crossing after qualification
        (6, 0, "Deposit", 500),                                                              # never qualified, not Sales
        (7, 0, "Bonus", 500), (7, 1, "Deposit", 500, dict(deleted=1)), (7, 2, "Deposit", 500, dict(approval="Pending")),
        (8, 0, "Deposit", 60, dict(deleted=None)), (8, 0, "Deposit Cancelled", 10), (8, 0, "Withdrawal Cancelled", 50)])
    a = accounts(spark, [(1, "Sales", None), (2, "Sales", None), (3, "Sales", None), (4, "Retention", "2024-03-01 11:00:00"),
                         (5, "Retention", "2024-03-01 10:10:00"), (6, "Retention", None), (7, "Sales", None), (8, "Sales", None)])
    got = {r.account_id: r for r in jobs.threshold_clients(m, a).collect()}
    assert set(got) == {2, 4, 5, 8}
    assert got[4].reached_amount == 200 and got[4].net_now == 50 and got[4].net_until_qualified == 200
    assert got[5].reached_amount == 100 and got[5].reached_at == datetime(2024, 3, 1, 10, 30) and got[5].net_now == 1100
    assert got[8].reached_amount == 100


def test_second_deposit(spark):
    m = money(spark, [
        (1, 0, "Deposit", 240), (2, 0, "Deposit", 200), (2, 0, "Deposit", 40), (2, 0, "Deposit", 5),      # same moment is not later
        (3, 0, "Deposit", 300), (3, 3, "Withdrawal", 300), (3, 9, "Withdrawal Cancelled", 1), (3, 12, "Deposit", 1), (4, 0, "Deposit", 239.99)])
    a = accounts(spark, [(i, "Sales", None) for i in (1, 2, 3, 4)])
    got = rows(views.second_deposit_clients(m, a), "account_id", "has_second_deposit", "second_deposit_at")
    assert got == [(1, 0, None), (2, 0, None), (3, 1, datetime(2024, 3, 1, 10, 9))]


def test_range_reports_do_not_keep_every_day(spark):
    """R5's figures from views of two days, the last and one for the others, are those from views of all days."""
    first, last, n = "2024-03-01", "2024-03-20", 40
    days = [ts("2024-02-20 23:00:00") + timedelta(days=k) for k in range(n)] + [None]
    m = frame(spark, "money", [
        dict(money_id=k, account_id=a, approval="Approved", type=t, usd=Decimal(k + 1), confirmed=at, owner=o, ftd=k % 2, deleted=0)
        for k, at in enumerate(days) for a, t, o in ((1, "Deposit", 1), (2, "Withdrawal", 2), (2, "Deposit", None)) for _ in range(1 + k % 2)])
    a = frame(spark, "accounts", [
        dict(account_id=i, is_test=0, assigned_to=i, score=7, qualified=q and ts(q)) for i, q in ((1, f"{last} 23:59:59"), (2, None), (3, "2024-03-02 00:00:00"))])
    agents = frame(spark, "agents", [dict(agent_id=1, agent_name="A"), dict(agent_id=2, agent_name="B"), dict(agent_id=2, agent_name="B2")])
    bridge = frame(spark, "bridge", [dict(bridge_id=i, account_id=i % 4, login=str(i), deleted=0) for i in range(1, 7)])
    close = ts("2024-04-30 00:00:00")
    deals = frame(spark, "deals", [
        dict(source="S", login=1 + k % 3, position_id=p, entry=e, open_time=at, close_time=close, notional=Decimal(10 * k - 50))
        for k, at in enumerate(days) for p, e in ((None, 0), (k % 5, 0), (k % 5, 1), (k % 2, 0))])
    positions = frame(spark, "positions", [
        dict(position_id=k, login=4 + k % 2, open_time=at, notional=Decimal(v)) for k, at in enumerate(days) for v in ((0, 5) if k % 3 else (-1,))])

    def both(make):
        full, short = make(), make(span=(first, last))
        assert full.count() > 2 * short.count() and set(full.columns) == set(short.columns)
        return full, short

    full, short = both(lambda **k: views.daily_kpis(m, a, agents, **k))
    want = sb.kpi_measures(full, first, last)
    assert rows(sb.kpi_measures(short, first, last), *want.columns) == rows(want, *want.columns)
    for first_entry_only in (False, True):
        full, short = both(lambda **k: views.volume_stats(deals, positions, bridge, a, agents, None, first_entry_only, **k))
        assert {r.open_date.isoformat() for r in short.collect()} == {first, last}
        want = sb.trading_activity(full, a, first, last, last)
        assert want.where("traded").count() and want.where("today").count()
        assert rows(sb.trading_activity(short, a, first, last, last), *want.columns) == rows(want, *want.columns)


def test_daily_kpis_counts(spark):
    ftd = dict(ftd=1, owner=1)
    m = money(spark, [(1, 0, "Deposit", 10, ftd), (1, 5, "Deposit", 10, ftd), (1, 1500, "Deposit", 10, ftd), (2, 0, "Withdrawal", 4, dict(owner=1, ftd=1)),
                      (2, 0, "Deposit", 1, dict(owner=2)), (2, 1, "Deposit", 1, dict(owner=None))])
    agents = frame(spark, "agents", [dict(agent_id=1, agent_name="A"), dict(agent_id=2, agent_name=" test me")])
    a = accounts(spark, [(1, "Sales", "2024-03-09"), (2, "Sales", None)])
    got = rows(views.daily_kpis(m, a, agents).select("agent_id", F.col("tx_date").cast("string").alias("d"), "net_usd", "ftd_count", "ftc_count"),
               "agent_id", "d", "net_usd", "ftd_count", "ftc_count")
    assert got == [(1, "2024-03-01", Decimal("-4.0000"), 0, 0), (1, "2024-03-01", Decimal("20.0000"), 2, 1),
                   (1, "2024-03-02", Decimal("10.0000"), 1, 1), (None, "2024-03-01", Decimal("1.0000"), 0, 0)]


def deal(ticket, position, entry, at, notional, source="S", login=1, close="2024-02-01"):
    return dict(ticket=ticket, position_id=position, entry=entry, open_time=ts(at), close_time=ts(close), notional=Decimal(notional), source=source, login=login)


def test_deal_matching(spark):
    d = frame(spark, "deals", [
        deal(1, 1, 0, "2024-01-01", 5), deal(2, 1, 1, "2024-01-03", 100), deal(3, 2, 0, "2024-01-01", 5),           # entry without exit
        deal(4, 3, 0, "2024-01-01", 5), deal(5, 3, 0, "2024-01-02", 5), deal(6, 3, 1, "2024-01-05", 10),            # two entries
        deal(7, 1, 1, "2024-01-03", 7, source="T"),                                                                # same id, other source
        deal(8, 4, 0, "2024-01-01", 5), deal(9, 4, 1, "2024-01-05", 50, close="1970-01-01")])                       # still open
    got = rows(views.resolved_deals(d).select(F.col("open_time").cast("date").cast("string").alias("d"), "notional", "pairs"), "d", "notional", "pairs")
    assert got == [("2024-01-01", Decimal("110.0000"), 2), ("2024-01-02", Decimal("10.0000"), 1)]
    first = rows(views.resolved_deals(d, first_entry_only=True).select(F.col("open_time").cast("date").cast("string").alias("d"), "notional", "pairs"), "d", "notional", "pairs")
    assert first == [("2024-01-01", Decimal("110.0000"), 2)]


def test_a_huge_position_makes_no_pairs(spark):
    """3,000 entries and 3,000 exits of one position are nine million pairs, but only four thousand rows here."""
    base = spark.range(6000).select(
        F.col("id").alias("ticket"), F.lit("S").alias("source"), F.lit(1).cast("long").alias("login"), F.lit(9).cast("long").alias("position_id"),
        (F.col("id") % 2).cast("int").alias("entry"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(cast(id % 10 as int))")).alias("open_time"),
        F.lit("2024-02-01").cast("timestamp_ntz").alias("close_time"), F.lit(2).cast("decimal(20,4)").alias("notional"))
    got = views.resolved_deals(base).agg(F.sum("pairs"), F.sum("notional")).first()
    assert tuple(got) == (9_000_000, Decimal("18000000.0000"))


def eq(login, at, balance, floating, source="S"):
    return dict(login=login, at=ts(at), balance=balance and Decimal(balance), floating=floating and Decimal(floating), source=source)


@pytest.fixture()
def platform(spark):
    e = frame(spark, "equity", [
        eq(1, "2024-01-01 10:00", "100", "-100"), eq(1, "2024-01-01 20:00", "100", "-20"), eq(1, "2024-01-02 20:00", "100", "-150"),
        eq(2, "2024-01-01 20:00", "100", "0"), eq(2, "2024-01-03 20:00", "100", None), eq(3, "2024-01-01 20:00", "50", "0"), eq(4, "2024-01-01 20:00", "9", "1")])
    b = frame(spark, "bonuses", [dict(money_id=i, login=x, amount=Decimal(a), confirmed=ts(at)) for i, (x, a, at) in enumerate([
        (1, "30", "2023-12-01"), (2, "500", "2024-01-01 23:59:59"), (2, "-450", "2024-01-02"), (3, "-10", "2024-01-01")])])
    bridge = frame(spark, "bridge", [dict(bridge_id=i, login=str(x), account_id=a, deleted=0) for i, (x, a) in enumerate([(1, 1), (1, 2), (2, 2), (3, 2), (4, 2), (4, 9)])]
                   + [dict(bridge_id=99, login="n/a", account_id=1)])
    a = frame(spark, "accounts", [dict(account_id=1, is_test=0), dict(account_id=2, is_test=0), dict(account_id=9, is_test=1)])
    return e, b, bridge, a


def test_snapshots(spark, platform):
    got = rows(jobs.equity_snapshots(*platform).select("login", F.col("day").cast("string").alias("d"), "end_eez", "start_eez"), "login", "d", "end_eez", "start_eez")
    d = Decimal
    assert got == [(1, "2024-01-01", d("50.00"), None), (1, "2024-01-02", d("0.00"), d("50.00")), (2, "2024-01-01", d("0.00"), None),
                   (2, "2024-01-03", d("50.00"), None), (3, "2024-01-01", d("60.00"), None)]         # a negative bonus adds; login 4 has a test account
    clamped = rows(jobs.equity_snapshots(*platform, clamp_bonus=True).where("login = 3"), "end_eez")
    assert clamped == [(d("50.00"),)]


def test_snapshots_of_a_range_equal_the_whole(spark, platform):
    whole = jobs.equity_snapshots(*platform).where("day >= '2024-01-02'")
    part = jobs.equity_snapshots(*platform, first="2024-01-02", last="2024-01-03")
    cols = ("login", "day", "end_eez", "start_eez")
    assert rows(whole, *cols) == rows(part, *cols)


def test_repair_drops_corrupt_rows(spark, platform):
    e, b, bridge, a = platform
    bad = e.unionByName(frame(spark, "equity", [eq(3, "2024-01-01 22:00", "50", "100000000")]))
    got = rows(jobs.repair_snapshots(bad, b, bridge, a, "2024-01-01").where("login = 3"), "end_eez")
    assert got == [(Decimal("60.00"),)]


def test_duplicate_bridge_rows_count_once_unless_asked(spark, platform):
    e, b, bridge, a = platform
    snaps = jobs.equity_snapshots(e, b, bridge, a)
    once = equity.historical_total(e, b, bridge, a, snaps, "2024-01-01").first().total_eez
    again = equity.historical_total(e, b, bridge, a, snaps, "2024-01-01", once=False).first().total_eez
    assert (once, again) == (Decimal("120.0000"), Decimal("170.0000"))


def test_target_jobs(spark):
    master = frame(spark, "agents_master", [
        dict(agent_name="A", office_name="Cyprus", email=" A@x.example", start_date=date(2024, 1, 15), is_active=True),
        dict(agent_name="B", office_name="general", email="b@x.example", start_date=date(2024, 3, 31), agent_id=2, is_active=False),
        dict(agent_name="C", office_name="Cyprus", email="c@x.example", start_date=date(2025, 1, 1), is_active=True),
        dict(agent_name="D", office_name="Cyprus", email="d@x.example", is_active=True)])
    agents = frame(spark, "agents", [dict(agent_id=1, email="a@X.example ")])
    history = jobs.backfill_targets(master, agents, None, "2024-03-31")
    got = rows(history.select("agent_name", "agent_id", F.month("report_month").alias("mon"), "tenure_months", "net_target", "ftd100_target"),
               "agent_name", "agent_id", "mon", "tenure_months", "net_target", "ftd100_target")
    assert got == [("A", 1, 1, 0, 0, 0), ("A", 1, 2, 0, 0, 0), ("A", 1, 3, 1, 0, 5), ("B", 2, 3, 0, None, 0)]
    kept = history.withColumn("net_target", F.lit(-1))
    april = jobs.append_month(master, agents, kept, "2024-04-02")
    assert april.where("net_target = -1").count() == 4                                # existing rows stay
    assert rows(april.where("month(report_month) = 4"), "agent_name", "tenure_months") == [("A", 2)]
    assert rows(jobs.unmatched_agents(master), "agent_name") == [("A",), ("C",), ("D",)]


def test_new_members(spark):
    members = spark.createDataFrame([(1, "a@x", "A", "agent", True)], "agent_id long, email string, full_name string, role string, is_active boolean")
    agents = frame(spark, "agents", [dict(agent_id=1, status="Inactive", email="a@x"), dict(agent_id=2, status="Active", email=" "), dict(agent_id=3, status="Active", email="a@x")])
    assert rows(jobs.new_members(members, agents), "agent_id", "email", "full_name", "is_active") == [(1, "a@x", "A", False), (2, "2@agent.local", "2", True)]


def test_typing_uses_one_note_per_ticket(spark):
    m = frame(spark, "money", [dict(money_id=1, raw_type="Deposit", method="Bonus", created=ts("2024-01-01"), order_ref="77.", type="old")])
    ops = frame(spark, "balance_ops", [dict(ticket=77, source="A", cmd=6, comment="Bonus"), dict(ticket=77, source="B", cmd=6, comment="Bonus"), dict(ticket=77, cmd=0, comment="zzz")])
    assert rows(jobs.typed_money(m, ops), "money_id", "type") == [(1, "Bonus")]
    assert rows(jobs.typed_money(m, ops, only=F.lit(False)), "type") == [("old",)]


def test_company_gap(spark):
    data = spark.createDataFrame([(1, "X", "N", "Sales", 0, 10, 0)], "agent_id long, office_name string, agent_name string, dept string, ftc long, target_ftc long, ftd100 long")
    for company, extra in ((25, [(15,)]), (10, []), (None, [])):
        ct = frame(spark, "company_targets", [dict(month=date(2024, 3, 1), sales_ftc=company and Decimal(company))])
        out = sb.company_gap(data.withColumn("status", F.lit("Active")), ct, "2024-03-05")
        assert rows(out.where("agent_name = 'General'"), "target_ftc") == extra


def test_roles(spark):
    agents = frame(spark, "agents", [dict(agent_id=1, dept="Retention", office="CY"), dict(agent_id=2, dept="Sales", office="SA"), dict(agent_id=3, dept="Retention", office="BG", department="BG Team 1")])
    seen = {r: rows(agents.where(filters.access(r)), "agent_id") for r in ("admin", "retention_all", "sales_sa", "retention_bg_team1", "nobody")}
    assert seen == {"admin": [(1,), (2,), (3,)], "retention_all": [(1,), (3,)], "sales_sa": [(2,)], "retention_bg_team1": [(3,)], "nobody": []}
    assert rows(agents.where(filters.access("agent", agent_id=2)), "agent_id") == [(2,)]
    assert rows(agents.where(filters.access("sales_sa", ["retention_cy"])), "agent_id") == [(1,), (2,)]


def test_search_and_options(spark):
    df = spark.createDataFrame([(12, "Anna"), (3, None), (4, " ")], "account_id int, agent_name string")
    assert rows(filters.search(df, " AN ", ["account_id", "agent_name"]), "account_id") == [(12,)]
    assert rows(filters.search(df, "2", ["account_id", "agent_name"]), "account_id") == [(12,)]
    assert filters.search(df, "  ", ["account_id"]).count() == 3
    assert rows(filters.options(df, "agent_name"), "value") == [("Anna",)]


def test_unknown_group_is_refused(spark):
    a, c, g = (frame(spark, n, []) for n in ("accounts", "campaigns", "agents"))
    with pytest.raises(KeyError):
        campaigns.Dims(a, c, g, "2024-01-01", ("password",)).prepared()


def test_first_ftd_tie_break(spark):
    m = money(spark, [(1, 5, "Deposit", 1, dict(ftd=1)), (1, 0, "Deposit", 1, dict(ftd=1)), (1, 0, "Deposit", 1, dict(ftd=1)), (2, 0, "Deposit", 1, dict(ftd=0))])
    assert rows(bonuses.first_ftd(m), "account_id", "ftd_owner") == [(1, 102)]
