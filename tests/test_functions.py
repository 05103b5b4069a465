from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import buckets as b, calendar as cal, clean, money as m, tiers, typing
from ledgerlight.functions.numeric import round_even
from ledgerlight.plans import jobs


def one(spark, *columns, **values):
    base = spark.range(1)
    for k, v in values.items():
        base = base.withColumn(k, v if hasattr(v, "alias") else F.lit(v))
    return base.select(*columns).first()


@pytest.mark.parametrize("birth,on,years", [
    (date(2000, 5, 10), "2024-05-10", 24), (date(2000, 5, 10), "2024-05-09", 23), (date(2000, 2, 29), "2026-02-28", 25),
    (date(2000, 2, 29), "2026-03-01", 26), (date(2010, 1, 1), "2024-01-01", 14), (None, "2024-01-01", None)])
def test_age_years(spark, birth, on, years):
    assert one(spark, b.age_years(F.lit(birth).cast("date"), on))[0] == years


@pytest.mark.parametrize("days,label,sort", [
    (0, "0 - 7 days", 1), (7, "0 - 7 days", 1), (8, "8 - 14 days", 2), (120, "91 - 120 days", 6), (121, "120+ days", 7), (-1, "(Unknown)", 99)])
def test_aging(spark, days, label, sort):
    q = F.date_sub(F.lit("2024-06-30").cast("date"), days).cast("timestamp_ntz")
    assert tuple(one(spark, b.aging_bucket(q, "2024-06-30"), b.aging_sort(q, "2024-06-30"))) == (label, sort)


def test_aging_of_missing_date(spark):
    q = F.lit(None).cast("timestamp_ntz")
    assert tuple(one(spark, b.aging_bucket(q, "2024-06-30"), b.aging_sort(q, "2024-06-30"))) == ("(Unknown)", 99)


def test_aging_filter_all_or_none_means_no_filter():
    assert b.aging_filter(F.col("q"), "2024-01-01", []) is None
    assert b.aging_filter(F.col("q"), "2024-01-01", [r[2] for r in b.AGING]) is None


def test_scores(spark):
    texts = ["7.6", " 3 ", "abc", None, "0", "11", "10.4", "-1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(clean.score_1_to_10(F.col("t")), clean.score_1_to_10(F.col("t"), True)).collect()
    assert [tuple(r) for r in got] == [(7, 8), (3, 3), (None, None), (None, None), (None, None), (None, None), (10, 10), (None, None)]


def test_under_25_scores_differ_by_use(spark):
    birth = F.lit(date(2004, 1, 1))
    assert tuple(one(spark, b.score_or_age(F.lit(None).cast("int"), birth, "2024-06-01"), b.score_by_age(birth, "2024-06-01"))) == (None, 3)


@pytest.mark.parametrize("text,ticket", [("123", 123), ("123.", 123), ("123.7", 124), ("abc", None), (None, None), ("12a", None), ("", None)])
def test_order_ticket(spark, text, ticket):
    assert one(spark, clean.order_ticket(F.lit(text).cast("string")))[0] == ticket


def test_local_times(spark):
    def utc(text):
        return one(spark, clean.to_utc(F.lit(text).cast("timestamp_ntz"), "EET"))[0]
    assert utc("2026-01-10 12:00:00") == datetime(2026, 1, 10, 10)
    assert utc("2026-07-10 12:00:00") == datetime(2026, 7, 10, 9)
    assert utc("2000-10-29 03:30:00") == datetime(2000, 10, 29, 1, 30)   # happens twice: the later one
    sentinel = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    assert one(spark, clean.shift_stored(sentinel))[0] == datetime(1970, 1, 1)


def test_cleaning(spark):
    df = spark.createDataFrame([("a\x00b", float("nan"), "12.0"), ("", 1.5, "x")], "s string, d double, n string")
    got = df.select(clean.text(F.col("s")), clean.finite(F.col("d")), clean.whole_number(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("ab", None, 12), (None, 1.5, None)]


def test_apply_schema_adds_missing_columns_and_caps(spark):
    from ledgerlight.schemas import _schema
    df = spark.createDataFrame([("12.0", "long text", "bad")], "id string, name string, usd string")
    out = clean.apply_schema(df, _schema("id:long name:str usd:usd extra:date"), {"name": 4})
    assert out.first().asDict() == {"id": 12, "name": "long", "usd": None, "extra": None}


def test_reject_keeps_unknown_out_of_neither_side(spark):
    df = spark.createDataFrame([(1.0,), (2e8,), (None,)], "v double")
    kept, bad = clean.reject(df, clean.plausible(F.col("v")))
    assert kept.count() == 2 and bad.count() == 1


CASES = {
    r: dict(kind=r.kind.rstrip("*") + ("al" if r.kind.endswith("*") else ""), method=(r.methods or (None,))[0],
            subtype=(r.subtypes or (None,))[0],
            created=r.until or r.since or ("2022-01-01" if r.before else "2024-01-01"),
            note=(r.comments or [c for c in r.contains] or [p.replace("%", "x") for p in r.like] or (None,))[0])
    for r in typing.RULES}


@pytest.mark.parametrize("rule", typing.RULES, ids=lambda r: f"{r.label}-{r.kind}-{'/'.join(r.methods)[:20]}")
def test_each_typing_rule_can_win(spark, rule):
    case = CASES[rule]
    df = spark.range(1).select(
        F.lit(case["kind"].replace("Withdrawal", "Withdrawal")).alias("raw_type"), F.lit(case["method"]).cast("string").alias("method"),
        F.lit(case["subtype"]).cast("string").alias("subtype"), F.lit(case["created"]).cast("timestamp_ntz").alias("created"),
        F.lit(case["note"]).cast("string").alias("op_comment"))
    assert df.select(typing.classify()).first()[0] == rule.label


@pytest.mark.parametrize("values,label", [
    (("Deposit", "Voucher", None, "2024-01-01", None), "Not Set"), ((None, "Wire", None, "2024-01-01", None), "Not Set"),
    (("Deposit", "Adjustment", "IB Commission", "2023-01-01", None), "IB Commission"),
    (("Deposit", "Adjustment", "IB Commission", "2023-01-02", None), "Positive Trading Adjustment"),
    (("Withdraw", "Wire", None, None, None), "Withdrawal"), (("Credit In", None, None, None, "CASH ADVANCE"), "Credit In Advance"),
    (("Deposit", "FRF commission", None, "2022-12-05", "FRF PayOut Void"), "FRF Commission PayOutCancelled")])
def test_typing_edges(spark, values, label):
    names = ("raw_type", "method", "subtype", "created", "op_comment")
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).withColumn("created", F.col("created").cast("timestamp_ntz"))
    assert df.select(typing.classify()).first()[0] == label


@pytest.mark.parametrize("net,a,bb", [(199999, 0.0375, 0.035), (200000, 0.04, 0.035), (19999.99, 0.0, 0.01), (20000, 0.015, 0.015), (9999, 0.0, 0.0), (100000, 0.035, 0.035)])
def test_net_tiers(spark, net, a, bb):
    got = one(spark, tiers.net_bonus_pct(F.lit(float(net)), F.lit("A")), tiers.net_bonus_pct(F.lit(float(net)), F.lit("B")),
              tiers.net_bonus_pct(F.lit(float(net)), F.lit("other")))
    assert tuple(got) == (a, bb, 0.0)


@pytest.mark.parametrize("count,multiplier,bonus", [(4, 0, 0), (5, 15, 100), (9, 15, 100), (10, 20, 100), (47, 60, 500), (48, 65, 500), (60, 65, 1500)])
def test_count_tiers(spark, count, multiplier, bonus):
    got = one(spark, tiers.ftd100_multiplier(F.lit(count)), tiers.target_bonus(F.lit(count), F.lit(1)), tiers.target_bonus(F.lit(count), F.lit(0)))
    assert tuple(got) == (multiplier, bonus, 0)


@pytest.mark.parametrize("amount,bonus", [(499.99, 0), (500, 10), (999, 10), (1000, 20), (5000, 50)])
def test_amount_bonus(spark, amount, bonus):
    assert one(spark, tiers.amount_bonus(F.lit(Decimal(str(amount)))))[0] == bonus


@pytest.mark.parametrize("start,month,tenure", [
    (date(2024, 3, 1), date(2024, 3, 1), 0), (date(2024, 3, 15), date(2024, 3, 1), 0), (date(2024, 1, 31), date(2024, 3, 1), 1), (date(2023, 3, 1), date(2024, 3, 1), 12)])
def test_tenure(spark, start, month, tenure):
    assert one(spark, tiers.tenure_months(F.lit(month), F.lit(start)))[0] == tenure


def test_ladders(spark):
    df = spark.range(0, 11).select(F.col("id").cast("int").alias("t"))
    got = df.select(tiers.net_target(F.col("t"), F.lit("Cyprus"), F.lit("x")), tiers.ftd100_target(F.col("t"))).collect()
    assert [tuple(r) for r in got] == list(zip([0, 0, 10000, 20000, 30000, 40000, 55000, 75000, 85000, 100000, 100000],
                                               [0, 5, 10, 15, 20, 25, 30, 35, 35, 35, 35]))
    general = one(spark, tiers.net_target(F.lit(5), F.lit(" General "), F.lit("Ann B")), tiers.net_target(F.lit(5), F.lit("General"), F.lit("Ann B"), ("ann",)))
    assert tuple(general) == (None, 40000)


@pytest.mark.parametrize("first,last,days", [
    ("2024-06-01", "2024-06-30", 20), ("2024-06-30", "2024-06-30", 0), ("2024-06-10", "2024-06-01", 0), ("2024-12-23", "2024-12-31", 3)])
def test_working_days(spark, first, last, days):
    holidays = jobs.recurring_holidays(spark, 2024, 2024)
    assert spark.range(1).select(cal.working_days(first, last, holidays)).first()[0] == days


def test_run_rate_without_a_passed_day(spark):
    assert one(spark, cal.run_rate(F.lit(10), F.lit(0), F.lit(20)))[0] == 200


def test_progress_of_a_partial_month(spark):
    holidays = jobs.recurring_holidays(spark, 2024, 2024)
    row = spark.range(1).select(*[c.alias(n) for n, c in cal.progress("2024-06-10", "2024-06-14", "2024-06-12", holidays).items()]).first()
    assert (row.working_days, row.working_days_passed, row.wd_in_range, row.target_ratio) == (15, 3, 5, 0.25)


def test_quarters():
    assert [str(x) for x in cal.quarter_bounds(2024, 4)] == ["2024-10-01", "2024-12-31", "2025-01-01"]


@pytest.mark.parametrize("value,places,rounded", [(0.5, 0, 0.0), (1.5, 0, 2.0), (2.5, 0, 2.0), (4313.645, 2, 4313.65), (-34.825, 2, -34.83)])
def test_round_even_uses_the_stored_value(spark, value, places, rounded):
    assert one(spark, round_even(F.lit(value), places))[0] == rounded == round(value, places)


def test_assignment_rules(spark):
    df = spark.createDataFrame([(0, 5, 9, 7, 8), (0, 0, 9, 7, 8), (1, 5, 9, 7, 8), (1, 5, 9, 0, 8), (None, 5, 9, 7, 8)],
                               "a int, rep int, desk int, rep2 int, desk2 int")
    got = df.select(m.assigned_agent("a", "rep", "desk", "rep2", "desk2"), m.deposit_owner("a", "rep", "rep2")).collect()
    assert [tuple(r) for r in got] == [(5, 5), (9, 7), (7, 7), (8, 0), (8, 5)]


def test_decoding(spark):
    offices = [("SA", "South Africa"), (" ", "General"), (None, "General"), ("XX", "XX"), ("Global", "General")]
    df = spark.createDataFrame([(o,) for o, _ in offices], "o string")
    assert [r[0] for r in df.select(m.office_name(F.col("o"))).collect()] == [n for _, n in offices]
    channels = [("My IB PPC", "IB"), ("Social Media", "Media"), ("GMT desk", "White Label"), ("x", "Other"), (None, "Other")]
    df = spark.createDataFrame([(c,) for c, _ in channels], "c string")
    assert [r[0] for r in df.select(m.marketing_group(F.col("c"))).collect()] == [g for _, g in channels]
    assert tuple(one(spark, *[m.desk_part(F.lit("Conversion - Berlin - Team 1"), i) for i in (1, 2, -1)])) == ("Conversion", " Berlin ", "Team 1")


def test_agent_names(spark):
    df = spark.createDataFrame([(" test x", "A"), ("Duplicated A", "A"), (None, "TESTER"), ("A", " Test"), (None, None), ("Contest", "B")],
                               "agent_name string, full_name string")
    assert [r[0] for r in df.select(m.countable_agent()).collect()] == [False, False, False, False, True, True]
