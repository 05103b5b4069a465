from datetime import date

from pyspark.sql import functions as F

from helpers import rows, ts
from ledgerlight.operators import compare
from ledgerlight.plans import quality as q
from ledgerlight.schemas import _schema


def test_tolerance(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (100.0, 101.0), (100.0, 101.1), (None, 1.0)], "e double, a double")
    got = q.unfold(df, "R", "S", [q.equal("c", F.col("e"), F.col("e"), F.col("a"), 0.01)])
    assert [r.status for r in got.collect()] == ["PASS", "FAIL", "PASS", "FAIL", "FAIL"]
    assert got.columns == q.COLUMNS


def test_flags(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("N/A", -1.0, 0.0), (None, float("nan"), 1.0), ("b", float("inf"), None)], "n string, x double, y double")
    got = q.unfold(df, "R", "S", [q.labelled("l", F.col("n"), F.col("n")), q.not_negative("p", F.col("n"), F.col("x")), q.at_most("o", F.col("n"), F.col("x"), F.col("y"))])
    assert rows(got.where("check_name = 'l'"), "status") == [("PASS",), ("PASS",), ("WARN",), ("WARN",)]
    assert rows(got.where("check_name = 'p'"), "status") == [("FAIL",), ("FAIL",), ("FAIL",), ("PASS",)]


def test_per_agent(spark):
    left = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 0.4), (4, 50.0)], "agent long, v double")
    right = spark.createDataFrame([(1, 101.0), (2, 102.0), (3, 0.9), (5, 50.0)], "agent long, v double")
    got = rows(compare.reconcile(left, right, "agent", "v"), "agent", "matches")
    assert got == [(1, True), (2, False), (4, False), (5, False)]
    out = q.per_agent(left, right, "agent", "v", k=2)
    assert rows(out.where("check_name = 'v_mismatch'"), "context") == [("4",), ("5",)]
    assert rows(out.where("check_name = 'v_summary'"), "status", "message") == [("FAIL", "1 of 4 agents match")]


def test_score_history_and_freshness(spark):
    results = q.unfold(spark.createDataFrame([("PASS",), ("PASS",), ("FAIL",), ("WARN",)], "s string"), "R", "S",
                       [q.result("c", F.col("s"), F.col("s"), F.lit("m"))])
    assert q.score(results).first().score == 66.67
    assert q.sections(results).first().status == "FAIL"
    history = spark.createDataFrame([], _schema("day:date total:long pass:long warn:long fail:long error:long score:dbl"))
    once = q.keep_history(history, results, "2024-01-01")
    again = q.keep_history(q.keep_history(once, results, "2024-01-01"), results.where("status <> 'FAIL'"), "2024-01-02")
    assert rows(q.trend(again), "day", "score", "change") == [(date(2024, 1, 1), 66.67, None), (date(2024, 1, 2), 100.0, 33.33)]
    log = spark.createDataFrame([("a", ts("2024-01-01 10:00:00")), ("b", ts("2024-01-01 01:00:00"))], "table_name string, ran_at timestamp_ntz")
    got = q.freshness(log, ["a", "b", "c"], "2024-01-01 12:00:00")
    assert rows(got, "context", "status") == [("a", "PASS"), ("b", "ERROR"), ("c", "ERROR")]


def test_groups_rows_and_coverage(spark):
    df = spark.createDataFrame([("x", 1), ("y", 0)], "g string, v int")
    assert rows(q.expected_groups(df, "R", "S", "g", ["x", "z"]), "context", "status") == [("x", "PASS"), ("z", "FAIL")]
    assert q.minimum_rows(df, "R", "S", 3).first().status == "WARN"
    assert q.coverage(df, "R", "S", F.col("v") > 0, 0.5).first().status == "PASS"


def test_key_diff(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(compare.key_diff(a, b, ["k"]), "k", "side") == [(1, "missing"), (3, "extra")]


def test_whole_scoreboard_checks_in_one_aggregate(spark):
    """Least rows, coverage and totals as one by one, from one aggregate of the scoreboard."""
    rows = spark.createDataFrame([(1, 2, 0), (3, None, 5), (None, 4, None)], "ftc long, ftd_count long, target_ftc long")
    totals = spark.createDataFrame([(4, 5)], "grand_ftc long, grand_ftd long")
    for df in (rows, rows.where("ftc IS NULL")):
        got = q.check_totals(df, totals, F.col("target_ftc") > 0, 3, 0.5)
        alone = q.minimum_rows(df, "Performance", "Sales", 3).unionByName(q.coverage(df, "Performance", "Sales", F.col("target_ftc") > 0, 0.5))
        assert sorted(got.where("section = 'Sales'").collect(), key=str) == sorted(alone.collect(), key=str)
        assert got.columns == alone.columns
    status = {r.check_name: r.status for r in q.check_totals(rows, totals, F.col("target_ftc") > 0, 3, 0.5).where("section = 'Totals'").collect()}
    assert status == {"agents_up_to_grand_ftc": "PASS", "agents_up_to_grand_ftd": "FAIL"}
