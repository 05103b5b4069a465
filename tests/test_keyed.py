import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows, ts
from ledgerlight.operators import keyed


def ledger(seed, accounts=4, n=300, hot=True):
    """Random signed amounts with many ties in time; one account owns a third of the rows."""
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        acc = 0 if hot and i % 3 == 0 else rnd.randrange(accounts)
        out.append((acc, start + timedelta(minutes=rnd.randrange(0, 600) // 30 * 30), i, Decimal(rnd.randrange(-60, 80))))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_running_total_and_crossing_match_brute_force(spark, seed):
    data = ledger(seed)
    df = spark.createDataFrame(data, "a int, at timestamp_ntz, id int, v decimal(18,2)").repartition(5)
    want, first = {}, {}
    for acc, at, key, amount in sorted(data):
        run = want.get(acc, Decimal(0)) + amount
        want[acc] = run
        first.setdefault((acc, "runs"), {})[key] = run
        if run >= 150 and acc not in first:
            first[acc] = at
    got = {(r.a, r.id): r.running for r in keyed.running_total(df, ["a"], "at", "id", "v").collect()}
    assert got == {(a, k): v for a in want for k, v in first[(a, "runs")].items()}
    crossed = {r.a: r.crossed_at for r in keyed.first_crossing(df, ["a"], "at", "id", "v", 150).collect()}
    assert crossed == {a: first[a] for a in want if a in first}


def test_crossing_inside_an_hour_that_ends_below(spark):
    at = ts("2024-01-01 10:00:00")
    data = [(1, at, 1, Decimal(94)), (1, at + timedelta(minutes=5), 2, Decimal(1)), (1, at + timedelta(minutes=6), 3, Decimal(-50)),
            (2, at, 1, Decimal("94.99")), (3, at, 2, Decimal(-5)), (3, at, 1, Decimal(96))]
    df = spark.createDataFrame(data, "a int, at timestamp_ntz, id int, v decimal(18,2)")
    got = rows(keyed.first_crossing(df, ["a"], "at", "id", "v", 95), "a", "crossed_at")
    assert got == [(1, at + timedelta(minutes=5)), (3, at)]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_an_hour_change_nothing(spark, seed, monkeypatch):
    """Every chunk of bounds and every tie: sums, crossings and numbers are those of whole hours."""
    monkeypatch.setattr(keyed, "CHUNK", 3)
    df = spark.createDataFrame(ledger(seed), "a int, at timestamp_ntz, id int, v decimal(18,2)").repartition(5)
    for piece_rows in (1, 2, 7, 10 ** 6):
        for f in (lambda **k: keyed.running_total(df, ["a"], "at", "id", "v", **k), lambda **k: keyed.first_crossing(df, ["a"], "at", "id", "v", 150, **k)):
            assert sorted(map(str, f(piece_rows=piece_rows).collect())) == sorted(map(str, f().collect()))


def test_one_hour_of_one_key_is_spread(spark):
    """All rows in one hour of one key: many pieces in many tasks, none of them near the whole, order as before."""
    n = 40_000
    df = spark.range(n).select(F.lit(1).alias("a"), F.timestamp_seconds(F.lit(1700000000 - 1700000000 % 3600) + F.pmod(F.xxhash64("id"), F.lit(3600))).cast("timestamp_ntz").alias("at"),
                               F.col("id"), (F.col("id") % 11 - 4).cast("decimal(10,0)").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = keyed.running_total(df, ["a"], "at", "id", "v", piece_rows=1000).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert len(sizes) >= 8 and max(sizes) < n / 2 and sum(sizes) == n
        found = {r.id: r.running for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    run = 0
    for r in sorted(df.collect(), key=lambda r: (r["at"], r["id"])):
        run += r["v"]
        assert found[r["id"]] == run


@pytest.mark.parametrize("piece_rows", [1, 5, 10 ** 6])
def test_row_numbers(spark, piece_rows):
    data = ledger(9) + [(7, None, 900 + i, Decimal(0)) for i in range(5)]
    df = spark.createDataFrame(data, "a int, at timestamp_ntz, id int, v decimal(18,2)").repartition(5)
    want = sorted(data, key=lambda r: (r[1] is None, r[1] or datetime(1, 1, 1), r[2]))
    got = keyed.row_numbers(df, "at", "id", "n", piece_rows).orderBy("n").collect()
    assert [r.id for r in got] == [r[2] for r in want] and [r.n for r in got] == list(range(1, len(data) + 1))
    assert keyed.row_numbers(df.limit(0), "at", "id").count() == 0


def test_rows_without_key_or_time_are_left_out(spark):
    df = spark.createDataFrame([(None, ts("2024-01-01"), 1, 5), (1, None, 2, 5), (1, ts("2024-01-01"), 3, 7)], "a int, at timestamp_ntz, id int, v int")
    assert rows(keyed.running_total(df, ["a"], "at", "id", "v"), "id", "running") == [(3, 7)]


def test_value_at_cutoff(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01"), 1, 10, "x"), (1, ts("2024-01-02"), 2, -3, "y"), (1, ts("2024-01-03"), 3, 9, "z"), (2, ts("2024-01-05"), 4, 1, "w")],
                               "a int, at timestamp_ntz, id int, v int, owner string")
    cut = spark.createDataFrame([(1, ts("2024-01-02")), (2, ts("2024-01-04")), (3, ts("2024-01-04"))], "a int, c timestamp_ntz")
    got = keyed.value_at_cutoff(df, cut, ["a"], "at", "c", "v", ["at", "id"], ["at", "owner"])
    assert rows(got, "a", "total", "at", "owner") == [(1, 7, ts("2024-01-02"), "y")]


def test_as_of_bounds(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01 23:59:59"), "a"), (1, ts("2024-01-02"), "b"), (2, ts("2024-01-02"), "c")], "k int, at timestamp_ntz, v string")
    assert rows(keyed.as_of(df, ["k"], "at", "2024-01-01"), "k", "v") == [(1, "a")]
    assert rows(keyed.as_of(df, ["k"], "at", "2024-01-02", since="2024-01-02"), "k", "v") == [(1, "b"), (2, "c")]


def test_newest_with_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c")], "k int, o int, v string")
    assert rows(keyed.newest(df, ["k"], ["o"], ties=True), "v") == [("a",), ("b",)]
    assert rows(keyed.newest(df, ["k"], ["o", "v"]), "v") == [("b",)]


def test_newest_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    text = plan(keyed.newest(df, ["k"], ["o"]))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_effective_dates(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-01-31"), (2, "2024-01-01", "2024-02-01"), (3, "2024-02-29", None), (4, "2024-03-01", None)],
                               "k int, a string, b string").select("k", F.col("a").cast("date").alias("valid_from"), F.col("b").cast("date").alias("valid_to"))
    assert rows(keyed.overlapping(df, "k", "2024-02-01", "2024-02-29"), "k") == [(2,), (3,)]


def test_previous_day_needs_adjacent_days(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 5), (1, "2024-01-02", 6), (1, "2024-01-04", 7)], "k int, d string, v int").withColumn("d", F.col("d").cast("date"))
    assert [r[0] for r in keyed.previous_day(df, ["k"], "d", {"v": "p"}).orderBy("d").select("p").collect()] == [None, 5, None]


def test_order_key_sorts_like_time_and_id(spark):
    times = ["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "2024-01-01 10:00:00", "2024-01-01 10:00:00.000001", "9000-01-01 00:00:00"]
    pairs = [(ts(t), i) for t in times for i in (-5, 0, 7, 2 ** 62)]
    df = spark.createDataFrame(pairs, "at timestamp_ntz, id long").withColumn("k", keyed.order_key("at", "id"))
    assert [(r.at, r.id) for r in df.orderBy("k").collect()] == sorted(pairs)
    text = plan(df.groupBy(F.hour("at")).agg(F.max_by("id", "k")))
    assert "SortAggregate" not in text
