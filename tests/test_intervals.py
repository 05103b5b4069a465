import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import plan
from ledgerlight.operators import intervals

A, B = "k int, a0 date, a1 date, a string", "k int, b0 date, b1 date, b string"


def spans(rnd, n, keys, prefix, longest):
    out = []
    for i in range(n):
        start = date(2024, 1, 1) + timedelta(days=rnd.randrange(-400, 400))
        out.append((rnd.choice(keys), start, None if rnd.random() < 0.1 else start + timedelta(days=rnd.randrange(longest)), f"{prefix}{i}"))
    return out


def brute(left, right):
    out = []
    for k, a0, a1, a in left:
        for q, b0, b1, b in right:
            if k == q and k is not None and a0 and b0 and (a1 is None or a1 >= a0) and (b1 is None or b1 >= b0) \
                    and (b1 is None or a0 <= b1) and (a1 is None or b0 <= a1):
                out.append((a, b, max(a0, b0), min((e for e in (a1, b1) if e), default=None)))
    return sorted(out, key=repr)


def joined(spark, left, right, cell):
    got = intervals.overlaps(spark.createDataFrame(left, A), spark.createDataFrame(right, B), ["k"], ("a0", "a1"), ("b0", "b1"), cell)
    return sorted((tuple(r) for r in got.select("a", "b", "overlap_from", "overlap_to").collect()), key=repr)


@pytest.mark.parametrize("cell", [1, 7, 32, 1000])
def test_against_all_pairs(spark, cell):
    rnd = random.Random(cell)
    left, right = spans(rnd, 60, [1, 1, 1, 2, None], "a", 90), spans(rnd, 60, [1, 1, 2, 3, None], "b", 20)
    assert joined(spark, left, right, cell) == brute(left, right) != []


def test_edges(spark):
    day = lambda n: date(1969, 12, 20) + timedelta(days=n)  # noqa: E731  days before 1970 too
    left = [(1, day(0), day(10), "touch"), (1, day(5), day(4), "ends before it starts"), (1, None, day(9), "no start"),
            (1, day(40), None, "open, after all"), (1, day(0), None, "open"), (1, day(0), day(10), "touch")]
    right = [(1, day(10), day(10), "one day"), (1, day(11), None, "open too"), (1, day(30), day(30), "late")]
    got = joined(spark, left, right, 3)
    assert got == brute(left, right)
    assert ("open", "open too", day(11), None) in got and got.count(("touch", "one day", day(10), day(10))) == 2
    empty = spark.createDataFrame([], B)
    assert intervals.overlaps(spark.createDataFrame(left, A), empty, ["k"], ("a0", "a1"), ("b0", "b1")).count() == 0
    with pytest.raises(ValueError):
        intervals.overlaps(empty, empty, ["k"], ("b0", "b1"), ("b0", "b1"))


def test_a_key_with_very_many_ranges(spark):
    """30,000 short ranges of one key on both sides: pairs by cell, no nested loop, nothing counted twice."""
    start = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 3).cast("int"))
    left = spark.range(30_000).select(F.floor(F.col("id") / 100_000).alias("k"), start.alias("a0"), F.date_add(start, 1).alias("a1"))
    right = left.select("k", F.date_add("a0", 1).alias("b0"), F.date_add("a1", 2).alias("b1"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = intervals.overlaps(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 6)
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
        # a range of two days meets the one that starts on its second day, and the one before, which ends on its first day
        assert out.count() == 30_000 + 29_999
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_periods(spark):
    days = [(1, 1), (1, 3), (1, 4), (1, 9), (2, 9)]
    df = spark.createDataFrame([(k, date(2024, 1, d), 10) for k, d in days], "k int, day date, v int")
    got = intervals.periods(df, ["k"], "day", 2, [F.sum("v").alias("v")])
    assert sorted((r.k, r.first_day.day, r.last_day.day, r.days, r.v) for r in got.collect()) == [(1, 1, 4, 3, 30), (1, 9, 9, 1, 10), (2, 9, 9, 1, 10)]
