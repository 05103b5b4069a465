import pytest
from pyspark.sql import functions as F

from helpers import plan
from ledgerlight.operators import changes as ch, hashtree as ht

SHAPE = ht.Shape("key", width=10, fanout=4, levels=3)
SCHEMA = "key long, part string, v double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


def base():
    """Negative, dense, far and missing keys; nulls in every column."""
    keys = [*range(-25, 400), 10**6, -(2**63), 2**63 - 1]
    return [(k, "x" if k % 3 else None, k % 11 / 2 if k % 7 else None) for k in keys] + [(None, "x", 1.0), (None, "y", None)]


def images(df):
    return sorted((str((r["key"], r["part"], ch_of(r))) for r in df.collect()))


def ch_of(r):
    return tuple(r["before"]) if r["before"] else None, tuple(r["after"]) if r["after"] else None


def changed():
    rows = [r for r in base() if r[0] not in (17, 18, 10**6)]
    rows = [(k, p, 99.0 if k in (200, -25) else v) for k, p, v in rows]
    return rows + [(5000, "new", None), (None, "z", 2.0)]


@pytest.mark.parametrize("at_most", [0, 2, 256])
def test_equal_to_the_whole_comparison(spark, at_most):
    a, b = table(spark, base()), table(spark, changed())
    want = images(ch.change_set(a, b, ["key", "part"]))
    got = ht.differences(a, b, ht.tree(a, SHAPE), ht.tree(b, SHAPE), ["key", "part"], SHAPE, at_most)
    assert images(got) == want and len(want) == 7


def test_only_the_ranges_that_differ_are_opened(spark, tmp_path):
    a, b = table(spark, base()), table(spark, [r for r in base() if r[0] not in (17, 18, 23)])
    level, ranges = ht.to_open(ht.tree(a, SHAPE), ht.tree(b, SHAPE), SHAPE)
    assert (level, sorted(ranges)) == (0, [1, 2])
    assert ht.to_open(ht.tree(a, SHAPE), ht.tree(b, SHAPE), SHAPE, 1) == (1, [0])
    a.write.parquet(str(tmp_path / "a"))
    opened = spark.read.parquet(str(tmp_path / "a")).where(SHAPE.inside(level, ranges))
    assert "GreaterThanOrEqual(key,10), LessThanOrEqual(key,29)" in plan(opened)
    assert opened.count() == 20


def test_ranges_at_the_ends_of_whole_numbers(spark):
    keys = [-(2**63), 2**63 - 1, 0]
    a, b = table(spark, [(k, None, 1.0) for k in keys]), table(spark, [(k, None, 2.0) for k in keys])
    assert len(images(ht.differences(a, b, ht.tree(a, SHAPE), ht.tree(b, SHAPE), ["key", "part"], SHAPE))) == 3


def test_equal_tables_open_nothing(spark):
    a, b = table(spark, base()), table(spark, base()[::-1])
    assert ht.to_open(ht.tree(a, SHAPE), ht.tree(b.select("v", "key", "part"), SHAPE), SHAPE) == (0, [])
    assert ht.differences(a, b, ht.tree(a, SHAPE), ht.tree(b, SHAPE), ["key", "part"], SHAPE).isEmpty()


def test_a_folded_tree_is_that_of_the_changed_table(spark):
    a, b = table(spark, base()), table(spark, changed())
    after = ht.folded(ht.tree(a, SHAPE), ch.change_set(a, b, ["key", "part"]), SHAPE)
    assert sorted(map(str, after.collect())) == sorted(map(str, ht.tree(b, SHAPE).collect()))


def test_repeated_rows_and_empty_tables(spark):
    one, two = table(spark, [(1, "x", 1.0)] * 2), table(spark, [(1, "y", 1.0)] * 2)
    assert ht.differing(ht.tree(one, SHAPE), ht.tree(two, SHAPE)).count() == SHAPE.levels
    none = table(spark, []).where(F.lit(False))
    assert ht.tree(none, SHAPE).isEmpty()
    got = ht.differences(none, two.limit(1), ht.tree(none, SHAPE), ht.tree(two.limit(1), SHAPE), ["key", "part"], SHAPE)
    assert [ch_of(r) for r in got.collect()] == [(None, (1, "y", 1.0))]
    assert ht.differences(none, none, ht.tree(none, SHAPE), ht.tree(none, SHAPE), ["key", "part"], SHAPE).isEmpty()
