import pytest
from pyspark.sql import functions as F

from helpers import rows
from ledgerlight.operators import merge


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([(1, 1, 5, "a", True), (2, 0, 6, "b", False), (3, 0, None, "c", None)], "k int, flag int, score int, v string, locked boolean")


def test_rules(spark, base):
    delta = spark.createDataFrame([(1, 0, None, "x", False), (2, 1, 7, None, False), (3, None, 8, "z", True), (4, 0, 1, "n", False)], base.schema)
    out = merge.merge_by_key(base, delta, ["k"], ["k"], {"flag": merge.GREATEST, "score": merge.KEEP_IF_NULL, "v": merge.guarded("locked"), "locked": merge.guarded("locked")})
    assert rows(out, "k", "flag", "score", "v") == [(1, 1, 5, "a"), (2, 1, 7, None), (3, 0, 8, "z"), (4, 0, 1, "n")]


def test_default_rule_takes_null(spark, base):
    delta = spark.createDataFrame([(1, 1, 5, None, True)], base.schema)
    assert rows(merge.merge_by_key(base, delta, ["k"], ["k"]).where("k = 1"), "v") == [(None,)]


def test_same_key_twice_in_one_delta(spark, base):
    delta = spark.createDataFrame([(9, 0, 1, "old", False, 1), (9, 0, 2, "new", False, 2)], base.withColumn("at", F.lit(0)).schema)
    out = merge.merge_by_key(base, delta, ["k"], ["at"]).where("k = 9")
    assert rows(out, "v", "at") == [("new", 2)]


def test_empty_delta_and_null_keys(spark, base):
    empty = base.limit(0)
    assert rows(merge.merge_by_key(base, empty, ["k"], ["k"]), "k") == [(1,), (2,), (3,)]
    nulls = spark.createDataFrame([(None, 0, 1, "x", False)], base.schema)
    assert merge.merge_by_key(base, nulls, ["k"], ["k"]).count() == 3


def test_merge_twice_changes_nothing(spark, base):
    delta = spark.createDataFrame([(1, 0, None, "x", False), (4, 0, 1, "n", False)], base.schema)
    once = merge.merge_by_key(base, delta, ["k"], ["k"], {"flag": merge.GREATEST})
    twice = merge.merge_by_key(once, delta, ["k"], ["k"], {"flag": merge.GREATEST})
    assert rows(once, *base.columns) == rows(twice, *base.columns)


def test_columns_missing_on_a_side(spark, base):
    delta = spark.createDataFrame([(1, "new")], "k int, extra string")
    out = merge.merge_by_key(base, delta, ["k"], ["k"])
    assert rows(out, "k", "v", "extra") == [(1, "a", "new"), (2, "b", None), (3, "c", None)]


def test_insert_missing_keeps_known_rows(spark, base):
    delta = spark.createDataFrame([(1, 9, 9, "x", False), (5, 9, 9, "y", False), (5, 9, 9, "y", False)], base.schema)
    assert rows(merge.insert_missing(base, delta, ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "c"), (5, "y")]




def test_overrides(spark, base):
    ids = spark.createDataFrame([(2,), (2,), (99,)], "k int")
    assert rows(merge.override_flag(base, ids, "k", "flag"), "k", "flag") == [(1, 1), (2, 1), (3, 0)]
    config = spark.createDataFrame([(1, "conf"), (2, None)], "k int, v string")
    assert rows(merge.override_values(base, config, ["k"]), "k", "v") == [(1, "conf"), (2, "b"), (3, "c")]


def test_deactivate(spark):
    members = spark.createDataFrame([(1, True), (2, True), (3, True)], "k int, is_active boolean")
    source = spark.createDataFrame([(1, "Active"), (2, "Inactive")], "k int, status string")
    assert rows(merge.deactivate(members, source, "k"), "k", "is_active") == [(1, True), (2, False), (3, True)]
