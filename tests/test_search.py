from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import plan
from ledgerlight.operators import filters
from ledgerlight.sources.search import SearchIndex, needed

SCHEMA = "id long, name string, desk string, score int"
COLUMNS = ["id", "name", "desk"]
NAMES = ["Anna Nation", "ÄRGER über", "nation nation", "", None, "𝄞𝄞𝄞 clef", "aaaaaa", "x" * 5000 + "needle", "ab", "100%_sure|x"]


def people(spark, n=120):
    rows = [(i - 20, NAMES[i % len(NAMES)], f"desk {i % 4}" if i % 5 else None, i) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "Anna without id", "desk 1", 1), (7, "Anna again", None, 2)], SCHEMA)


def index(spark, tmp_path, width=16):
    return SearchIndex(spark, str(tmp_path / "index"), "id", COLUMNS, people(spark, 1).schema, width)


def listed(df):
    return sorted(map(str, df.collect()))


NEEDLES = ["anna", " NATION ", "nation nation", "über", "𝄞𝄞𝄞", "𝄞𝄞𝄞 C", "aaaa", "needle", "ab", "", "  ", "%_s", "e|x", "desk 3", "nothing here", "-20", "again"]


def test_equal_to_the_plain_search(spark, tmp_path):
    rows, idx = people(spark), index(spark, tmp_path)
    idx.build(rows)
    for needle in NEEDLES:
        assert listed(idx.search(needle)) == listed(filters.search(rows, needle, COLUMNS)), needle


def test_reads_only_segments_with_hits(spark, tmp_path):
    idx = index(spark, tmp_path)
    idx.build(people(spark))
    assert sorted(idx.opened("again")) == [("0", 7, 7)] and idx.opened("nothing here") == []
    read = plan(idx.search("again"))
    assert "PartitionFilters: [isnotnull(segment" in read and "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,7), LessThanOrEqual(id,7)" in read
    assert "PushedFilters: [In(gram, [aga,ain,gai])" in plan(idx.hits("again")) or "PushedFilters: [In(gram, [aga,ain])" in plan(idx.hits("again"))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_updates_touch_their_segments(spark, tmp_path):
    rows, idx = people(spark), index(spark, tmp_path)
    idx.build(rows)
    before = files(idx.path)
    # an update, an insert into a new segment, and all rows of the segment of ids 48 to 63 deleted
    fresh = (rows.where("id IS NULL OR id NOT BETWEEN 48 AND 63").withColumn("name", F.when(F.col("id") == 3, "Zebra").otherwise(F.col("name")))
             .unionByName(spark.createDataFrame([(5000, "Zebra two", None, 1)], SCHEMA)))
    changed = spark.createDataFrame([(3,), (5000,), *[(i,) for i in range(48, 64)]], "id long")
    assert idx.update(fresh, changed) == ["0", "3", "312"]
    after = files(idx.path)
    assert {p for p in before if "segment=0/" not in p and "segment=3/" not in p} <= {p for p in after if before.get(p) == after[p]}
    assert not any("segment=3/" in p for p in after)
    for _ in range(2):
        for needle in ("zebra", "anna", "desk 1"):
            assert listed(idx.search(needle)) == listed(filters.search(fresh, needle, COLUMNS)), needle
        idx.update(fresh, changed)
    assert idx.update(fresh, changed.limit(0)) == []


def test_empty_index(spark, tmp_path):
    idx = index(spark, tmp_path)
    assert idx.search("anna").isEmpty()
    idx.build(people(spark).limit(0))
    assert idx.search("anna").isEmpty() and idx.search("").isEmpty()


@pytest.mark.parametrize("needle, grams", [("abc", ["abc"]), ("abcd", ["abc", "bcd"]), ("abcdef", ["abc", "def"]), ("aaaaa", ["aaa"])])
def test_grams_cover_the_needle(needle, grams):
    assert needed(needle) == grams


def test_many_segments(spark, tmp_path):
    """More segments with hits than a filter names range by range, some untouched between them."""
    idx = index(spark, tmp_path, width=1)
    rows = spark.range(60).selectExpr("IF(id = 59, NULL, id * 2) AS id", "IF(id % 20 = 7, 'other', 'anna') AS name", "CAST(NULL AS string) AS desk", "CAST(id AS int) AS score")
    idx.build(rows.withColumn("name", F.lit("before")))
    fresh = rows.withColumn("name", F.when(F.col("score") % 20 == 7, "before").otherwise(F.col("name")))
    assert len(idx.update(fresh, rows.where("score % 20 <> 7"))) == 57
    assert len(idx.opened("anna")) == 57 and "PartitionFilters: [segment" in plan(idx.search("anna"))
    for needle in ("anna", "before"):
        assert listed(idx.search(needle)) == listed(filters.search(fresh, needle, COLUMNS)), needle


def test_filters_dont_nest_by_segment(spark, tmp_path):
    idx, rows = index(spark, tmp_path), people(spark)
    names = [str(n) for n in range(-3000, 3000, 2)]
    inside = rows.withColumn("segment", idx._segment()).where(idx._keys_of([*names, "none"])).drop("segment")
    assert listed(inside) == listed(rows.where("id IS NULL OR pmod(floor(id / 16), 2) = 0"))
    places = [*((n, int(n) * 16, int(n) * 16 + 15) for n in names), ("none", None, None)]
    assert rows.withColumn("segment", idx._segment()).where(idx._places(places)).count() == inside.count()
