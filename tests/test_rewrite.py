import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources.rewrite import RangeRewrite


def stamps(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_ino) for p in Path(path).rglob("*.parquet")}


def source(spark):
    """Skewed ids with repeats, and some rows without one."""
    return spark.range(2000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.floor(F.col("id") * F.col("id") / 700)).cast("long").alias("key"), (F.col("id") % 7).alias("v"))


def change(df):
    return df.withColumn("v", F.col("v") * 10)


def values(df):
    return sorted(map(str, df.select("key", "v").collect()))


def test_a_stopped_rewrite_goes_on(spark, tmp_path):
    rows, path = source(spark), str(tmp_path / "job")
    first = RangeRewrite(spark, path, "key")
    assert first.run(rows, change, 8, at_most=3) > 0
    assert first.progress().where("done").count() == 3
    with pytest.raises(ValueError):
        first.read()
    before = stamps(path)
    # an attempt that died half-way left files without the mark of a finished folder
    os.makedirs(f"{path}/rows/part=00005")
    Path(f"{path}/rows/part=00005/part-00000-broken.parquet").write_bytes(b"half a file")
    again = RangeRewrite(spark, path, "key")
    assert again.run(rows, change, 99) == 0        # the stored plan counts, not the new number
    after = stamps(path)
    assert {k: after[k] for k in before} == before and again.progress().where("NOT done").count() == 0
    whole = RangeRewrite(spark, str(tmp_path / "whole"), "key")
    whole.run(rows, change, 1)
    assert values(again.read()) == values(whole.read()) == values(change(rows))
    assert again.run(rows, change, 8) == 0 and stamps(path) == after


def test_ranges_cover_every_key_once(spark, tmp_path):
    rows = source(spark)
    job = RangeRewrite(spark, str(tmp_path / "job"), "key")
    plan = job.plan(rows, 8)
    assert plan[0] == (0, None, None) and plan[1][1] is None and plan[-1][2] is None
    assert all(a[2] == b[1] for a, b in zip(plan[1:], plan[2:]))
    sizes = [rows.where(job._inside(*r)).count() for r in plan]
    assert sum(sizes) == 2000 and max(sizes[1:]) < 500


def test_bounds_reach_the_files(spark, tmp_path, capsys):
    rows = source(spark)
    rows.write.parquet(str(tmp_path / "in"))
    job = RangeRewrite(spark, str(tmp_path / "job"), "key")
    spark.read.parquet(str(tmp_path / "in")).where(job._inside(2, 10, 20)).explain("formatted")
    assert "GreaterThanOrEqual(key,10), LessThan(key,20)" in capsys.readouterr().out


@pytest.mark.parametrize("kind", ["empty", "no keys", "text"])
def test_odd_tables(spark, tmp_path, kind):
    rows = {"empty": source(spark).limit(0), "no keys": source(spark).withColumn("key", F.lit(None).cast("long")),
            "text": source(spark).withColumn("key", F.col("v"))}[kind]
    job = RangeRewrite(spark, str(tmp_path / "job"), "key")
    job.run(rows, change, 4)
    assert values(job.read()) == values(change(rows))
