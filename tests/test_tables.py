import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import rows
from ledgerlight.operators import merge
from ledgerlight.plans import views
from ledgerlight.schemas import _schema
from ledgerlight.sources import feeds, tables


def table(spark, path, **kw):
    return tables.VersionedTable(spark, str(path), ["k"], _schema("k:long v:str flag:int"), **kw)


def df(spark, *data):
    return spark.createDataFrame(list(data), "k long, v string, flag int")


def test_versions_and_merge(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().count() == 0
    t.write(df(spark, (1, "a", 1)))
    t.merge(df(spark, (1, "b", 0), (2, "c", 0)), ["k"], {"flag": merge.GREATEST})
    assert rows(t.read(), "k", "v", "flag") == [(1, "b", 1), (2, "c", 0)]
    assert rows(t.read(1), "k", "v") == [(1, "a")]
    t.insert_missing(df(spark, (1, "zz", 0), (3, "d", 0)))
    assert rows(t.read(), "k", "v") == [(1, "b"), (2, "c"), (3, "d")]
    t.sync_snapshot(df(spark, (7, "s", 0)), ["k"])
    assert rows(t.read(), "k") == [(7,)]
    assert t.versions() == [1, 2, 3, 4] and t.drop_old(3) == [1] and t.versions() == [2, 3, 4]
    with pytest.raises(ValueError):
        t.sync_snapshot(df(spark), ["k"])
    assert rows(t.read(), "k") == [(7,)]
    t.sync_snapshot(df(spark), ["k"], allow_empty=True)
    assert t.read().count() == 0


def test_unfinished_version_is_invisible(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.write(df(spark, (1, "a", 1)))
    os.makedirs(tmp_path / "t" / "v=00000002")          # a writer that died
    assert t.versions() == [1] and rows(t.read(), "k") == [(1,)]
    assert t.write(df(spark, (2, "b", 1))) == 3
    assert rows(t.read(), "k") == [(2,)]


def test_failed_job_leaves_table_and_is_logged(spark, tmp_path):
    t, log = table(spark, tmp_path / "t"), tables.Audit(spark, str(tmp_path / "log"))
    assert log.run("t", None, lambda seen: t.write(seen(df(spark, (1, "a", 1), (2, "b", 1))))) == 2
    bad = df(spark, (3, "x", 1)).withColumn("flag", F.raise_error(F.lit("boom")).cast("int"))
    with pytest.raises(Exception):
        log.run("t", "2024-01-01", lambda seen: t.write(seen(bad)))
    assert rows(t.read(), "k") == [(1,), (2,)]
    entries = {r.status: r for r in log.read().collect()}
    assert entries["success"].rows == 2 and str(entries["success"].cutoff) == "1970-01-01 00:00:00"
    assert "boom" in entries["error"].error


def test_days_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "days")

    def days(*data):
        return spark.createDataFrame([(k, date.fromisoformat(d), v) for k, d, v in data], "k int, day date, v int")
    tables.write_days(days((1, "2024-01-01", 1), (2, "2024-01-01", 1), (1, "2024-01-02", 1)), path)
    tables.write_days(days((1, "2024-01-02", 5)), path)
    tables.recompute_days(days((1, "2024-01-01", 9), (1, "2024-01-02", 9), (1, "2024-01-03", 9)), path, "2024-01-03", "2024-01-05")
    assert rows(spark.read.parquet(path).select("k", F.col("day").cast("string").alias("d"), "v"), "k", "d", "v") == [
        (1, "2024-01-01", 1), (1, "2024-01-02", 5), (1, "2024-01-03", 9), (2, "2024-01-01", 1)]


def test_refresh_order_and_failures(spark, tmp_path):
    log = tables.Audit(spark, str(tmp_path / "log"))
    names = ["daily_kpis", "run_rate_base", "account_stats"]
    targets = {n: tables.VersionedTable(spark, str(tmp_path / n), ["k"]) for n in names}
    order = [n for n in views.build_order() if n in names]
    build = {"daily_kpis": lambda: df(spark, (1, "a", 1)), "account_stats": lambda: df(spark, (5, "z", 1)),
             "run_rate_base": lambda: targets["daily_kpis"].read().withColumn("v", F.lit("from kpis"))}
    tables.refresh(build, targets, order, log)
    assert rows(targets["run_rate_base"].read(), "k", "v") == [(1, "from kpis")]

    def broken():
        raise RuntimeError("source gone")
    tables.refresh({**build, "daily_kpis": broken, "account_stats": lambda: df(spark, (6, "z", 1))}, targets, order, log)
    assert rows(targets["run_rate_base"].read(), "k") == [(1,)] and rows(targets["account_stats"].read(), "k") == [(6,)]
    status = {r.table_name: r for r in tables.view_status(log.read(), "2099-01-01 00:00:00").collect()}
    assert status["daily_kpis"].status == "error" and status["run_rate_base"].status == "skipped" and not status["account_stats"].healthy


def test_build_order():
    order = views.build_order()
    assert order.index("threshold_clients") < order.index("sales_bonuses") and order.index("daily_kpis") < order.index("run_rate_base")
    assert views.build_order({"deals"}) == [v for v in order if v in ("volume_stats", "retention_traders", "resolved_deals")]


def test_csv_and_id_files(spark, tmp_path):
    tables.export_csv(df(spark, (1, "a", 1), (2, "b", 0)), str(tmp_path / "csv"))
    assert rows(feeds.read_sheet(spark, str(tmp_path / "csv"), "k long, v string, flag int"), "k", "v") == [(1, "a"), (2, "b")]
    (tmp_path / "ids.txt").write_text("12\n\n x\n 13 \n12\n")
    assert rows(feeds.read_ids(spark, str(tmp_path / "ids.txt")), "login") == [(12,), (13,)]


def test_jdbc_reader_takes_key_ranges(spark):
    reader = feeds.jdbc_ranges(spark, "jdbc:x://host/db", "users", "id", 1, 1000, 16, user="u")
    assert reader is not None


def test_new_column_in_later_files(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "t"), ["k"])
    t.write(df(spark, (1, "a", 1)))
    t.merge(df(spark, (2, "b", 1)).withColumn("extra", F.lit(3)), ["k"])
    assert rows(t.read(), "k", "extra") == [(1, None), (2, 3)]


def test_partitioned_merge_touches_only_its_partitions(spark, tmp_path):
    path = tmp_path / "p"
    t = tables.PartitionedTable(spark, str(path), ["k"], _schema("k:long at:date v:str flag:int"), "month", F.date_format("at", "yyyy-MM"))

    def delta(*data):
        return spark.createDataFrame([(k, date.fromisoformat(d), v, f) for k, d, v, f in data], "k long, at date, v string, flag int")
    assert t.merge(delta((1, "2024-01-05", "a", 1), (2, "2024-02-05", "b", 0)), ["v"]) == ["2024-01", "2024-02"]
    before = {f.name: f.stat().st_mtime_ns for f in (path / "month=2024-01").iterdir()}
    change = delta((2, "2024-02-05", "c", 0), (3, "2024-02-09", "d", 0), (3, "2024-02-09", "e", 0))
    assert t.merge(change, ["v"]) == ["2024-02"]
    assert {f.name: f.stat().st_mtime_ns for f in (path / "month=2024-01").iterdir()} == before
    want = [(1, "a"), (2, "c"), (3, "e")]
    assert rows(t.read(), "k", "v") == want
    t.merge(change, ["v"])                                    # delivered again
    assert rows(t.read(), "k", "v") == want
    t.merge(delta((1, "2024-01-05", "z", 0)), ["v"], {"flag": merge.GREATEST})
    assert rows(t.read().where("k = 1"), "v", "flag") == [("z", 1)]
    assert t.merge(delta(), ["v"]) == [] and t.read().count() == 3
    # a key whose month changes moves, also into and out of a partition of its own
    assert t.merge(delta((1, "2024-02-07", "m", 0)), ["v"]) == ["2024-01", "2024-02"]
    assert rows(t.read(), "k", "v") == [(1, "m"), (2, "c"), (3, "e")] and not (path / "month=2024-01").exists()
    assert t.merge(delta((3, "2024-03-07", "n", 0)), ["v"]) == ["2024-02", "2024-03"]
    assert rows(t.read(), "k", "v", "month") == [(1, "m", "2024-02"), (2, "c", "2024-02"), (3, "n", "2024-03")]
