from datetime import timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import frame, rows, ts
from ledgerlight.operators import merge
from ledgerlight.plans import views
from ledgerlight.schemas import SCHEMAS
from ledgerlight.sources import feeds, tables
from ledgerlight.streaming import feeds as streams


def payment(i, at, usd=10, kind="Deposit", owner=1, account=1, ftd=0, **kw):
    return dict(money_id=i, account_id=account, approval="Approved", type=kind, owner=owner, usd=Decimal(usd), confirmed=at, ftd=ftd, **kw)


def drop(spark, folder, data):
    frame(spark, "money", data).coalesce(1).write.mode("append").parquet(folder)


def test_stream_merge_equals_batch_and_is_repeatable(spark, tmp_path):
    folder, t0 = str(tmp_path / "in"), ts("2024-01-01 10:00:00")
    table = tables.VersionedTable(spark, str(tmp_path / "t"), ["money_id"], SCHEMAS["money"])

    def run():
        stream = streams.read_files(spark, folder, SCHEMAS["money"])
        streams.merge_stream(stream, table, ["modified"], str(tmp_path / "cp"), {"deleted": merge.GREATEST}).awaitTermination()
    drop(spark, folder, [payment(1, t0, deleted=1, modified=t0), payment(2, t0, modified=t0)])
    run()
    drop(spark, folder, [payment(1, t0, 99, deleted=0, modified=t0 + timedelta(hours=1)), payment(3, t0, modified=t0)])
    run()
    want = [(1, Decimal("99.0000"), 1), (2, Decimal("10.0000"), None), (3, Decimal("10.0000"), None)]
    assert rows(table.read(), "money_id", "usd", "deleted") == want
    run()                                     # nothing new
    assert rows(table.read(), "money_id", "usd", "deleted") == want
    table.merge(frame(spark, "money", [payment(3, t0, modified=t0)]), ["modified"], {"deleted": merge.GREATEST})   # a batch delivered again
    assert rows(table.read(), "money_id", "usd", "deleted") == want


def test_daily_totals_stream_equals_batch(spark, tmp_path):
    folder, t0 = str(tmp_path / "in"), ts("2024-01-01 22:00:00")
    first = [payment(1, t0, 50, ftd=1), payment(2, t0 + timedelta(hours=3), 20, "Withdrawal"), payment(3, t0, 7, owner=2)]
    later = [payment(4, t0 + timedelta(hours=1), 5), payment(5, t0 + timedelta(hours=4), 11, "Withdrawal Cancelled"), payment(6, t0, 3, "Bonus")]
    very_late = [payment(7, t0 - timedelta(days=400), 9), payment(3, t0 - timedelta(days=30), 7, owner=2)]   # 3 moves to another day
    ledger = tables.PartitionedTable(spark, str(tmp_path / "ledger"), ["money_id"], SCHEMAS["money"], "month", F.date_format("confirmed", "yyyy-MM"))
    path = str(tmp_path / "totals")
    for data in (first, later, very_late, later):
        drop(spark, folder, data)
        streams.write_daily_totals(streams.read_files(spark, folder, SCHEMAS["money"]), ledger, path, ["confirmed"], str(tmp_path / "cp")).awaitTermination()
    accounts = frame(spark, "accounts", [dict(account_id=1, is_test=0)])
    batch = views.daily_kpis(frame(spark, "money", [p for p in first if p["money_id"] != 3] + later + very_late), accounts, None)
    cols = ("agent_id", "tx_date", "net_usd", "deposit_usd", "withdrawal_usd", "ftd_count")
    stored = spark.read.parquet(path).withColumn("tx_date", F.col("tx_date").cast("date"))
    assert rows(stored, *cols) == rows(batch, *cols)


def test_redelivered_rows_are_dropped(spark, tmp_path):
    folder, t0 = str(tmp_path / "in"), ts("2024-01-01 10:00:00")
    drop(spark, folder, [payment(1, t0), payment(2, t0)])
    drop(spark, folder, [payment(1, t0), payment(3, t0 + timedelta(hours=1))])
    stream = streams.deduplicated(streams.read_files(spark, folder, SCHEMAS["money"]), ["money_id"], "confirmed")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination())
    assert rows(spark.read.parquet(out), "money_id") == [(1,), (2,), (3,)]


def test_touched_days_are_recomputed(spark, tmp_path):
    t0, path = ts("2024-01-01 10:00:00"), str(tmp_path / "kpis")
    old = [payment(1, t0, ftd=1), payment(2, t0 + timedelta(days=1), ftd=1)]
    accounts = frame(spark, "accounts", [dict(account_id=1, is_test=0), dict(account_id=2, is_test=0)])
    tables.write_days(views.daily_kpis(frame(spark, "money", old), accounts, None), path, "tx_date")
    new = [payment(3, t0, ftd=1, account=2)]
    batch = frame(spark, "money", new)
    view = views.daily_kpis(frame(spark, "money", old + new), accounts, None)
    streams.refresh_touched(batch, view, path)
    got = rows(spark.read.parquet(path).select(F.col("tx_date").cast("string").alias("d"), "ftc_count"), "d", "ftc_count")
    assert got == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_late_rows_and_high_water(spark):
    t0 = ts("2024-01-10 00:00:00")
    data = frame(spark, "money", [payment(1, t0), payment(2, t0 - timedelta(days=3)), payment(3, t0 - timedelta(minutes=1))])
    assert rows(streams.late(data, "confirmed", F.lit(t0)), "money_id") == [(2,)]
    target = data.where("money_id = 3")
    assert rows(feeds.since_high_water(data, target, "confirmed"), "money_id") == [(1,), (3,)]
    assert rows(feeds.since_high_water(data, target.limit(0), "confirmed"), "money_id") == [(1,), (2,), (3,)]
    assert rows(feeds.resume_after_max(data, target.limit(0), "money_id"), "money_id") == [(1,), (2,), (3,)]
    assert rows(feeds.resume_after_max(data, data.where("money_id < 3"), "money_id"), "money_id") == [(3,)]
