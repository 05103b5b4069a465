"""Streaming counterparts of the polling feeds.

Polling with an overlapping lookback becomes a checkpointed file stream; the overlap becomes the watermark.
Merges run in foreachBatch and are repeatable: a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.functions import money as m
from ledgerlight.sources.tables import PartitionedTable, VersionedTable, recompute_days, write_days


def read_files(spark: SparkSession, folder: str, schema: T.StructType, per_batch: int = 1000, name_filter: str | None = None) -> DataFrame:
    """Stream of parquet files dropped into a folder; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def deduplicated(stream: DataFrame, key: list[str], time: str, lateness: str = "48 hours") -> DataFrame:
    """I4: re-delivered rows dropped by key while the watermark still remembers them.

    Rows later than the lateness are not passed on; where they must count, use merge_stream(), which needs no state.
    """
    event = stream.withColumn(time, F.col(time).cast("timestamp"))
    return event.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def merge_stream(stream: DataFrame, table: VersionedTable | PartitionedTable, order: list, checkpoint: str, rules: dict | None = None,
                 after=None) -> StreamingQuery:
    """Every micro-batch merged into the table by key; `after(batch)` may refresh what depends on it.

    Ledgers belong in a PartitionedTable, where a batch rewrites the partitions it touches; the versioned form
    rewrites the table and suits dimensions and small results.
    """
    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            table.merge(batch, order, rules)
            if after is not None:
                after(batch)
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


MEASURES = "net_usd", "deposit_usd", "withdrawal_usd", "ftd_count"


def daily_totals(money: DataFrame) -> DataFrame:
    """Additive day measures by owner (net, deposits, withdrawals, FTD)."""
    return (money.where(m.valid_money()).groupBy(F.col("owner").alias("agent_id"), F.to_date("confirmed").alias("tx_date"))
            .agg(m.usd_sum(m.signed_usd()).alias("net_usd"), m.usd_sum(m.money_in()).alias("deposit_usd"),
                 m.usd_sum(m.money_out()).alias("withdrawal_usd"), F.count_if(m.is_ftd()).alias("ftd_count")))


def windowed_totals(stream: DataFrame, lateness: str = "48 hours") -> DataFrame:
    """The same as a windowed aggregate with a watermark, for feeds without a stored ledger; later rows don't count."""
    rows = stream.where(m.valid_money()).withColumn("_at", F.col("confirmed").cast("timestamp"))
    return (rows.withWatermark("_at", lateness)
            .groupBy(F.window("_at", "1 day").alias("w"), F.col("owner").alias("agent_id"))
            .agg(m.usd_sum(m.signed_usd()).alias("net_usd"), m.usd_sum(m.money_in()).alias("deposit_usd"),
                 m.usd_sum(m.money_out()).alias("withdrawal_usd"), F.count_if(m.is_ftd()).alias("ftd_count"))
            .select("agent_id", F.to_date("w.start").alias("tx_date"), *MEASURES))


def write_daily_totals(stream: DataFrame, ledger: PartitionedTable, path: str, order: list, checkpoint: str,
                       rules: dict | None = None) -> StreamingQuery:
    """Each batch is merged into the ledger, and the months it changes, old and new, are totalled again from there.

    No state is kept and no row is too late; a batch that is delivered again changes nothing. Totals are stored in a
    folder for each month.
    """
    month = F.trunc("confirmed", "month")

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            before = ledger.read().join(batch.select(*ledger.keys).distinct(), ledger.keys, "left_semi")
            months = batch.select(month.alias("m")).union(before.select(month)).where("m IS NOT NULL").distinct()
            touched = [r[0] for r in months.collect()]   # one date for each month that a batch touches
            ledger.merge(batch, order, rules)
            if touched:
                again = daily_totals(ledger.read().where(month.isin(touched)))
                write_days(again.withColumn("month", F.trunc("tx_date", "month")), path, "month", touched)
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def touched_days(batch: DataFrame, time: str = "confirmed") -> DataFrame:
    """Days a batch changes; distinct counts of these days are recomputed in batch."""
    return batch.select(F.to_date(time).alias("day")).where("day IS NOT NULL").distinct()


def refresh_touched(batch: DataFrame, view: DataFrame, path: str, day: str = "tx_date", time: str = "confirmed") -> None:
    """Measures that do not add up (distinct clients) recomputed for the days a batch touches, day folders replaced."""
    days = touched_days(batch, time).withColumnRenamed("day", day)
    write_days(view.join(days, day, "left_semi"), path, day)


def reprocess(view: DataFrame, path: str, first: str, last: str, day: str = "tx_date") -> None:
    """Days whose late changes fell outside the lateness, recomputed from the stored tables."""
    recompute_days(view, path, first, last, day)


def late(rows: DataFrame, time: str, newest: Column, lateness: str = "48 hours") -> DataFrame:
    """Rows older than the lateness allows: the input of a reprocess."""
    return rows.where(F.col(time) < newest - F.expr(f"INTERVAL {lateness}"))
