"""Upserts with keyed state: the newest row of each key is kept in the stream's state, beside the merge that reads the table.

fold() says what a key's rows come to, whatever their order, batches or repetition: the greatest row by the order columns
(nulls least; ties by all columns, in the order of the schema), with the greatest value of some columns over all rows. The
stateful form is the same aggregate over a stream: each batch emits the keys it has rows of, as they are by then. They are
folded with their stored rows and only those that differ are merged, so a row that comes late or once more changes nothing
that it shouldn't, and the state may be lost (a new checkpoint).

State is one row a key, kept in RocksDB on the executors' disks, and doesn't expire: event time would drop late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.operators import changes as ch
from ledgerlight.sources.tables import PartitionedTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(rows: DataFrame, keys: list[str], order: list[str], greatest: tuple[str, ...] = ()) -> DataFrame:
    """One row a key; rows with a null key are left out."""
    rest = [c for c in rows.columns if c not in order and c not in keys]
    newest = F.max(F.struct(*order, *rest)).alias("n")
    tops = [F.max(c).alias(f"top_{c}") for c in greatest]
    out = rows.dropna(subset=keys).groupBy(*keys).agg(newest, *tops)
    return out.select(*[F.col(c) if c in keys else F.col(f"top_{c}" if c in greatest else f"n.{c}").alias(c) for c in rows.columns])


def upserted(stream: DataFrame, keys: list[str], order: list[str], greatest: tuple[str, ...] = ()) -> DataFrame:
    """Keys of each batch with their folded rows (update mode). The session must keep state in RocksDB (PROVIDER)."""
    return fold(stream, keys, order, greatest)


def changed(stored: DataFrame, rows: DataFrame, keys: list[str], order: list[str], greatest: tuple[str, ...] = ()) -> DataFrame:
    """Folded rows of the keys of both frames that aren't stored so already; `stored` holds a key once."""
    columns = rows.columns
    held = stored.select(*columns, ch.image(columns).alias("_held"))
    both = held.unionByName(rows.withColumn("_held", F.lit(None).cast(held.schema["_held"].dataType)))
    now = fold(both, keys, order, (*greatest, "_held"))
    return now.where(~F.col("_held").eqNullSafe(ch.image(columns))).select(*columns)


def upsert_stream(stream: DataFrame, table: PartitionedTable, order: list[str], checkpoint: str, greatest: tuple[str, ...] = ()) -> StreamingQuery:
    """The stream folded into a stored table. A batch delivered again, or run again after a failure, changes nothing."""
    columns = table.schema.fieldNames()

    def apply(batch: DataFrame, _: int) -> None:
        # kept, as its state is to be written once; dealt by key, as the order that state gives its rows can't be cached
        batch = batch.repartition(*table.keys).persist()
        stored = table.read().select(*columns).join(batch.select(*table.keys), table.keys, "left_semi")
        now = changed(stored, batch.select(*columns), table.keys, order, greatest).persist()
        try:
            table.merge(now, order)
        finally:
            now.unpersist()
            batch.unpersist()

    return upserted(stream.select(*columns), table.keys, order, greatest).writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
