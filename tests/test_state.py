from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlight.schemas import _schema
from ledgerlight.sources.tables import PartitionedTable
from ledgerlight.streaming import feeds, state

SCHEMA = _schema("id:long version:int name:str peak:usd")
BATCHES = [
    [(1, 1, "a", Decimal(5)), (2, 1, "b", None), (3, None, "no version", Decimal(1)), (None, 9, "no key", Decimal(1))],
    # delivered again, an update, an older version that comes late with a greater peak, a tie in the order
    [(1, 1, "a", Decimal(5)), (2, 2, None, Decimal(3)), (1, 0, "late", Decimal(9)), (3, None, "other", None), (4, 1, "x", None), (4, 1, "y", None)],
    [(2, 1, "b", None), (2, 1, "b", Decimal(2)), (5, 1, "five", Decimal(1))],
]


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(state.PROVIDER)
    spark.conf.set(state.PROVIDER, state.ROCKSDB)
    yield spark
    spark.conf.set(state.PROVIDER, before)


def listed(df):
    return sorted(map(str, df.select("id", "version", "name", "peak").collect()))


@pytest.mark.parametrize("kept", [True, False])
def test_batches_and_restarts_give_the_fold_of_all_rows(rocksdb, tmp_path, kept):
    spark = rocksdb
    table = PartitionedTable(spark, str(tmp_path / "table"), ["id"], SCHEMA, "part", F.col("id") % 2)
    # the stream is started anew for each batch, from its checkpoint or, the state lost, from the first file
    for number, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.read_files(spark, str(tmp_path / "in"), SCHEMA)
        state.upsert_stream(stream, table, ["version"], str(tmp_path / f"checkpoint{0 if kept else number}"), ("peak",)).awaitTermination()
    everything = spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)
    got = listed(table.read())
    assert got == listed(state.fold(everything, ["id"], ["version"], ("peak",))) and len(got) == 5
    assert "Row(id=1, version=1, name='a', peak=Decimal('9.0000'))" in got and "Row(id=2, version=2, name=None, peak=Decimal('3.0000'))" in got


def test_fold_doesnt_depend_on_the_order(spark):
    rows = [r for b in BATCHES for r in b]
    folded = [listed(state.fold(spark.createDataFrame(x, SCHEMA), ["id"], ["version"], ("peak",))) for x in (rows, rows[::-1], rows + rows)]
    assert folded[0] == folded[1] == folded[2]
    assert state.fold(spark.createDataFrame([], SCHEMA), ["id"], ["version"]).isEmpty()


def test_state_is_kept_without_a_python_call_per_key(rocksdb, tmp_path):
    spark = rocksdb
    spark.createDataFrame(BATCHES[0], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = state.upserted(feeds.read_files(spark, str(tmp_path / "in"), SCHEMA), ["id"], ["version"], ("peak",))
    logical = stream._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [id" in logical and "TransformWithState" not in logical


def test_only_keys_that_differ_are_merged(spark):
    stored = state.fold(spark.createDataFrame(BATCHES[0], SCHEMA), ["id"], ["version"], ("peak",))
    again = state.changed(stored, spark.createDataFrame(BATCHES[0] + BATCHES[1][:2], SCHEMA), ["id"], ["version"], ("peak",))
    assert listed(again) == ["Row(id=2, version=2, name=None, peak=Decimal('3.0000'))"]
