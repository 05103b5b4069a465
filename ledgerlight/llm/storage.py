"""Shared folder of the cluster, and tables written there to cut lineage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"file://{tempfile.gettempdir()}/ledgerlight-checkpoint"
    return f"{base.rstrip('/')}/ledgerlight/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lost executors cost no recomputation beyond this point."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, for tables that are costly to build in each task."""
    module = sys.modules.setdefault("_ledgerlight_worker_cache", types.ModuleType("_ledgerlight_worker_cache"))
    return module.__dict__.setdefault(name, {})


SIEVE_BITS = 1 << 23


def sieved(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Rows of `df` whose key may be in the one column of `wanted`: a join by key then has less to shuffle.

    A bitmap of SIEVE_BITS (1 MB, whatever the data) over key hashes is broadcast; rows may pass by chance, none is lost.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS)) + 1
    bits = wanted.select(place(F.col(wanted.columns[0])).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_sieve_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_sieve_bits"))
    at = df.withColumn("_sieve_place", place(key)).withColumn("_sieve_own", F.bitmap_bucket_number("_sieve_place"))
    bit = F.bitmap_bit_position("_sieve_place").cast("int")
    byte = F.conv(F.hex(F.substring("_sieve_bits", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    met = at.join(F.broadcast(bits), F.col("_sieve_own") == F.col("_sieve_bucket")).where(F.getbit(byte, bit % 8) == 1)
    return met.select(*[F.col(f"`{c}`") for c in df.columns])
