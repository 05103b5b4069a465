"""Stored tables: versioned folders, partitioned snapshots, audit log and file export.

A version is a folder that Spark finished writing (it holds `_SUCCESS`); the newest finished one is current.
Readers never see a half-written version and a failed write leaves the table as it was, so a job may be run
again after losing executors or the driver.
"""

from __future__ import annotations

import re
import tempfile
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerlight.operators import changes as ch, merge
from ledgerlight.schemas import SCHEMAS

_VERSION = re.compile(r"v=(\d+)$")


def workspace(spark: SparkSession) -> str:
    """Shared folder for working tables: the one the cluster names. A temporary one serves a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="ledgerlight-")


class Files:
    """The few file-system calls needed, through Hadoop so that any shared store works."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def children(self, path: str) -> list[str]:
        p = self.path_of(path)
        return [s.getPath().toString() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path_of(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)


class VersionedTable:
    """A keyed table whose every change is a new folder under one path."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | None = None,
                 partition_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self.partition_by = partition_by or []
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        found = []
        for child in self.files.children(self.path):
            hit = _VERSION.search(child)
            if hit and self.files.exists(f"{child}/_SUCCESS"):
                found.append(int(hit[1]))
        return sorted(found)

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            if self.schema is None:
                raise FileNotFoundError(f"{self.path} has no finished version")
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/v={version or have[-1]:08d}")

    def write(self, df: DataFrame) -> int:
        """Write the next version; older ones stay until drop_old(), as readers may still use them."""
        taken = [int(h[1]) for c in self.files.children(self.path) if (h := _VERSION.search(c))]
        number = max(taken, default=0) + 1
        writer = df.write.mode("errorifexists")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/v={number:08d}")
        return number

    def drop_old(self, keep: int) -> list[int]:
        """Remove finished versions beyond the newest `keep`, once nothing reads them; returns what went."""
        gone = self.versions()[:-keep] if keep > 0 else []
        for old in gone:
            self.files.delete(f"{self.path}/v={old:08d}")
        return gone

    def merge(self, delta: DataFrame, order: list, rules: dict | None = None) -> int:
        return self.write(merge.merge_by_key(self.read(), delta, self.keys, order, rules))

    def insert_missing(self, delta: DataFrame) -> int:
        return self.write(merge.insert_missing(self.read(), delta, self.keys))

    def sync_snapshot(self, snapshot: DataFrame, order: list, allow_empty: bool = False) -> int:
        """The snapshot as the next version. An empty one is taken back unless allowed; it is counted while being written."""
        seen = Observation()
        number = self.write(merge.sync_snapshot(snapshot, self.keys, order).observe(seen, F.count(F.lit(1)).alias("rows")))
        if not allow_empty and not seen.get["rows"]:
            self.files.delete(f"{self.path}/v={number:08d}")
            raise ValueError("empty snapshot: pass allow_empty=True to clear the table")
        return number

    def changes(self, old: int, new: int) -> DataFrame:
        """The change set between two stored versions (see operators.changes); version 0 is the empty table."""
        after = self.read(new)
        before = self.read(old) if old else self.spark.createDataFrame([], after.schema)
        return ch.change_set(before.select(*after.columns), after, self.keys)

    def sync_changes(self, snapshot: DataFrame, order: list, allow_empty: bool = False) -> DataFrame:
        """sync_snapshot(), and what it changed against the version that was current before, deletes included.

        A source that fails and gives nothing is refused there, and does not look like a deletion of every row.
        """
        have = self.versions()
        number = self.sync_snapshot(snapshot, order, allow_empty)
        return self.changes(have[-1] if have else 0, number)


class PartitionedTable:
    """A large keyed table stored by an attribute that seldom changes for a key, such as the month of creation.

    A merge rewrites only the partitions its delta belongs to and those that hold its keys now (found by a scan of the
    key columns); all other files stay. Partitions are replaced through Spark's staging folder, and a merge that is
    run again gives the same rows, also after one that ended between writing and removing what it emptied.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, part: str, value: Column):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self.part, self.value = part, value

    def read(self) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField(self.part, T.StringType())])
        if not Files(self.spark, self.path).children(self.path):
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(self.path)

    def merge(self, delta: DataFrame, order: list, rules: dict | None = None) -> list[str]:
        """Merge the delta and return the partitions that were rewritten."""
        part = F.coalesce(self.value.cast("string"), F.lit("none"))
        new = merge.last_per_key(delta, self.keys, order).select(*[f.name for f in self.schema.fields])
        held = self.read().select(*self.keys, self.part).join(new.select(*self.keys), self.keys, "left_semi").select(self.part)
        # one short text per touched partition: their number is bounded by the partitions of the table
        touched = sorted(r[0] for r in new.select(part.alias(self.part)).union(held).distinct().collect())
        if not touched:
            return touched
        base = self.read().where(F.col(self.part).isin(*touched)).drop(self.part)
        merged = merge.merge_by_key(base, new, self.keys, self.keys, rules).withColumn(self.part, part).dropDuplicates(self.keys)
        seen = Observation()
        (merged.hint("rebalance", self.part).observe(seen, F.collect_set(self.part).alias("parts"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path))
        # a partition whose last key moved gets no rows, so it isn't overwritten
        for name in set(touched) - set(seen.get["parts"]):
            Files(self.spark, self.path).delete(f"{self.path}/{self.part}={name}")
        return touched


def write_days(df: DataFrame, path: str, day: str = "day", days: list | None = None) -> None:
    """Replace exactly the days the frame holds; other days of the table stay untouched.

    With a list of `days` those of them that the frame no longer holds are removed.

    Rows gather by day, but a day too large for one task is split over several, each with a file of its own.
    """
    (df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day).parquet(path))
    if days:
        held = {r[0] for r in df.select(day).distinct().collect()}
        files = Files(df.sparkSession, path)
        for gone in set(days) - held:
            files.delete(f"{path}/{day}={gone}")


def recompute_days(df: DataFrame, path: str, first: str, last: str, day: str = "day") -> None:
    """Days of a range recomputed from a derived frame, the range reaching the scan."""
    write_days(df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))), path, day)


def save_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Store a large table bucketed and sorted by its join keys, so that joins and groupings on them need no shuffle.

    Deals are kept by (position, source): matching entries to exits then starts without moving a row.
    """
    (df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return df.sparkSession.table(table)


def export_csv(df: DataFrame, path: str) -> None:
    """Result as CSV with a header, in as many part files as the result has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


class Audit:
    """Append-only run log: what was written, from which cutoff, how long it took and how it ended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, table: str, cutoff, rows: int, duration_ms: int, status: str, error: str | None = None) -> None:
        row = self.spark.range(1).select(
            F.lit(table).alias("table_name"),
            F.coalesce(F.lit(cutoff).cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("cutoff"),
            F.lit(rows).cast("bigint").alias("rows"), F.lit(duration_ms).cast("bigint").alias("duration_ms"),
            F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"),
            F.localtimestamp().alias("ran_at"))
        row.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMAS["sync_log"]).parquet(self.path)

    def run(self, table: str, cutoff, job) -> int:
        """Run `job(observe)`; the frame it wraps with observe() is counted while being written, not by a second pass."""
        seen, start = Observation(), time.time()
        try:
            job(lambda df: df.observe(seen, F.count(F.lit(1)).alias("rows")))
            rows = seen.get["rows"]
            self.append(table, cutoff, rows, int((time.time() - start) * 1000), "success")
            return rows
        except Exception as e:
            self.append(table, cutoff, 0, int((time.time() - start) * 1000), "error", str(e))
            raise


def refresh(build: dict, targets: dict[str, VersionedTable], order: list[str], audit: Audit) -> None:
    """V9: rebuild views in dependency order; each reads the versions its predecessors just wrote.

    A view that fails is logged and its dependents are left at their last good version.
    """
    from ledgerlight.plans.views import DEPENDENCIES
    failed: set[str] = set()
    for name in order:
        if failed & set(DEPENDENCIES[name]):
            failed.add(name)
            audit.append(name, None, 0, 0, "skipped")
            continue
        try:
            audit.run(name, None, lambda observe, n=name: targets[n].write(observe(build[n]())))
        except Exception:
            failed.add(name)


def view_status(log: DataFrame, now: str, healthy_seconds: int = 300) -> DataFrame:
    """V9: newest run per view with its age and health."""
    run = F.max(F.struct("ran_at", "status", "duration_ms", "rows")).alias("r")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("r.ran_at").cast("timestamp")))
    return log.groupBy("table_name").agg(run).select(
        "table_name", "r.status", "r.duration_ms", "r.rows", age.alias("age_seconds"),
        ((F.col("r.status") == "success") & (age < healthy_seconds)).alias("healthy"))
