"""Rewrites of a large table range by range of its key, which go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.sources.tables import Files

NULL_RANGE = 0      # number of the range of rows without a key


class RangeRewrite:
    """One rewrite under one folder: `ranges` (the plan, written once) and a folder of rows for each range.

    Bounds come from an approximate histogram of the key when the rewrite starts, and are read back from then on, so
    every later attempt cuts alike; rows without a key are a range of their own, and the outer ranges have no outer bound.
    A range is done when Spark finished its folder; a half-written one is written again. The driver sees the bounds only.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.files = Files(spark, path)

    def _folder(self, number: int) -> str:
        return f"{self.path}/rows/part={number:05d}"

    def plan(self, source: DataFrame, ranges: int) -> list[tuple[int, object, object]]:
        """(number, low, high) of each range, low included, high not; stored the first time, read back afterwards."""
        folder = f"{self.path}/ranges"
        if not self.files.exists(f"{folder}/_SUCCESS"):
            shares = [i / ranges for i in range(1, ranges)]
            cuts = source.agg(F.percentile_approx(self.key, shares, 100 * ranges).alias("b")).first()["b"] if shares else []
            bounds = [None, *sorted(set(cuts or [])), None]
            kind = source.schema[self.key].dataType.simpleString()
            rows = [(NULL_RANGE, None, None), *((i, lo, hi) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]), 1))]
            self.spark.createDataFrame(rows, f"number int, low {kind}, high {kind}").coalesce(1).write.mode("overwrite").parquet(folder)
        return [tuple(r) for r in self.spark.read.parquet(folder).orderBy("number").collect()]

    def done(self, number: int) -> bool:
        return self.files.exists(f"{self._folder(number)}/_SUCCESS")

    def progress(self) -> DataFrame:
        """The plan with a column `done`."""
        plan = self.spark.read.parquet(f"{self.path}/ranges")
        finished = [r["number"] for r in plan.select("number").collect() if self.done(r["number"])]
        return plan.withColumn("done", F.col("number").isin(finished) if finished else F.lit(False))

    def _inside(self, number: int, low, high) -> Column:
        key = F.col(self.key)
        if number == NULL_RANGE:
            return key.isNull()
        inside = key.isNotNull()
        if low is not None:
            inside &= key >= F.lit(low)
        return inside if high is None else inside & (key < F.lit(high))

    def run(self, source: DataFrame, change: Callable[[DataFrame], DataFrame], ranges: int, at_most: int | None = None) -> int:
        """Write the ranges not done yet, `at_most` so many; returns how many are left. `ranges` counts the first time.

        `source` must stay as it was; `change` maps rows to rows of the same key. The range's bounds reach the scan.
        """
        todo = [r for r in self.plan(source, ranges) if not self.done(r[0])]
        for number, low, high in todo[:at_most]:
            change(source.where(self._inside(number, low, high))).write.mode("overwrite").parquet(self._folder(number))
        return len(todo[at_most:]) if at_most is not None else 0

    def read(self) -> DataFrame:
        """The rewritten rows, once every range is done."""
        left = self.progress().where("NOT done").count()
        if left:
            raise ValueError(f"{left} ranges are not done")
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/rows").drop("part")
