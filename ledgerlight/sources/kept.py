"""Stored tables kept by change sets, batch by batch.

A batch works in two steps. First every table proposes its changes (see operators.changes) and stores them in a log of its
own, numbered by batch; nothing else is touched. Then the logged changes are applied: only the partitions that hold or get
changed rows are rewritten, all other files stay. A log that is finished is never computed again and applying it twice
changes nothing, so a batch that ended anywhere, or is delivered again, is simply run again under its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerlight.operators import changes as ch, merge
from ledgerlight.sources.tables import Files


class ChangeLog:
    """The change sets of a table, a finished folder for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch:08d}"

    def has(self, batch: int) -> bool:
        return self.files.exists(f"{self.folder(batch)}/_SUCCESS")

    def write(self, batch: int, changes: DataFrame) -> None:
        changes.write.mode("overwrite").parquet(self.folder(batch))

    def read(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(self.folder(batch))


class KeptTable:
    """A keyed table in partitions by a value of the row, such as a month, with the log of its changes.

    `value` makes the partition's name from a function that gives a column by name; null values have a partition `none`.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, part: str, value: Callable[[Callable[[str], Column]], Column]):
        self.spark, self.path, self.keys, self.schema, self.part, self.value = spark, path.rstrip("/") + "/rows", keys, schema, part, value
        self.columns = [f.name for f in schema.fields]
        self.log = ChangeLog(spark, path.rstrip("/") + "/changes")

    def place(self, prefix: str = "") -> Column:
        return F.coalesce(self.value(lambda c: F.col(prefix + c)).cast("string"), F.lit("none"))

    def partitions(self, names: list[str] | None = None) -> DataFrame:
        """All rows with their partition, or those of some partitions only."""
        stored = T.StructType([*self.schema.fields, T.StructField(self.part, T.StringType())])
        if not Files(self.spark, self.path).children(self.path):
            return self.spark.createDataFrame([], stored)
        rows = self.spark.read.schema(stored).parquet(self.path)
        return rows if names is None else rows.where(F.col(self.part).isin(*names)) if names else rows.where("false")

    def read(self) -> DataFrame:
        return self.partitions().select(*self.columns)

    def names_of(self, wanted: DataFrame) -> list[str]:
        """The partitions that hold keys of `wanted`, found by a scan of the key columns."""
        if not Files(self.spark, self.path).children(self.path):
            return []
        held = ch.with_keys(self.partitions().select(*self.keys, self.part), wanted, self.keys)
        return [r[0] for r in held.select(self.part).distinct().collect()]   # bounded by the table's partitions

    def rows_of(self, wanted: DataFrame) -> DataFrame:
        """The rows with the keys of `wanted`; only their partitions are read."""
        return ch.with_keys(self.partitions(self.names_of(wanted)).select(*self.columns), wanted, self.keys)

    def propose(self, batch: int, changes: Callable[[], DataFrame]) -> DataFrame:
        """The batch's logged changes, computed and logged where that isn't done yet."""
        if not self.log.has(batch):
            self.log.write(batch, changes())
        return self.log.read(batch)

    def _marked(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        """Rows with `_gone` where their key is in `gone`."""
        marks = gone.select(*[F.col(k).alias(f"_of_{k}") for k in self.keys]).distinct().withColumn("_gone", F.lit(True))
        on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in self.keys]
        return rows.join(marks, on, "left")

    def merged(self, batch: int, delta: DataFrame, order: list, rules: dict | None = None, gone: DataFrame | None = None) -> DataFrame:
        """Changes that a keyed merge of `delta` makes (see operators.merge), then the deletion of the keys in `gone`."""
        def changes() -> DataFrame:
            new = merge.last_per_key(delta, self.keys, order).select(*self.columns)
            wanted = merge.drop_null_keys(delta, self.keys).select(*self.keys)
            wanted = wanted if gone is None else wanted.unionByName(gone.select(*self.keys))
            # each row goes with its old image through one merge with the partitions touched; rows left as they are fall out
            held = self.partitions(self.names_of(wanted)).select(*self.columns, ch.image(self.columns).alias("_old"))
            rows = merge.merge_by_key(held, new, self.keys, self.keys, rules).select(*self.columns, "_old")
            rows = rows.to(T.StructType([*self.schema.fields, T.StructField("_old", T.StructType(self.schema.fields))]))
            after = ch.image(self.columns)
            if gone is not None:
                rows = rows.transform(self._marked, gone)
                after = F.when(F.col("_gone").isNull(), after)
            return rows.select(*self.keys, F.col("_old").alias("before"), after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))

        return self.propose(batch, changes)

    def replaced(self, batch: int, rows: Callable[[], DataFrame], wanted: Callable[[], DataFrame]) -> DataFrame:
        """Changes that give the keys of `wanted` exactly the rows of `rows`."""
        return self.propose(batch, lambda: ch.differing(self.rows_of(wanted()), rows().select(*self.columns).to(self.schema), self.keys))

    def after(self, batch: int) -> DataFrame:
        """The table as it is once the batch is applied."""
        return ch.applied(self.read(), self.log.read(batch), self.keys)

    def apply(self, batch: int) -> list[str]:
        """Apply the batch's logged changes; returns the partitions that were rewritten."""
        changes = self.log.read(batch)
        places = F.array(F.when(F.col("before").isNotNull(), self.place("before.")), F.when(F.col("after").isNotNull(), self.place("after.")))
        names = sorted(r[0] for r in changes.select(F.explode(places).alias("p")).where("p IS NOT NULL").distinct().collect())
        if not names:
            return names
        rows = ch.applied(self.partitions(names).select(*self.columns), changes, self.keys).withColumn(self.part, self.place())
        seen = Observation()
        (rows.hint("rebalance", self.part).observe(seen, F.collect_set(self.part).alias("parts"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path))
        for name in set(names) - set(seen.get["parts"]):   # emptied, so not overwritten
            Files(self.spark, self.path).delete(f"{self.path}/{self.part}={name}")
        return names


class AdditiveView(KeptTable):
    """Sums by key over signed rows. A count of rows tells when a key has none left and goes.

    `measures` are columns of `schema` that add up; its other columns are the keys.
    """

    ROWS = "row_count"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, measures: list[str], part: str, value: Callable):
        keys = [f.name for f in schema.fields if f.name not in measures]
        super().__init__(spark, path, keys, T.StructType([*schema.fields, T.StructField(self.ROWS, T.LongType())]), part, value)
        self.measures = [*measures, self.ROWS]

    def folded(self, batch: int, rows: Callable[[], DataFrame]) -> DataFrame:
        """Changes of the view by `rows`: keys and measures, each measure already with its sign, row_count plus or minus one."""
        if self.log.has(batch):
            return self.log.read(batch)
        types = {f.name: f.dataType for f in self.schema.fields}
        total = lambda c, out: F.sum(c).cast(types[out]).alias(c)
        sums = rows().groupBy(*self.keys).agg(*[total(c, c) for c in self.measures]).where(" OR ".join(f"{c} <> 0" for c in self.measures)).persist()
        try:
            names = [r[0] for r in sums.select(self.place().alias("p")).distinct().collect()]
            # old measures in columns of their own: sums of numbers need no sorted rows
            old = {c: f"_old_{c}" for c in self.measures}
            held = self.partitions(names).select(*self.columns, *[F.col(c).alias(o) for c, o in old.items()], F.lit(1).alias("_held"))
            fresh = sums.select(*self.columns, *[F.lit(None).cast(types[c]).alias(o) for c, o in old.items()], F.lit(0).alias("_held"))
            both = held.unionByName(fresh).groupBy(*self.keys).agg(
                *[total(c, c) for c in self.measures], *[total(o, c) for c, o in old.items()], F.max("_held").alias("_held"))
            before = F.when(F.col("_held") == 1, F.struct(*[F.col(old.get(c, c)).alias(c) for c in self.columns]))
            after = F.when(F.col(self.ROWS) > 0, ch.image(self.columns))
            changes = both.select(*self.keys, before.alias("before"), after.alias("after"))
            return self.propose(batch, lambda: changes.where(~F.col("before").eqNullSafe(F.col("after"))))
        finally:
            sums.unpersist()
