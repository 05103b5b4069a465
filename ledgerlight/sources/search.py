"""A stored search index: which rows hold a text anywhere in some of their columns, without reading all rows.

Rows are kept in segments of `width` values of a whole-number key. Each segment has the rows, in order of the key, and the
keys by trigram of the lower-cased searched columns, in order of the trigram, so that a search reads the few pages of its
trigrams and then the rows of segments with hits, between the least and the greatest key hit. Every row so found is tested
with the plain search, hence the result is that of filters.search() over all rows. Texts of fewer than three characters have
no trigram: for them all rows are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ledgerlight.operators import changes as ch, filters
from ledgerlight.sources.tables import Files

SEGMENT, GRAM, NO_KEY = "segment", "gram", "none"
SPANS = 32      # ranges of keys named one by one in a filter; of more, the filter has the segments and the outer bounds


def trigrams(column: str) -> Column:
    """Distinct runs of three characters of a column's text in lower case; null and short texts have none."""
    text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    chars = F.split(text, "")
    runs = F.transform(F.sequence(F.lit(0), F.length(text) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
    return F.when(F.length(text) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def needed(needle: str) -> list[str]:
    """Trigrams that cover a needle; whatever holds the needle holds each of them."""
    starts = [*range(0, len(needle) - 2, 3), len(needle) - 3]
    return sorted({needle[i:i + 3] for i in starts})


class SearchIndex:
    """The index of one table. `key` needn't be unique; rows without one share a segment. Names `segment` and `gram` are taken."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str], schema: T.StructType, width: int = 1 << 20):
        self.spark, self.path, self.key, self.columns, self.schema, self.width = spark, path.rstrip("/"), key, columns, schema, width
        self.files = Files(spark, path)

    def _segment(self) -> Column:
        return F.coalesce(F.expr(f"CAST(FLOOR(CAST(`{self.key}` AS DECIMAL(20,0)) / {self.width}) AS STRING)"), F.lit(NO_KEY))

    def _read(self, name: str, fields: list[T.StructField]) -> DataFrame:
        schema = T.StructType([*fields, T.StructField(SEGMENT, T.StringType())])
        if not self.files.children(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema.fields)

    def postings(self) -> DataFrame:
        return self._read("grams", [T.StructField(GRAM, T.StringType()), self.schema[self.key]])

    def _replace(self, name: str, rows: DataFrame, order: str, segments: list[str]) -> None:
        """Segments the rows belong to replaced, those of `segments` that got none removed."""
        seen = Observation()
        (rows.hint("rebalance", SEGMENT).observe(seen, F.collect_set(SEGMENT).alias("held")).sortWithinPartitions(SEGMENT, order)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SEGMENT).parquet(f"{self.path}/{name}"))
        for gone in set(segments) - set(seen.get["held"]):
            self.files.delete(f"{self.path}/{name}/{SEGMENT}={gone}")

    def _store(self, rows: DataFrame, segments: list[str]) -> None:
        placed = rows.select(*self.schema.fieldNames(), self._segment().alias(SEGMENT))
        self._replace("rows", placed, self.key, segments)
        stored = self.rows().where(self._in(segments)) if segments else self.rows()
        grams = stored.select(SEGMENT, self.key, F.explode(F.array_distinct(F.flatten(F.array(*map(trigrams, self.columns))))).alias(GRAM))
        self._replace("grams", grams.distinct(), GRAM, segments)

    def build(self, rows: DataFrame) -> None:
        """The index of a table not indexed yet."""
        self._store(rows, [])

    def update(self, rows: DataFrame, changed: DataFrame) -> list[str]:
        """Segments with a changed key (column `key` of `changed`, such as a change set) made anew from `rows`, the whole
        table as it is now; other segments keep their files. Run again it gives the same. Returns these segments, whose
        number is bounded by the index."""
        segments = sorted(r[0] for r in changed.select(self._segment().alias(SEGMENT)).distinct().collect())
        if segments:
            self._store(rows.withColumn(SEGMENT, self._segment()).where(self._keys_of(segments)), segments)
        return segments

    @staticmethod
    def _in(segments: list[str]) -> Column:
        """Rows of these segments, whose names are whole numbers or NO_KEY; one flat list, however many."""
        return F.expr(f"{SEGMENT} IN ({', '.join(repr(s) for s in segments)})")

    def _bounds(self, low: int, high: int) -> Column:
        return F.col(self.key).between(F.lit(max(low, -(1 << 63))), F.lit(min(high, (1 << 63) - 1)))

    def _keys_of(self, segments: list[str]) -> Column:
        """The segments as bounds of the key, for the scan of the source; neighbours make one range."""
        runs: list[list[int]] = []
        for n in sorted(int(s) for s in segments if s != NO_KEY):
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
        outer = [[runs[0][0], runs[-1][1]]] if len(runs) > SPANS else runs
        tests = [self._bounds(a * self.width, (z + 1) * self.width - 1) for a, z in outer]
        tests += [F.col(self.key).isNull()] if NO_KEY in segments else []
        inside = reduce(lambda a, b: a | b, tests)
        # numbers between the runs belong to other segments
        return inside if outer is runs else inside & self._in(segments)

    def hits(self, needle: str) -> DataFrame:
        """(segment, key) of rows that hold all of the needle's trigrams: more than match, never fewer."""
        grams = needed(needle)
        found = self.postings().where(F.col(GRAM).isin(grams)).groupBy(SEGMENT, self.key).agg(F.count(F.lit(1)).alias("n"))
        return found.where(F.col("n") == len(grams)).select(SEGMENT, self.key)

    def opened(self, needle: str) -> list[tuple]:
        """(segment, least key, greatest key) to read rows from; one line for each segment with a hit."""
        hits = self.hits(needle).groupBy(SEGMENT).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"))
        return [tuple(r) for r in hits.collect()]

    def _places(self, places: list[tuple]) -> Column:
        """The segments to open and between which keys; the join with the hits leaves the same rows for any such bounds."""
        key, known = F.col(self.key), [p for p in places if p[0] != NO_KEY]
        if len(places) > SPANS:
            outer = self._bounds(min(lo for _, lo, _ in known), max(hi for _, _, hi in known))
            return self._in([s for s, _, _ in places]) & (outer if len(known) == len(places) else outer | key.isNull())
        tests = [(F.col(SEGMENT) == s) & (key.isNull() if s == NO_KEY else self._bounds(lo, hi)) for s, lo, hi in places]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def search(self, text: str) -> DataFrame:
        """Rows with the text in any searched column, in any case; blank text keeps all."""
        needle, rows = text.strip().lower(), self.rows()
        if len(needle) >= 3:
            rows = rows.where(self._places(self.opened(needle)))
            rows = ch.with_keys(rows, self.hits(needle), [SEGMENT, self.key])
        return filters.search(rows, text, self.columns).drop(SEGMENT)
