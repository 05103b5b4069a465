"""Per-key operators: newest and first rows, running totals, threshold crossings, as-of reads.

A key may own a large share of the rows, so nothing here orders all rows of a key in one task. Newest /
first rows rely on Spark's partial window limit, which leaves one row per key and task before the shuffle.
Running totals work on (key, hour) slices: slice sums are pre-aggregated before the shuffle, their prefix
runs over slices (bounded by the calendar, not by the rows) and only rows of one slice are ordered together.
With `piece_rows` a slice is further cut at sampled rows into pieces of about that size (see _units), so that an
hour of one key may hold any share of the table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F


def _order(order):
    return [o if isinstance(o, Column) else F.col(o) for o in order]


def newest(df: DataFrame, keys: list[str], order: list, ties: bool = False) -> DataFrame:
    """The row with the greatest `order` per key; `ties` keeps every row that shares the first place."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in _order(order)])
    fn = F.rank() if ties else F.row_number()
    return df.withColumn("_rn", fn.over(w)).where("_rn = 1").drop("_rn")


def earliest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[o.asc_nulls_last() for o in _order(order)])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def as_of(df: DataFrame, keys: list[str], time: str, day: str, tie: list[str] = (),
          since: str | None = None) -> DataFrame:
    """Newest row per key on or before `day` (and not before `since`); the range reaches the scan."""
    after = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")
    rows = df.where(F.col(time) < after)
    if since:
        rows = rows.where(F.col(time) >= F.lit(since).cast("timestamp_ntz"))
    return newest(rows, keys, [time, *tie])


def hour_slice(time: str) -> Column:
    """Hours since 1970: grows with time, so slices keep the order of the rows."""
    return F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(time)


def order_key(time: str, tie: str) -> Column:
    """(time, tie) as one number that sorts alike.

    Aggregates over numbers stay in hash maps; a max over a struct would sort every row before combining.
    """
    seconds = F.col(time) - F.lit("1970-01-01").cast("timestamp_ntz")
    micros = seconds.cast("interval second").cast("decimal(18,6)") * F.lit(1000000)
    half = F.lit(Decimal(2 ** 63))
    return (micros.cast("decimal(18,0)") * F.lit(Decimal(10 ** 20))
            + (F.col(tie).cast("decimal(20,0)") + half)).cast("decimal(38,0)")


CHUNK = 32      # bounds compared at a time when a row looks for its piece
SALTS = 32      # shares in which rows of one slice look for their piece


def _piece_number(bounds: Column, at: Column) -> Column:
    """How many of the sorted `bounds` are at or before `at`: first among every CHUNK-th of them, then inside one chunk."""
    chunks = F.transform(F.sequence(F.lit(1), F.size(bounds), F.lit(CHUNK)), lambda i: F.slice(bounds, i, CHUNK))
    full = F.size(F.filter(chunks, lambda c: c[0] <= at))
    last = F.element_at(chunks, full)
    inside = F.size(F.filter(last, lambda b: b <= at))
    return F.when(full > 0, (full - 1) * CHUNK + inside).otherwise(F.lit(0)).cast("int")


def _units(df: DataFrame, keys: list[str], time: str, tie: str, piece_rows: int | None) -> tuple[DataFrame, list[str]]:
    """`df` with the columns, returned too, that name the unit of ordering a row belongs to: its hour, and a piece of it.

    A row bounds a piece if a hash of (key, time, tie) says so, on average one row in `piece_rows`. Bounds are thus a
    function of the rows: a stage that is run again after a lost executor cuts alike. They are one for each `piece_rows`
    rows of the table; rows meet them in SALTS shares of their hour, so a hot hour is spread there too, and are dealt by
    piece from then on. Rows that share time and tie are never parted.
    """
    rows = df.withColumn("_slice", F.coalesce(hour_slice(time), F.lit(1 << 40)))
    if not piece_rows:
        return rows, ["_slice"]
    at = F.struct(F.col(time).alias("t"), F.col(tie).alias("i"))
    cut = F.pmod(F.xxhash64(*keys, time, tie), F.lit(piece_rows)) == 0
    bounds = (rows.where(cut).groupBy(*keys, "_slice").agg(F.sort_array(F.collect_set(at)).alias("_bounds"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(tie, time), F.lit(SALTS)).cast("int"))
    piece = F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(_piece_number(F.col("_bounds"), at))
    return (salted.join(bounds, [*keys, "_slice", "_salt"], "left").withColumn("_piece", piece).drop("_salt", "_bounds"),
            ["_slice", "_piece"])


def _prefix(slices: DataFrame, keys: list[str], unit: list[str], value: str) -> DataFrame:
    """Sum of `value` over the earlier slices (or pieces of them) of the key."""
    w = Window.partitionBy(*keys).orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def _inside(keys: list[str], unit: list[str], time: str, tie: str) -> Window:
    return Window.partitionBy(*keys, *unit).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_total(df: DataFrame, keys: list[str], time: str, tie: str, value: str,
                  out: str = "running", piece_rows: int | None = None) -> DataFrame:
    """Inclusive running sum per key in (time, tie) order. Rows with a missing key or time are not part of it."""
    rows, unit = _units(df.dropna(subset=[*keys, time]), keys, time, tie, piece_rows)
    slices = rows.groupBy(*keys, *unit).agg(F.sum(value).alias("_sum"))
    before = _prefix(slices, keys, unit, "_sum").drop("_sum")
    return (rows.join(before, [*keys, *unit])
            .withColumn(out, F.col("_before") + F.sum(value).over(_inside(keys, unit, time, tie))).drop(*unit, "_before"))


def row_numbers(df: DataFrame, time: str, tie: str, out: str = "row_number", piece_rows: int = 1_000_000) -> DataFrame:
    """All rows numbered from 1 in (time, tie) order, rows without time last, without bringing them into one task.

    Only the number of rows in each piece of each hour is added up in one place. Rows that agree in both columns are
    numbered in any order among themselves.
    """
    rows, unit = _units(df, [], time, tie, piece_rows)
    counts = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("_rows"))
    before = _prefix(counts, [], unit, "_rows").drop("_rows")
    place = F.row_number().over(Window.partitionBy(*unit).orderBy(time, tie))
    return rows.join(before, unit).withColumn(out, F.col("_before") + place).drop(*unit, "_before")


def first_crossing(df: DataFrame, keys: list[str], time: str, tie: str, value: str, threshold,
                   out: str = "crossed_at", piece_rows: int | None = None) -> DataFrame:
    """First time per key at which the running sum of `value` reaches `threshold`.

    Slice totals bound the running sum inside a slice, so only slices that can hold the first crossing are
    looked into row by row: a slice counts when its start value plus its positive amounts reaches the
    threshold, and no slice after the first one that surely ends above it does. The same holds for pieces of slices.
    """
    rows, unit = _units(df.dropna(subset=[*keys, time]), keys, time, tie, piece_rows)
    slices = rows.groupBy(*keys, *unit).agg(
        F.sum(value).alias("_sum"),
        F.sum(F.when(F.col(value) > 0, F.col(value)).otherwise(F.lit(0))).alias("_gain"))
    limit = F.lit(threshold)
    whole = Window.partitionBy(*keys)
    place = F.struct(*unit) if len(unit) > 1 else F.col(unit[0])
    open_slices = (_prefix(slices, keys, unit, "_sum")
                   .withColumn("_sure", F.min(F.when(F.col("_before") + F.col("_sum") >= limit, place)).over(whole))
                   .where((F.col("_before") + F.col("_gain") >= limit)
                          & (F.col("_sure").isNull() | (place <= F.col("_sure"))))
                   .select(*keys, *unit, "_before"))
    reached = F.col("_before") + F.sum(value).over(_inside(keys, unit, time, tie)) >= limit
    return (rows.select(*keys, *unit, time, tie, value).join(open_slices, [*keys, *unit])
            .withColumn("_hit", reached).where("_hit")
            .groupBy(*keys).agg(F.min(time).alias(out)))


def beyond_mark(df: DataFrame, marks: DataFrame, keys: list[str], time: str, mark: str, partials: list[Column],
                after: bool) -> DataFrame:
    """Partial aggregates per key over the rows after (or up to) a per-key moment, to be combined once more.

    Slices entirely on the wanted side come pre-aggregated; rows are only looked at in the one slice that
    holds the key's mark. Joins run on (key, slice) or on slice sums, so a key with many rows stays spread.
    """
    rows = df.dropna(subset=[*keys, time]).withColumn("_slice", hour_slice(time))
    at = marks.where(F.col(mark).isNotNull()).select(*keys, mark, hour_slice(mark).alias("_mark_slice"))
    slices = rows.groupBy(*keys, "_slice").agg(*partials)
    inside = F.col("_slice") > F.col("_mark_slice") if after else F.col("_slice") < F.col("_mark_slice")
    whole = slices.join(at, keys).where(inside).drop("_slice", mark, "_mark_slice")
    wanted = F.col(time) > F.col(mark) if after else F.col(time) <= F.col(mark)
    edge = (rows.join(at.withColumnRenamed("_mark_slice", "_slice"), [*keys, "_slice"]).where(wanted)
            .groupBy(*keys).agg(*partials))
    return whole.select(*edge.columns).unionByName(edge)


def value_at_cutoff(df: DataFrame, cutoffs: DataFrame, keys: list[str], time: str, cutoff: str,
                    value: str, order: list[str], keep: list[str]) -> DataFrame:
    """State of a running sum at a per-key cutoff time, without ordering the rows.

    The sum over all rows up to the cutoff equals the running sum at the newest of them; that row's `keep`
    columns come from a max by (time, tie), so both parts combine map-side. `order` is that pair.
    """
    key = order_key(*order)
    kept = [F.max_by(c, key).alias(f"_{c}") for c in keep]
    parts = beyond_mark(df, cutoffs, keys, time, cutoff, [F.sum(value).alias("total"), F.max(key).alias("_key"), *kept], after=False)
    return parts.groupBy(*keys).agg(F.sum("total").alias("total"), *[F.max_by(f"_{c}", "_key").alias(c) for c in keep])


def first_after(df: DataFrame, marks: DataFrame, keys: list[str], time: str, mark: str, out: str) -> DataFrame:
    """Earliest time per key later than the key's mark."""
    parts = beyond_mark(df, marks, keys, time, mark, [F.min(time).alias(out)], after=True)
    return parts.groupBy(*keys).agg(F.min(out).alias(out))


def overlapping(history: DataFrame, key: str, first: str, last: str, start: str = "valid_from",
                stop: str = "valid_to") -> DataFrame:
    """Distinct keys with an effective-dated row that overlaps [first, last]; an open end never expires."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    return (history.where((F.col(start) <= b) & (F.col(stop).isNull() | (F.col(stop) >= a)))
            .select(key).distinct())


def previous_day(df: DataFrame, keys: list[str], day: str, columns: dict[str, str]) -> DataFrame:
    """Add values of the same key's row one day earlier; input holds one row per key and day."""
    w = Window.partitionBy(*keys).orderBy(day)
    adjacent = F.lag(day).over(w) == F.date_sub(F.col(day), 1)
    for src, out in columns.items():
        df = df.withColumn(out, F.when(adjacent, F.lag(src).over(w)))
    return df
