"""Joins of tables whose rows hold for a range of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def day_number(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def _in_cells(df: DataFrame, other: DataFrame, keys: list[str], span: tuple[str, str], other_start: str, cell_days: int, mark: str) -> DataFrame:
    """Rows copied into each cell of days they reach into, up to the cell of the last start on the other side."""
    start, stop = F.col(span[0]), F.col(span[1])
    ends = other.groupBy(*keys).agg(F.max(day_number(F.col(other_start))).alias("_horizon"))
    first = F.floor(day_number(start) / cell_days).cast("int")
    last = F.floor(F.least(day_number(stop), F.col("_horizon")) / cell_days).cast("int")     # an open end reaches the horizon
    return (df.where(start.isNotNull() & (stop.isNull() | (stop >= start))).join(ends, keys).where(F.col("_horizon").isNotNull())
            .withColumn(mark, first).withColumn("_cell", F.explode(F.sequence(F.col(mark), F.greatest(F.col(mark), last)))).drop("_horizon"))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
             cell_days: int = 32) -> DataFrame:
    """Pairs of rows of one key whose ranges of days share a day, with the shared days as overlap_from and overlap_to.

    Ranges include both ends; a null end is open, on both sides it leaves overlap_to null. Rows with a null key or
    start, or that end before they start, overlap with nothing. Repeated rows give a pair each.

    Both sides meet by (key, cell of days), so a key with very many ranges is spread over its cells, and a pair is taken
    in one cell only: the later of the two starts lies in it. Copies of a row end at the last start of the key on the
    other side, which bounds open ends. Smaller cells suit many short ranges, larger ones few long ranges.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    a = _in_cells(left, right, keys, left_span, right_span[0], cell_days, "_first_a")
    b = _in_cells(right, left, keys, right_span, left_span[0], cell_days, "_first_b")
    (a0, a1), (b0, b1) = [[F.col(c).cast("date") for c in span] for span in (left_span, right_span)]
    meet = (b1.isNull() | (a0 <= b1)) & (a1.isNull() | (b0 <= a1)) & (F.col("_cell") == F.greatest("_first_a", "_first_b"))
    return (a.join(b, [*keys, "_cell"]).where(meet).withColumn("overlap_from", F.greatest(a0, b0)).withColumn("overlap_to", F.least(a1, b1))
            .drop("_cell", "_first_a", "_first_b"))


def periods(days: DataFrame, keys: list[str], day: str, gap: int, measures: list[Column] = ()) -> DataFrame:
    """Runs of days per key with at most `gap` days from one to the next: first_day, last_day, days and the measures.

    Takes one row per key and day, so a key is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    begins = F.coalesce(F.datediff(F.col(day), F.lag(day).over(w)) > gap, F.lit(True))
    numbered = days.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(w))
    return (numbered.groupBy(*keys, "_run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                                                F.count(F.lit(1)).alias("days"), *measures).drop("_run"))
