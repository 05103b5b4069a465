"""Combining independently aggregated measures, and totals with recomputed ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions.numeric import round_even


def stack_measures(frames: list[DataFrame], keys: list[str], measures: dict[str, str]) -> DataFrame:
    """One row per key over several aggregates that share some of the keys.

    Each frame is already reduced to the keys; they are stacked and summed once instead of being joined one
    after the other, so the combination costs a single shuffle of small rows. `measures` gives name -> type;
    sums fill gaps with zero, types starting with `max ` keep NULL where nothing was measured.
    """
    spec = {n: (t.startswith("max "), t.removeprefix("max ")) for n, t in measures.items()}
    aligned = []
    for f in frames:
        aligned.append(f.select(*keys, *[
            (F.col(n) if n in f.columns else F.lit(None)).cast(t).alias(n) for n, (_, t) in spec.items()]))
    stacked = reduce(lambda x, y: x.unionByName(y), aligned)
    return stacked.groupBy(*keys).agg(*[
        (F.max(n) if keep else F.coalesce(F.sum(n), F.lit(0)).cast(t)).alias(n)
        for n, (keep, t) in spec.items()])


def ratio(num: Column, den: Column, places: int = 2, times: int = 1, empty=0.0) -> Column:
    """num / den * times rounded half to even, or `empty` when there is nothing to divide by."""
    value = round_even(num.cast("double") / den.cast("double") * times, places)
    return F.when(den != 0, value).otherwise(F.lit(empty) if empty is not None else F.lit(None))


def with_total(df: DataFrame, label_column: str, label: str, sums: list[str], blank: list[str] = ()) -> DataFrame:
    """Append one total row: measures summed, labels blanked; ratios are to be added afterwards."""
    total = df.agg(*[F.sum(c).cast(dict(df.dtypes)[c]).alias(c) for c in sums])
    total = total.select(*[
        F.lit(label).alias(c) if c == label_column else
        F.col(c) if c in sums else F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in df.columns])
    return df.unionByName(total)
