"""Rounding as the report layer does it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(value: Column, places: int = 0) -> Column:
    """Half-to-even rounding of the binary value.

    `bround` rounds the shortest decimal text of a double, which turns values just above a half into ties;
    reports round the stored binary value.
    """
    scale = F.lit(float(10 ** places))
    return F.rint(value.cast("double") * scale) / scale
