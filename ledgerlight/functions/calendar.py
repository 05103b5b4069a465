"""Working days, run rates and period bounds."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions.numeric import round_even


def as_date(d: str | date) -> date:
    return d if isinstance(d, date) else date.fromisoformat(d)


def month_start(d: str | date) -> date:
    return as_date(d).replace(day=1)


def next_month(d: str | date) -> date:
    return (month_start(d) + timedelta(days=32)).replace(day=1)


def month_end(d: str | date) -> date:
    return next_month(d) - timedelta(days=1)


def quarter_bounds(year: int, quarter: int) -> tuple[date, date, date]:
    """(first day, last day, first day after) of a quarter."""
    first = date(year, 3 * quarter - 2, 1)
    after = next_month(date(year, 3 * quarter, 1))
    return first, after - timedelta(days=1), after


def weekdays(first: Column, last: Column) -> Column:
    """Mondays to Fridays in an inclusive range; zero when it is empty."""
    days = F.filter(F.sequence(first, last), lambda d: F.weekday(d) < 5)
    return F.when(last < first, F.lit(0)).otherwise(F.size(days))


def working_days(first: str | date, last: str | date, holidays: DataFrame) -> Column:
    """Weekdays minus the holidays that fall on one, as a scalar column."""
    a, b = F.lit(as_date(first)), F.lit(as_date(last))
    off = (holidays.where(F.col("holiday").between(a, b) & (F.weekday("holiday") < 5))
           .agg(F.count_distinct("holiday")))
    return weekdays(a, b) - off.scalar()


def run_rate(value: Column, passed: Column, total: Column, places: int = 0) -> Column:
    """Projection to the whole month; the report layer rounds half to even."""
    return round_even(value.cast("double") / F.greatest(passed, F.lit(1)) * total, places)


def progress(first: str, last: str, today: str, holidays: DataFrame) -> dict[str, Column]:
    """Working-day figures of a report range."""
    start, stop, now = as_date(first), as_date(last), as_date(today)
    total = working_days(start, month_end(start), holidays)
    passed = working_days(start, min(stop, now), holidays)
    full = working_days(month_start(start), month_end(start), holidays)
    in_range = working_days(start, stop, holidays)
    ratio = (F.lit(1.0) if start.day == 1 else
             F.when(full == 0, F.lit(1.0)).otherwise(round_even(in_range / full, 6)))
    return {"working_days": total, "working_days_passed": passed, "working_days_left": total - passed,
            "wd_in_range": in_range, "target_ratio": ratio}


def last_or_first(day: Column, first: str, last: str) -> Column:
    """Days of a range as a report on it tells them apart: `last` itself, `first` for all others."""
    a, z = F.lit(first).cast("date"), F.lit(last).cast("date")
    return F.when(day == z, z).otherwise(a)


def day_in_range(day: Column, first: str, last: str) -> Column:
    """The same for any day, NULL outside the range."""
    return F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), last_or_first(day, first, last))


def period_start(at: Column, period: str) -> Column:
    """First day of the day, month or year."""
    return F.to_date(at) if period == "day" else F.trunc(at, period).cast("date")
