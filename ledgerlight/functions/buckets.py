"""Age, aging and score buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN = "(Unknown)"
UNASSIGNED = "(Unassigned)"

# Fixed values: (first day, last day or None, label); the position gives the sort key.
AGING = (
    (0, 7, "0 - 7 days"), (8, 14, "8 - 14 days"), (15, 30, "15 - 30 days"), (31, 60, "31 - 60 days"),
    (61, 90, "61 - 90 days"), (91, 120, "91 - 120 days"), (121, None, "120+ days"),
)
# Client age groups of the reports, and those of the regulatory return.
AGE_GROUPS = (
    (18, 24, "18-24"), (25, 29, "25-29"), (30, 34, "30-34"), (35, 39, "35-39"), (40, 44, "40-44"),
    (45, 49, "45-49"), (50, None, "50+"),
)
REGULATORY_AGES = (
    (None, 17, "under_18"), (18, 25, "18_25"), (26, 35, "26_35"), (36, 45, "36_45"), (46, 55, "46_55"),
    (56, 65, "56_65"), (66, None, "over_65"),
)
# Score used when a client has none; the nightly backfill also scores the under-25s.
AGE_SCORES = ((25, 29, 4), (30, 34, 5), (35, 44, 6), (45, None, 7))
AGE_SCORES_BACKFILL = ((None, 24, 3),) + AGE_SCORES
SEGMENTS = {"1": "A", "2": "B", "3": "C", "4": "A+"}
SEGMENT_AGES = ((None, 24, "C"), (25, 34, "B"), (35, 49, "A"), (50, None, "A+"))


def day(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def age_years(birth: Column, on: str | Column) -> Column:
    """Calendar age: one less while the birthday of the year is still ahead."""
    d = day(on)
    before_birthday = F.month(d) * 100 + F.dayofmonth(d) < F.month(birth) * 100 + F.dayofmonth(birth)
    return F.year(d) - F.year(birth) - F.when(before_birthday, 1).otherwise(0)


def pick(value: Column, ranges, otherwise=None) -> Column:
    """Label of the first (low, high, label) range holding the value."""
    chain = None
    for low, high, label in ranges:
        if low is None:
            test = value <= high
        elif high is None:
            test = value >= low
        else:
            test = value.between(low, high)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(otherwise)) if otherwise is not None else chain


def _ordinals(ranges):
    return [(lo, hi, i + 1) for i, (lo, hi, _) in enumerate(ranges)]


def days_since(at: Column, on: str | Column) -> Column:
    return F.datediff(day(on), F.to_date(at))


def aging_bucket(qualified: Column, on: str) -> Column:
    return pick(days_since(qualified, on), AGING, UNKNOWN)


def aging_sort(qualified: Column, on: str) -> Column:
    return pick(days_since(qualified, on), _ordinals(AGING), 99)


def aging_filter(qualified: Column, on: str, labels) -> Column | None:
    """OR of the chosen buckets; none or all chosen means no filter."""
    wanted = [r for r in AGING if r[2] in set(labels or ())]
    if not wanted or len(wanted) == len(AGING):
        return None
    return pick(days_since(qualified, on), [(lo, hi, True) for lo, hi, _ in wanted], False)


def age_group(birth: Column, on: str) -> Column:
    return pick(age_years(birth, on), AGE_GROUPS, UNKNOWN)


def age_sort(birth: Column, on: str) -> Column:
    return pick(age_years(birth, on), _ordinals(AGE_GROUPS), 99)


def score_or_age(score: Column, birth: Column, on: str | Column, ages=AGE_SCORES) -> Column:
    """The client's score when positive, else one by age, else NULL."""
    return F.when(score > 0, score).otherwise(pick(age_years(birth, on), ages))


def score_by_age(birth: Column, on: str | Column) -> Column:
    return pick(age_years(birth, on), AGE_SCORES_BACKFILL)


def scored(score: Column) -> Column:
    return F.coalesce(score.between(1, 10), F.lit(False))


def score_band(score: Column) -> Column:
    return (F.when(score.between(6, 10), "High Quality").when(score.between(1, 5), "Low Quality")
            .otherwise("No segmentation"))


def score_filter(score: Column, bands=(), values=()) -> Column | None:
    """Any of the bands (high, low, none), and one of the values when given."""
    tests = {"high": score.between(6, 10), "low": score.between(1, 5), "none": ~scored(score)}
    out = None
    for b in bands:
        if b in tests:
            out = tests[b] if out is None else out | tests[b]
    values = [v for v in values if 1 <= v <= 10]
    if values:
        out = score.isin(*values) if out is None else out & score.isin(*values)
    return out


def segment_label(code: Column, score: Column, birth: Column, on: str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])
    by_age = ((code.isNull() | code.isin("0", "17")) & ~scored(score) & birth.isNotNull())
    return (F.when(code.isin(*SEGMENTS), F.try_element_at(known, code))
            .when(by_age, pick(age_years(birth, on), SEGMENT_AGES))
            .when(code == "17", "Unverified")
            .otherwise(UNASSIGNED))


def quality_label(score: Column, birth: Column, on: str | Column) -> Column:
    """High from score 6 or, without a score, from age 30; N/A when neither is known."""
    return (F.when(score.between(6, 10), "High").when(score.between(1, 5), "Low")
            .when(age_years(birth, on) >= 30, "High").when(birth.isNotNull(), "Low").otherwise("N/A"))
