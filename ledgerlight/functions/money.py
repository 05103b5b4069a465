"""Predicates and amounts over the money ledger, the account and the agent dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The transaction types that move client money in and out.
MONEY_IN = ("Deposit", "Withdrawal Cancelled")
MONEY_OUT = ("Withdrawal", "Deposit Cancelled")
MONEY_TYPES = MONEY_IN + MONEY_OUT

# Book-keeping symbols that are not trades.
EXCLUDED_SYMBOLS = (
    "Cashback", "CFDRollover", "CommEUR", "CommUSD",
    "CorrectiEUR", "CorrectiGBP", "CorrectiJPY", "Correction",
    "CredExp", "CredExpEUR", "CredExpGBP", "CredExpJPY",
    "Dividend", "DividendEUR", "DividendGBP", "DividendJPY",
    "Dormant", "EarnedCr", "EarnedCrEUR", "FEE", "INACT-FEE",
    "Inactivity", "Rollover", "SPREAD",
    "ZeroingEUR", "ZeroingGBP", "ZeroingJPY", "ZeroingKES",
    "ZeroingNGN", "ZeroingUSD", "ZeroingZAR",
)

CLOSED_AFTER = "1971-01-01"  # a close time on the 1970 epoch marks a deal that is still open


def zero() -> Column:
    return F.lit(0).cast("decimal(20,4)")


def not_deleted(flag: str = "deleted") -> Column:
    """A missing flag counts as live."""
    return F.coalesce(F.col(flag), F.lit(0)) == 0


def approved(flag: str = "deleted") -> Column:
    return (F.col("approval") == "Approved") & not_deleted(flag)


def valid_money(types=MONEY_TYPES) -> Column:
    return approved() & F.col("type").isin(*types) & F.col("account_id").isNotNull()


def not_bonus_comment(comment: str = "comment") -> Column:
    return ~F.lower(F.coalesce(F.col(comment), F.lit(""))).like("%bonus%")


def signed_usd(type_col: str = "type", usd: str = "usd") -> Column:
    return (F.when(F.col(type_col).isin(*MONEY_IN), F.col(usd))
            .when(F.col(type_col).isin(*MONEY_OUT), -F.col(usd)))


def money_in(type_col: str = "type", usd: str = "usd") -> Column:
    return F.when(F.col(type_col).isin(*MONEY_IN), F.col(usd)).otherwise(zero())


def money_out(type_col: str = "type", usd: str = "usd") -> Column:
    return F.when(F.col(type_col).isin(*MONEY_OUT), F.col(usd)).otherwise(zero())


def is_ftd() -> Column:
    return (F.col("type") == "Deposit") & (F.col("ftd") == 1)


def usd_sum(value: Column, scale: int = 4) -> Column:
    """Exact money sum of a fixed width, zero when there is nothing to add."""
    return F.coalesce(F.sum(value), zero()).cast(f"decimal(28,{scale})")


def real_account() -> Column:
    return F.col("is_test") == 0


def live_account() -> Column:
    return real_account() & (F.coalesce(F.col("is_demo"), F.lit(0)) == 0)


def agent_label() -> Column:
    return F.trim(F.coalesce(F.col("agent_name"), F.col("full_name"), F.lit("")))


def named_like(prefix: str, label: Column | None = None) -> Column:
    return (agent_label() if label is None else label).ilike(f"{prefix}%")


def countable_agent() -> Column:
    """Neither a test agent (by shown or full name) nor a duplicate."""
    full = F.trim(F.coalesce(F.col("full_name"), F.lit("")))
    return ~named_like("test") & ~named_like("test", full) & ~named_like("duplicated")


def not_test_agent() -> Column:
    full = F.trim(F.coalesce(F.col("full_name"), F.lit("")))
    return ~named_like("test") & ~named_like("test", full)


def not_department(words=("Retention", "Conversion", "Support", "General")) -> Column:
    text = F.trim(F.coalesce(F.col("department"), F.lit("")))
    return reduce(lambda a, b: a & b, [~text.ilike(f"%{w}%") for w in words])


def between_days(col: str | Column, first: str, last: str) -> Column:
    """Half-open range over whole days: first 00:00 up to, not including, the day after `last`."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= F.lit(first).cast("timestamp_ntz")) & (
        c < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))


def on_or_before(col: str | Column, day: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")


def trade_symbol(symbol: str = "symbol") -> Column:
    return ~F.col(symbol).isin(*EXCLUDED_SYMBOLS)


def closed() -> Column:
    return F.col("close_time") > F.lit(CLOSED_AFTER).cast("timestamp_ntz")


def deal_result() -> Column:
    """Profit + swap + commission of one deal, missing parts as zero."""
    return sum((F.coalesce(F.col(c), zero()) for c in ("commission", "profit", "swap")), zero())


def assigned_agent(status: str, rep: str, desk: str, rep2: str, desk2: str) -> Column:
    """Who owns an account: the sales rep or desk while in acquisition 0, else the retention pair."""
    s = F.col(status)
    return (F.when((s == 0) & (F.col(rep) != 0), F.col(rep))
            .when((s == 0) & (F.col(rep) == 0), F.col(desk))
            .when((s == 1) & (F.col(rep2) != 0), F.col(rep2))
            .otherwise(F.col(desk2)))


def deposit_owner(status: str, sales_rep: str, retention_rep: str) -> Column:
    return (F.when((F.col(status) == 1) | (F.col(sales_rep) == 0), F.col(retention_rep))
            .when((F.col(status) == 0) | (F.col(sales_rep) != 0), F.col(sales_rep)))


# Office code -> office name.
OFFICE_NAMES = {
    "IN": "India", "UY": "Uruguay", "SA": "South Africa", "LAG-NG": "LAG Nigeria", "IL": "Israel",
    "GMT": "GMT", "General": "General", "Global": "General", "DU": "Dubai", "CO": "Columbia",
    "CY": "Cyprus", "BG": "Bulgaria", "ABJ-NG": "ABJ Nigeria", "VN": "Vietnam",
}


def office_name(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in OFFICE_NAMES.items() for x in kv])
    blank = code.isNull() | (F.trim(code) == "")
    return F.when(blank, F.lit("General")).otherwise(F.coalesce(F.try_element_at(pairs, code), code))


# Text found in the channel -> marketing group, first match wins.
MARKETING_GROUPS = (
    ("IB", "IB"), ("PPC", "PPC"), ("Media", "Media"), ("Affiliate", "Affiliates"), ("Direct", "Organic"),
    ("Organic", "Organic"), ("White", "White Label"), ("GMT", "White Label"), ("Refer a friend", "FRF"),
    ("Automation", "Automation"),
)


def first_match(pairs, test, default: Column) -> Column:
    """`when` chain over (condition input, result) pairs; the first that holds wins."""
    (first, *rest) = pairs
    chain = F.when(test(first[0]), F.lit(first[1]))
    for needle, label in rest:
        chain = chain.when(test(needle), F.lit(label))
    return chain.otherwise(default)


def marketing_group(channel: Column) -> Column:
    return first_match(MARKETING_GROUPS, channel.contains, F.lit("Other"))


def desk_part(desk: Column, part: int) -> Column:
    """Piece 1, 2 or -1 of a dash-separated desk name, trimmed at the outer pieces."""
    if part == 2:
        return F.substring_index(F.substring_index(desk, "-", 2), "-", -1)
    return F.trim(F.substring_index(desk, "-", part))
