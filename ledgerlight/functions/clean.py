"""Value cleaning at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def text(c: Column, limit: int | None = None) -> Column:
    """Strip NUL bytes, blank to NULL, optional length cap of the target column."""
    out = F.nullif(F.replace(c, F.lit("\x00"), F.lit("")), F.lit(""))
    return F.substring(out, 1, limit) if limit else out


def whole_number(c: Column) -> Column:
    """Integers that may arrive as text or as a float such as '12.0'."""
    return F.trim(c.cast("string")).try_cast("decimal(38,6)").try_cast("bigint")


def finite(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def login_number(c: Column) -> Column:
    """Logins are text in one table and numbers in the others: normalise once, dirty values to NULL."""
    return F.trim(c.cast("string")).try_cast("bigint")


def order_ticket(c: Column) -> Column:
    """Ticket number in an order reference ('123', '123.', '123.7'); anything else is NULL."""
    shaped = F.when(c.rlike(r"^[0-9]+(\.[0-9]*)?$"), F.rtrim(c, F.lit(".")))
    return F.round(shaped.try_cast("decimal(38,6)")).try_cast("bigint")


def score_1_to_10(c: Column, rounding: bool = False) -> Column:
    """Score text to 1..10 or NULL; truncates by default, `rounding` gives the other rule in use."""
    number = F.trim(c.cast("string")).try_cast("decimal(20,6)")
    whole = (F.round(number) if rounding else F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    whole = whole.cast("int")
    return F.when(whole.between(1, 10), whole)


def birth_date(c: Column) -> Column:
    return F.when(c >= F.lit("1900-01-01").cast("date"), c)


def gender(c: Column) -> Column:
    return F.when(c == 0, "M").when(c == 1, "F").otherwise(c.cast("string"))


def cents(c: Column) -> Column:
    return (c.cast("decimal(20,2)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(20,4)")


def plausible(c: Column, limit: float = 1e8) -> Column:
    """NULL or below the limit in size."""
    return c.isNull() | (F.abs(c) < limit)


def shift_zone(c: Column, from_zone: str, to_zone: str = "UTC") -> Column:
    return F.convert_timezone(F.lit(from_zone), F.lit(to_zone), c)


def to_utc(c: Column, zone: str) -> Column:
    """Local time to UTC; a time that occurs twice at the end of summer time is taken as the later one."""
    first = shift_zone(c, zone)
    second = first + F.expr("INTERVAL 1 HOUR")
    return F.when(shift_zone(second, "UTC", zone) == c, second).otherwise(first)


def shift_stored(c: Column, from_zone: str = "EET", sentinel_before: str = "2000-01-01") -> Column:
    """Shift stored local times to UTC but leave sentinel values alone."""
    return F.when(c > F.lit(sentinel_before).cast("timestamp_ntz"), to_utc(c, from_zone)).otherwise(c)


def apply_schema(df: DataFrame, schema: T.StructType, caps: dict[str, int] | None = None) -> DataFrame:
    """Cast every column of `schema` with try_cast, cleaning text and floats on the way.

    Columns the input lacks become NULL, so older files keep loading after a column is added.
    """
    caps = caps or {}
    have = dict(df.dtypes)
    out = []
    for f in schema.fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if have[f.name] in ("double", "float"):
            c = finite(c)
        if isinstance(f.dataType, T.StringType):
            c = text(c.cast("string"), caps.get(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)) and have[f.name] == "string":
            c = whole_number(c)
        out.append((c if have[f.name] == f.dataType.simpleString() else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*out)


def reject(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined); an unknown outcome is quarantined, never dropped."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)
