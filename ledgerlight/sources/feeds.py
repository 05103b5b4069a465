"""Pulls from the source systems: incremental, full, date-range and resuming reads, decoded to the domain schema.

A pull takes the source tables as DataFrames, so the same code reads a JDBC source, a landed parquet copy or
a stream batch. Time and key bounds are plain comparisons on source columns and reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.functions import clean, money as m
from ledgerlight.operators import keyed

LIVE_SERVER, DEMO_SERVER = 2, 1
AMOUNT_CAP = 10_000_000        # fixed value: payments this large are test entries
LOCAL_ZONE = "Europe/Athens"   # fixed value: the zone the reports' day boundaries follow


# ---- bounds ------------------------------------------------------------------------------------------------


def changed_since(df: DataFrame, times: list[str], cutoff: str) -> DataFrame:
    """Rows with any of the change columns at or after the cutoff (lookback pull)."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    return df.where(reduce(lambda a, b: a | b, [F.col(t) >= at for t in times]))


def local_since(df: DataFrame, time: str, day: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Rows whose UTC time falls on or after a local day; the bound is moved, not the column."""
    bound = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(day).cast("timestamp_ntz"))
    return df.where(F.col(time) >= bound)


def after_key(df: DataFrame, keys: list[str], last: list) -> DataFrame:
    """Resume after a key: rows whose key, compared as a row value, is greater than the last one seen."""
    if len(keys) == 1:
        return df.where(F.col(keys[0]) > F.lit(last[0]))
    types = dict(df.dtypes)
    bound = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, last)])
    # the plain bound on the first key reaches the scan, the struct comparison does not
    return df.where((F.col(keys[0]) >= F.lit(last[0]).cast(types[keys[0]])) & (F.struct(*keys) > bound))


def high_water(target: DataFrame, time: str, margin: str = "1 minute", default: str = "1970-01-01") -> Column:
    """Newest time already stored, less a margin, as a scalar; the epoch for an empty target."""
    newest = target.agg(F.max(time)).scalar()
    return F.coalesce(newest - F.expr(f"INTERVAL {margin}"), F.lit(default).cast("timestamp_ntz"))


def since_high_water(source: DataFrame, target: DataFrame, time: str, margin: str = "1 minute") -> DataFrame:
    return source.where(F.col(time) > high_water(target, time, margin))


def resume_after_max(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows with a key greater than the greatest one stored."""
    return source.where(F.col(key) > F.coalesce(target.agg(F.max(key)).scalar(), F.lit(0)))


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a list of ids, whatever its length."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def jdbc_ranges(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options):
    """Reader for a full scan in parallel key ranges (in place of keyset paging by one connection)."""
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
              .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
              .option("fetchsize", 50_000))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader


def read_ids(spark: SparkSession, path: str, column: str = "login") -> DataFrame:
    """Text file of ids, one per line; blank and non-numeric lines are left out."""
    return (spark.read.text(path).select(F.trim("value").try_cast("bigint").alias(column))
            .where(F.col(column).isNotNull()).distinct())


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited export of external values with a header row."""
    return spark.read.schema(schema).option("header", True).csv(path)


# ---- lookups -----------------------------------------------------------------------------------------------


def decode(df: DataFrame, lookups: DataFrame, kind: str, code: str, out: str) -> DataFrame:
    """Left join of one kind of a key/value table on a code column."""
    table = lookups.where(F.col("kind") == kind).select(F.col("key").alias("_key"), F.col("value").alias(out))
    return df.join(table, F.col(code) == F.col("_key"), "left").drop("_key")


def label_table(df: DataFrame, code: str, label: str) -> DataFrame:
    """(code, label) pairs of a code list, codes trimmed and upper case, one label per code."""
    key = F.upper(F.trim(F.col(code).cast("string")))
    return (df.where(F.col(code).isNotNull() & F.col(label).isNotNull())
            .groupBy(key.alias("code")).agg(F.max(F.trim(F.col(label))).alias("label")))


# ---- accounts ----------------------------------------------------------------------------------------------


def local_time(c: Column) -> Column:
    return clean.shift_zone(c, "UTC", LOCAL_ZONE)


def accounts(users: DataFrame, info: DataFrame, totals: DataFrame, apps: DataFrame, cutoff: str | None = None,
             qualified_since: str | None = None, created_since: str | None = None) -> DataFrame:
    """Account rows from users, their extra attributes, their newest totals and the registering app.

    All rows are pulled whatever their test flag; reports filter it, so a flag set later still arrives.
    """
    rows = users.where(F.col("user_id").isNotNull())
    if created_since:
        rows = local_since(rows, "creation_time", created_since)
    rows = rows.join(info.withColumnRenamed("updated", "info_updated"), "user_id", "left")
    if cutoff:
        rows = changed_since(rows, ["last_contact", "updated", "creation_time"], cutoff)
    if qualified_since:
        rows = local_since(rows, "qualification_time", qualified_since)
    rows = (rows.join(totals.where("latest <> 0").select("user_id", "balance", "net_deposit"), "user_id", "left")
            .join(apps, "app_id", "left"))
    score = clean.score_1_to_10(F.col("potential"))
    return rows.select(
        F.col("user_id").alias("account_id"), "is_test", "is_demo", F.col("country"), clean.gender(F.col("gender")).alias("gender"),
        F.col("tracking_campaign").alias("campaign"),
        F.when(F.col("acquisition") == 0, "Sales").otherwise("Retention").alias("account_status"),
        m.assigned_agent("acquisition", "sales_rep", "sales_desk", "retention_rep", "retention_desk").alias("assigned_to"),
        "sales_rep", local_time(F.col("creation_time")).alias("created"), local_time(F.col("qualification_time")).alias("qualified"),
        clean.birth_date(F.col("date_of_birth")).alias("birth_date"), F.coalesce("customer_ref", "user_id").alias("customer_id"),
        F.upper("app_name").alias("regulation"), "balance", "net_deposit", "potential", score.alias("score"))


# ---- payments ----------------------------------------------------------------------------------------------


def payments(rows: DataFrame, platform_accounts: DataFrame, lookups: DataFrame, cutoff: str | None = None,
             confirmed_since: str | None = None, cap: int = AMOUNT_CAP, rejected: bool = False) -> DataFrame:
    """Money rows of live platform accounts with three decoded codes, cents as dollars, absurd amounts out.

    With `rejected` the rows that the cap (or a missing amount) keeps out come instead, for the caller to store.
    """
    if cutoff:
        rows = changed_since(rows, ["updated", "decision_time"], cutoff)
    if confirmed_since:
        rows = local_since(rows, "decision_time", confirmed_since)
    rows = rows.join(platform_accounts.select(F.col("platform_account_id"), F.col("external_id").alias("login"), "is_demo"),
                     "platform_account_id")
    for kind, code, out in (("method", "method_key", "method"), ("status", "status_key", "_status"), ("type", "type_key", "raw_type")):
        rows = decode(rows, lookups, kind, code, out)
    usd = clean.cents(F.col("amount_cents"))
    server = F.when(F.col("is_demo") == 1, DEMO_SERVER).otherwise(LIVE_SERVER)
    kept = F.coalesce(usd < cap, F.lit(False))
    return rows.where((~kept if rejected else kept) & (server == LIVE_SERVER)).select(
        F.col("payment_id").alias("money_id"), F.col("user_id").alias("account_id"), "login",
        F.when(F.col("_status") == "Success", "Approved").otherwise(F.col("_status")).alias("approval"), "raw_type", "method",
        m.deposit_owner("acquisition", "sales_rep", "retention_rep").alias("owner"), F.col("is_ftd").alias("ftd"), usd.alias("usd"),
        local_time(F.col("decision_time")).alias("confirmed"), local_time(F.col("creation_time")).alias("created"),
        F.col("updated").alias("modified"))


# ---- agents ------------------------------------------------------------------------------------------------

HIDDEN_ROLES = ("Affiliate", "Dialer")


def agents(operators: DataFrame, operator_desks: DataFrame, desks: DataFrame, offices: DataFrame, roles: DataFrame,
           cutoff: str | None = None) -> DataFrame:
    """One row per operator over all its desks (greatest value per column), and every desk as a pseudo-agent."""
    rows = operators if cutoff is None else changed_since(operators, ["updated"], cutoff)
    rows = (rows.join(operator_desks, "operator_id", "left").join(desks, "desk_id", "left").join(offices, "office_id", "left")
            .join(roles, "role_id", "left"))
    role = F.col("role_name")
    rows = rows.where(role.isNull() | (~role.isin(*HIDDEN_ROLES) & ~role.like("%Admin")))
    sells = F.coalesce(role.like("%Agent%") | (role == "BDM"), F.lit(True))
    name = F.replace(F.col("full_name"), F.lit("."), F.lit(" "))
    desk, team = F.col("desk_name"), F.trim(F.substring_index("desk_name", "-", 1))
    people = rows.groupBy(F.col("operator_id").alias("agent_id")).agg(
        F.max("full_name").alias("full_name"), F.max("full_name").alias("agent_name"),
        F.max(F.when(F.col("is_active") == 1, "Active").otherwise("Inactive")).alias("status"),
        F.max(F.substring_index(name, " ", 1)).alias("first_name"), F.max(F.substring_index(name, " ", -1)).alias("last_name"),
        F.max("desk_name").alias("desk_name"), F.max(F.when(sells, m.desk_part(desk, 1)).otherwise("")).alias("team"),
        F.max(F.when(sells, m.desk_part(desk, -1)).otherwise("")).alias("department"), F.max(m.desk_part(desk, 2)).alias("desk"),
        F.max(F.when(sells, F.col("office")).otherwise("General")).alias("office"),
        F.max(m.office_name(F.col("office"))).alias("office_name"),
        F.max(F.when(F.lower(team).like("%conversion%"), "Sales").otherwise("Retention")).alias("dept"))
    pseudo = (desks.join(offices, "office_id", "left").select(
        F.col("desk_id").alias("agent_id"), F.col("desk_name").alias("full_name"), F.col("desk_name").alias("agent_name"),
        F.lit("Active").alias("status"), F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("last_name"),
        "desk_name", m.desk_part(desk, 1).alias("team"), m.desk_part(desk, -1).alias("department"), m.desk_part(desk, 2).alias("desk"),
        "office", m.office_name(F.col("office")).alias("office_name"),
        F.when(F.lower(team).like("%conversion%"), "Sales").otherwise("Retention").alias("dept")))
    return people.unionByName(pseudo).distinct()


def directory_agents(rows: DataFrame) -> DataFrame:
    """Agents of the second source, office code decoded, department from the team text."""
    return rows.select(
        "agent_id", F.col("user_name").alias("full_name"), F.col("user_name").alias("agent_name"), "email", "status",
        "department", F.col("department").alias("desk"), F.col("department").alias("desk_name"), F.col("team"), "office",
        m.office_name(F.col("office")).alias("office_name"),
        F.when(F.lower(F.coalesce("team", F.lit(""))).like("%conversion%"), "Sales").otherwise("Retention").alias("dept"))


def operator_names(operators: DataFrame) -> DataFrame:
    """S12."""
    return operators.select(F.col("operator_id").alias("agent_id"), "full_name")


# ---- the rest ----------------------------------------------------------------------------------------------


def trading_accounts(platform_accounts: DataFrame, users: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Login -> account rows with balances in dollars and the owning agent of the account."""
    rows = platform_accounts if cutoff is None else changed_since(platform_accounts, ["updated"], cutoff)
    owners = users.select("user_id", "acquisition", "sales_rep", "sales_desk", "retention_rep", "retention_desk")
    return rows.join(owners, "user_id", "left").select(
        F.col("platform_account_id").alias("bridge_id"), F.col("user_id").alias("account_id"), F.col("external_id").alias("login"),
        clean.cents(F.col("equity_cents")).alias("equity"), clean.cents(F.col("balance_cents")).alias("balance"),
        F.when(F.col("is_demo") == 1, DEMO_SERVER).otherwise(LIVE_SERVER).alias("server_id"),
        m.assigned_agent("acquisition", "sales_rep", "sales_desk", "retention_rep", "retention_desk").alias("assigned_to"),
        F.col("is_deleted").alias("deleted"), F.col("updated").alias("last_update"))


def campaign_rows(campaigns: DataFrame, lookups: DataFrame) -> DataFrame:
    """Campaigns with channel and sub-channel decoded and the marketing group stored with them."""
    rows = decode(campaigns.where(F.col("external_id").isNotNull()), lookups, "channel", "channel_key", "channel")
    rows = decode(rows, lookups, "sub_channel", "sub_channel_key", "sub_channel")
    return rows.select("campaign_id", "name", "channel", "sub_channel",
                       F.when(F.col("is_deleted") == 0, 1).otherwise(0).alias("active"),
                       m.marketing_group(F.col("channel")).alias("marketing_group"))


def target_rows(targets: DataFrame) -> DataFrame:
    """Monthly targets."""
    return targets.select("month", "agent_id", "ftc", "net")


def classification(rows: DataFrame) -> DataFrame:
    """Client scores with their band."""
    score = clean.score_1_to_10(F.col("classification"))
    band = F.when(score.between(6, 10), "High Quality").when(score.between(1, 5), "Low Quality").otherwise("No segmentation")
    return rows.select("account_id", score.alias("score"), band.alias("band"))


def test_ids(rows: DataFrame) -> DataFrame:
    """Accounts another source marks as test."""
    return rows.where("is_test = 1").select(F.col("user_id").alias("account_id"))


# Bonus types by direction.
BONUS_IN = ("FRF Commission", "Bonus")
BONUS_OUT = ("FRF Commission Cancelled", "BonusCancelled")


def bonus_ledger(money: DataFrame, cutoff: str | None = None, after_id: int | None = None) -> DataFrame:
    """Signed bonus amounts per login, by lookback or after an id."""
    rows = money if cutoff is None else changed_since(money, ["modified", "confirmed"], cutoff)
    if after_id is not None:
        rows = after_key(rows, ["money_id"], [after_id])
    inn = (F.col("raw_type") == "Deposit") & F.col("type").isin(*BONUS_IN)
    outt = (F.col("raw_type") == "Withdrawal") & F.col("type").isin(*BONUS_OUT)
    return rows.where((inn | outt) & m.approved()).select(
        "money_id", clean.login_number(F.col("login")).alias("login"),
        F.when(inn, F.col("usd")).otherwise(-F.col("usd")).cast("decimal(18,2)").alias("amount"), "confirmed")


def type_names(money: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, type) pairs, all or for a list of ids."""
    rows = money if ids is None else by_ids(money, ids, "money_id")
    return rows.select("money_id", "type")


def trades(rows: DataFrame, time: str | None = None, since: str | None = None, after_ticket: int | None = None,
           symbol: str = "symbol") -> DataFrame:
    """Buy and sell trades without book-keeping symbols, since a time or after a ticket."""
    rows = rows.where(F.col("cmd").isin(0, 1) & m.trade_symbol(symbol))
    if since:
        rows = rows.where(F.col(time) >= F.lit(since).cast("timestamp_ntz"))
    return rows if after_ticket is None else after_key(rows, ["ticket"], [after_ticket])


def missing(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def open_deals(rows: DataFrame, sentinel: str = m.CLOSED_AFTER) -> DataFrame:
    """Trades without a close time or with the sentinel for it."""
    return rows.where(F.col("close_time").isNull() | (F.col("close_time") <= F.lit(sentinel).cast("timestamp_ntz")))


def deals_utc(rows: DataFrame, since: str | None = None) -> DataFrame:
    """Deals with their platform-local times moved to UTC; the open-deal sentinel stays."""
    out = trades(rows, "sync_time", since)
    return out.withColumns({c: clean.shift_stored(F.col(c)) for c in ("open_time", "close_time")})


def day_range(rows: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """Rows of a range of days."""
    return rows.where(m.between_days(time, first, last))


def newest_per_login(rows: DataFrame, time: str) -> DataFrame:
    """The newest rows per login; rows that share the newest time all stay."""
    return keyed.newest(rows, ["login"], [time], ties=True)


def open_trades(positions: DataFrame) -> DataFrame:
    """Open positions that are trades."""
    return positions.where(F.col("cmd").isin(0, 1) & m.trade_symbol())


def live_figures(logins: DataFrame, users: DataFrame, positions: DataFrame, deals: DataFrame, day: str) -> DataFrame:
    """Balance, credit, floating and closed result of the day for a list of logins."""
    from ledgerlight.plans import equity as eq
    return (logins.select("login").distinct().join(eq.live_balances(users), "login", "left")
            .join(eq.open_floating(positions), "login", "left").join(eq.closed_result(deals, day), "login", "left"))
