"""Derivation jobs (D1-D11): derived tables rebuilt from the stored ones."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.functions import buckets as b, clean, money as m, tiers, typing
from ledgerlight.functions.calendar import as_date, month_start
from ledgerlight.operators import keyed, merge
from ledgerlight.plans.views import FTD100_THRESHOLD

CORRUPT = 1e8                 # fixed value: floating results this large are data errors


def threshold_clients(money: DataFrame, accounts: DataFrame, threshold=FTD100_THRESHOLD, piece_rows: int | None = None) -> DataFrame:
    """Clients whose net running total stands at the threshold.

    Sales accounts are valued at their latest money row. Others are valued at the newest row up to the
    cutoff: the later of qualification and the first time the total reached the threshold. A running total at
    a given row is the sum up to it, so both values are plain sums with a max for the row; only the first
    crossing, needed for qualified non-sales accounts, looks at the order of the rows; `piece_rows` is for ledgers
    in which an hour of one account may be too much for a task.
    """
    ledger = (money.where(m.valid_money())
              .select("account_id", "confirmed", "money_id", "owner", m.signed_usd().alias("amount")))
    acc = accounts.where(m.real_account()).select(
        "account_id", "account_status", "qualified", "assigned_to")
    key = keyed.order_key("confirmed", "money_id")
    latest = ledger.groupBy("account_id").agg(F.sum("amount").alias("net_now"), F.max("confirmed").alias("latest_at"),
                                              F.max_by("owner", key).alias("latest_owner"))
    crossed = keyed.first_crossing(ledger, ["account_id"], "confirmed", "money_id", "amount", threshold, piece_rows=piece_rows)
    needs = acc.where((F.col("account_status") != "Sales") & F.col("qualified").isNotNull())
    cutoffs = (needs.select("account_id", "qualified").join(crossed, "account_id", "left")
               .select("account_id", F.greatest("qualified", "crossed_at").alias("cutoff")))
    at_cutoff = keyed.value_at_cutoff(ledger, cutoffs, ["account_id"], "confirmed", "cutoff", "amount",
                                      ["confirmed", "money_id"], ["confirmed", "owner"])
    at_cutoff = at_cutoff.select("account_id", F.col("total").alias("net_cut"),
                                 F.col("confirmed").alias("cut_at"), F.col("owner").alias("cut_owner"))
    sales = F.col("account_status") == "Sales"

    def choose(a: str, c: str) -> Column:
        return F.when(sales, F.col(a)).otherwise(F.col(c))

    amount = choose("net_now", "net_cut")
    return (acc.join(latest, "account_id").join(at_cutoff, "account_id", "left")
            .where(amount >= threshold)
            .select("account_id", "account_status", "qualified", "assigned_to",
                    choose("latest_at", "cut_at").alias("reached_at"),
                    amount.cast("decimal(18,2)").alias("reached_amount"),
                    choose("latest_owner", "cut_owner").alias("owner"),
                    F.col("net_now").cast("decimal(18,2)").alias("net_now"),
                    F.when(sales | F.col("qualified").isNull(), F.col("net_now")).otherwise(F.col("net_cut"))
                    .cast("decimal(18,2)").alias("net_until_qualified")))


def typed_money(money: DataFrame, balance_ops: DataFrame, only: Column | None = None) -> DataFrame:
    """Every row's type from the rule table, with the platform comment of its order looked up.

    `only` re-types the rows it selects (changed ids, or rows without a type); the others keep theirs.
    """
    notes = (balance_ops.where("cmd = 6").groupBy(F.col("ticket").alias("_ticket"))
             .agg(F.min("comment").alias("op_comment")))   # one note per ticket, whatever the source
    rows = money.withColumn("_ticket", clean.order_ticket(F.col("order_ref"))).join(notes, "_ticket", "left")
    label = typing.classify()
    if only is not None:
        label = F.when(only, label).otherwise(F.col("type"))
    return rows.withColumn("type", label).drop("_ticket", "op_comment")


def equity_floor(balance: str, floating: str, bonus: Column, clamp_bonus: bool = False) -> Column:
    """Equity without bonus, floored at zero; `clamp_bonus` ignores negative bonus balances."""
    net = F.coalesce(F.col(balance), m.zero()) + F.coalesce(F.col(floating), m.zero())
    off = F.coalesce(bonus, m.zero())
    if clamp_bonus:
        off = F.greatest(off, m.zero())
    return F.round(F.when(net <= 0, m.zero()).otherwise(F.greatest(net - off, m.zero())), 2).cast("decimal(18,2)")


def test_logins(bridge: DataFrame, accounts: DataFrame, live_only: bool = True) -> DataFrame:
    """One row per login: 1 when any of its accounts is a test account."""
    rows = bridge.where(m.not_deleted()) if live_only else bridge
    return (rows.select(F.expr("try_cast(login AS bigint)").alias("login"), "account_id")
            .where("login IS NOT NULL").join(accounts.select("account_id", "is_test"), "account_id")
            .groupBy("login").agg(F.max("is_test").alias("is_test")))


def equity_by_day(equity: DataFrame) -> DataFrame:
    """Newest equity row per login and day."""
    return keyed.newest(equity.withColumn("day", F.to_date("at")), ["login", "day"], ["at", "source"])


def bonus_balance(equity_days: DataFrame, bonuses: DataFrame) -> DataFrame:
    """(login, day) rows with the bonus balance up to that day.

    Bonus sums per day and equity days are stacked and run over per login: a window over calendar days, not a
    join of every day with every earlier bonus.
    """
    per_day = (bonuses.groupBy("login", F.to_date("confirmed").alias("day"))
               .agg(F.sum("amount").cast("decimal(28,4)").alias("_bonus")))
    marks = equity_days.withColumn("_bonus", m.zero().cast("decimal(28,4)")).withColumn("_eq", F.lit(True))
    filler = per_day.select(*[
        F.col(c) if c in ("login", "day", "_bonus") else
        F.lit(False).alias(c) if c == "_eq" else F.lit(None).cast(dict(marks.dtypes)[c]).alias(c)
        for c in marks.columns])
    w = keyed.Window.partitionBy("login").orderBy("day").rangeBetween(
        keyed.Window.unboundedPreceding, keyed.Window.currentRow)
    return (marks.unionByName(filler).withColumn("bonus", F.sum("_bonus").over(w))
            .where("_eq").drop("_eq", "_bonus"))


def equity_snapshots(equity: DataFrame, bonuses: DataFrame, bridge: DataFrame, accounts: DataFrame,
                     first: str | None = None, last: str | None = None, clamp_bonus: bool = False) -> DataFrame:
    """D3: end and start equity without bonus per login and day, for a whole range of days in one job.

    The start of a day is the end of the same login's previous calendar day, so it is a lag, not a second run.
    """
    days = equity_by_day(equity)
    if first:   # one day more at the front for its start value
        days = days.where(F.col("day") >= F.date_sub(F.lit(first).cast("date"), 1))
    if last:
        days = days.where(F.col("day") <= F.lit(last).cast("date"))
    logins = test_logins(bridge, accounts).where("is_test = 0").select("login")
    valued = (bonus_balance(days.select("login", "day", "balance", "floating"), bonuses)
              .join(logins, "login")
              .select("login", "day", equity_floor("balance", "floating", F.col("bonus"), clamp_bonus).alias("end_eez")))
    out = keyed.previous_day(valued, ["login"], "day", {"end_eez": "start_eez"})
    if first:
        out = out.where(F.col("day") >= F.lit(first).cast("date"))
    return out.select("login", "day", "end_eez", "start_eez")


def drop_corrupt(equity: DataFrame, limit: float = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) equity rows."""
    return clean.reject(equity, clean.plausible(F.col("floating"), limit))


def repair_snapshots(equity: DataFrame, bonuses: DataFrame, bridge: DataFrame, accounts: DataFrame,
                     last: str, days: int = 5) -> DataFrame:
    """Drop corrupt equity rows, then recompute the last days' snapshots."""
    usable, _ = drop_corrupt(equity)
    first = date.fromordinal(as_date(last).toordinal() - days + 1).isoformat()
    return equity_snapshots(usable, bonuses, bridge, accounts, first, last)


def match_agents(master: DataFrame, agents: DataFrame) -> DataFrame:
    """Fill missing agent ids by e-mail, ignoring case and outer spaces."""
    mail = F.lower(F.trim("email"))
    ids = agents.groupBy(mail.alias("_mail")).agg(F.min("agent_id").alias("_found")).where("_mail <> ''")
    return (master.withColumn("_mail", mail).join(ids, "_mail", "left")
            .withColumn("agent_id", F.coalesce("agent_id", "_found")).select(*master.columns))


def _targets(master: DataFrame, months: Column, as_of: date, exempt_prefixes) -> DataFrame:
    rows = (master.where(F.col("email").isNotNull() & F.col("start_date").isNotNull()
                         & (F.col("start_date") <= F.lit(as_of)))
            .withColumn("report_month", F.explode(months)))
    tenure = tiers.tenure_months(F.col("report_month"), F.col("start_date")).cast("int")
    return rows.withColumn("tenure_months", tenure).select(
        "agent_name", "office_name", "email", "start_date", "target_group", "agent_id", "report_month",
        "tenure_months",
        tiers.net_target(F.col("tenure_months"), F.col("office_name"), F.col("agent_name"), exempt_prefixes)
        .alias("net_target"),
        tiers.ftd100_target(F.col("tenure_months")).alias("ftd100_target"))


def backfill_targets(master: DataFrame, agents: DataFrame, history: DataFrame | None, as_of: str,
                     exempt_prefixes=()) -> DataFrame:
    """One target row per agent and month since the start month; existing rows stay as they are."""
    now = as_date(as_of)
    months = F.sequence(F.trunc("start_date", "month"), F.lit(month_start(now)), F.expr("INTERVAL 1 MONTH"))
    new = _targets(match_agents(master, agents), months, now, exempt_prefixes)
    return new if history is None else merge.insert_missing(history, new, ["email", "report_month"])


def append_month(master: DataFrame, agents: DataFrame, history: DataFrame, as_of: str,
                 exempt_prefixes=()) -> DataFrame:
    """The current month for active agents, and late agent matches carried into the history."""
    now = as_date(as_of)
    matched = match_agents(master, agents)
    ids = (matched.where(F.col("agent_id").isNotNull())
           .groupBy(F.lower(F.trim("email")).alias("_mail")).agg(F.min("agent_id").alias("_found")))
    known = (history.withColumn("_mail", F.lower(F.trim("email"))).join(ids, "_mail", "left")
             .withColumn("agent_id", F.coalesce("agent_id", "_found")).select(*history.columns))
    new = _targets(matched.where("is_active"), F.array(F.lit(month_start(now))), now, exempt_prefixes)
    return merge.insert_missing(known, new, ["email", "report_month"])


def unmatched_agents(master: DataFrame) -> DataFrame:
    """Members without an agent id."""
    return (master.where(F.col("agent_id").isNull())
            .select("agent_name", "email", "target_group", "start_date").orderBy("target_group", "agent_name"))


def match_counts(master: DataFrame) -> DataFrame:
    return master.agg(F.count("agent_id").alias("matched"),
                      F.count_if(F.col("agent_id").isNull()).alias("unmatched"))


# Holidays that recur every year.
RECURRING = (("01-01", "New Year's Day"), ("12-24", "Christmas Eve"), ("12-25", "Christmas Day"),
             ("12-26", "Boxing Day"), ("12-31", "New Year's Eve"))


def recurring_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """The recurring days of a span of years."""
    each = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(n).alias("description")) for d, n in RECURRING])
    return (spark.range(first_year, last_year + 1).select(F.col("id").alias("y"), F.explode(each).alias("h"))
            .select(F.to_date(F.concat_ws("-", F.col("y").cast("string"), F.col("h.d"))).alias("holiday"),
                    F.col("h.description").alias("description")))


def seed_holidays(holidays: DataFrame, first_year: int, last_year: int) -> DataFrame:
    return merge.insert_missing(holidays, recurring_holidays(holidays.sparkSession, first_year, last_year),
                                ["holiday"])


def agent_scores(targets: DataFrame, agents: DataFrame) -> DataFrame:
    """Target rows with the agent's name, Unknown where there is none."""
    names = agents.select(F.col("agent_id").cast("string").alias("agent_id"), "full_name")
    return (targets.join(names, "agent_id", "left")
            .select(F.col("month").alias("report_date"), "agent_id",
                    F.coalesce("full_name", F.lit("Unknown")).alias("full_name"), "ftc", "net"))


def month_counts(df: DataFrame, time: str, name: str) -> DataFrame:
    return df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias(name))


def incomplete_months(local: DataFrame, source: DataFrame, time: str) -> DataFrame:
    """Months in which the local copy holds fewer rows than the source, as date ranges to pull again."""
    both = (month_counts(source, time, "source_rows").join(month_counts(local, time, "local_rows"), "month", "left")
            .fillna(0, ["local_rows"]))
    start = F.to_date(F.concat("month", F.lit("-01")))
    return (both.where("local_rows < source_rows")
            .select("month", "source_rows", "local_rows", start.alias("date_from"), F.last_day(start).alias("date_to")))


def new_members(members: DataFrame, agents: DataFrame) -> DataFrame:
    """Dimension members for active agents that have none yet, then deactivation of inactive ones."""
    mail = F.coalesce(F.nullif(F.trim("email"), F.lit("")),
                      F.concat(F.col("agent_id").cast("string"), F.lit("@agent.local")))
    name = F.coalesce(F.nullif(F.trim("agent_name"), F.lit("")), F.nullif(F.trim("full_name"), F.lit("")),
                      F.col("agent_id").cast("string"))
    fresh = (agents.where("status = 'Active'").join(members.select("agent_id"), "agent_id", "left_anti")
             .select("agent_id", mail.alias("email"), name.alias("full_name"), F.lit("agent").alias("role"),
                     F.lit(True).alias("is_active")))
    fresh = fresh.join(members.select("email"), "email", "left_anti").dropDuplicates(["email"])
    return merge.deactivate(members.unionByName(fresh.select(*members.columns)), agents, "agent_id")


def backfill_scores(accounts: DataFrame, as_of: str) -> DataFrame:
    """P10: score by age for live accounts that have a birth date but no score."""
    due = F.col("birth_date").isNotNull() & m.live_account() & ~b.scored(F.col("score"))
    return accounts.withColumn("score", F.when(due, b.score_by_age(F.col("birth_date"), as_of))
                               .otherwise(F.col("score")))
