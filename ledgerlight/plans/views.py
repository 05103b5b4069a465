"""Pre-aggregated views the reports read (V1-V8) and their build order (V9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import calendar as cal, money as m, tiers
from ledgerlight.operators import deals as dl, keyed

FULL_AMOUNT = 240            # fixed value: FTD100 client counted in full from this amount
STD_THRESHOLD = 240          # fixed value: a later deposit counts as second deposit from this total
FTD100_THRESHOLD = 95        # fixed value: running total that makes an FTD100 client

PICK_AGENT = ["agent_id", "agent_name", "full_name"]


def money_by_account_day(money: DataFrame, where: Column | None = None, bonus_comments: bool = True) -> DataFrame:
    """Valid money pre-aggregated to (account, owner, day).

    Every per-agent view starts here: the ledger is reduced map-side before it meets the account table, and
    distinct-account counts become sums of flags because an account appears once per owner and day.
    """
    rows = money.where(m.valid_money())
    if not bonus_comments:
        rows = rows.where(m.not_bonus_comment())
    if where is not None:
        rows = rows.where(where)
    return rows.groupBy("account_id", "owner", F.to_date("confirmed").alias("tx_date")).agg(
        m.usd_sum(m.money_in()).alias("deposit_usd"), m.usd_sum(m.money_out()).alias("withdrawal_usd"),
        F.count_if(m.is_ftd()).alias("ftd_count"),
        m.usd_sum(F.when(m.is_ftd(), F.col("usd"))).alias("ftd_usd"))


def daily_kpis(money: DataFrame, accounts: DataFrame, agents: DataFrame | None,
               account_filter: Column | None = None, bonus_comments: bool = True,
               span: tuple[str, str] | None = None) -> DataFrame:
    """V1: (agent, transaction day, qualification day) with net, deposits, withdrawals, FTD and FTC.

    FTC is the count of distinct accounts within each such cell. `agents` None leaves test agents in;
    `account_filter` and `bonus_comments=False` give the filtered form of the reports. `span` (first and last day of
    a report) adds up the cells of days that the report does not tell apart, see cal.day_in_range.
    """
    def told(day: Column) -> Column:
        return cal.day_in_range(day, *span) if span else day

    acc = accounts.where(m.real_account())
    if account_filter is not None:
        acc = acc.where(account_filter)
    acc = acc.select("account_id", told(F.to_date("qualified")).alias("qual_date"))
    out = (money_by_account_day(money, bonus_comments=bonus_comments).join(acc, "account_id")
           .groupBy(F.col("owner").alias("agent_id"), told(F.col("tx_date")).alias("tx_date"), "qual_date")
           .agg(F.sum(F.col("deposit_usd") - F.col("withdrawal_usd")).cast("decimal(28,4)").alias("net_usd"),
                F.sum("deposit_usd").cast("decimal(28,4)").alias("deposit_usd"),
                F.sum("withdrawal_usd").cast("decimal(28,4)").alias("withdrawal_usd"),
                F.sum("ftd_count").alias("ftd_count"),
                F.count_if(F.col("ftd_count") > 0).alias("ftc_count"),
                F.sum("ftd_usd").cast("decimal(28,4)").alias("ftd_usd")))
    if agents is None:
        return out
    names = agents.select(*PICK_AGENT)
    return (out.join(names, "agent_id", "left").where(~m.named_like("test"))
            .select(*out.columns))


def traded_notional(deals: DataFrame, positions: DataFrame, floor_day: str | None,
                    first_entry_only: bool = False, span: tuple[str, str] | None = None) -> DataFrame:
    """(login, opening day) notional of open positions and of closed deals dated by their entry.

    Both are added up together, once: a task then holds one table of sums and not one for each side and for both.
    `span` (first and last day of a report) leaves out other days and adds up those that the report does not tell
    apart, see cal.last_or_first: entries and sums are then few for a position or login, however long the report's range.
    """
    opened, within = F.to_date("open_time"), None
    if span:
        opened, within = cal.last_or_first(opened, *span), m.between_days("open_time", *span)
        positions = positions.where(within)
    pos = positions.select("login", opened.alias("open_date"), "notional",
                           F.when(F.col("notional") > 0, 1).otherwise(0).alias("has_notional"))
    closed = dl.matched_rows(deals, opened, "open_date", first_entry_only, within).select(pos.columns)
    both = pos.unionByName(closed)
    if floor_day:
        both = both.where(F.col("open_date") >= F.lit(floor_day).cast("date"))
    return both.groupBy("login", "open_date").agg(
        F.sum("notional").cast("decimal(28,4)").alias("notional"), F.max("has_notional").alias("has_notional"))


def login_accounts(bridge: DataFrame, accounts: DataFrame, live_only: bool = False) -> DataFrame:
    """Login -> non-test account pairs; a login on several bridge rows keeps them all."""
    rows = bridge.where(F.col("account_id").isNotNull())
    if live_only:
        rows = rows.where(m.not_deleted())
    rows = rows.select(F.expr("try_cast(login AS bigint)").alias("login"), "account_id").where("login IS NOT NULL")
    return rows.join(accounts.where(m.real_account()), "account_id")


def volume_stats(deals: DataFrame, positions: DataFrame, bridge: DataFrame, accounts: DataFrame,
                 agents: DataFrame, floor_day: str | None, first_entry_only: bool = False,
                 span: tuple[str, str] | None = None) -> DataFrame:
    """V2: (agent, account, opening day) notional and whether any of it is positive; `span` as in traded_notional."""
    owners = login_accounts(bridge, accounts.select("account_id", "assigned_to", "is_test"))
    names = agents.select(*PICK_AGENT)
    return (traded_notional(deals, positions, floor_day, first_entry_only, span)
            .join(owners.select("login", "account_id", F.col("assigned_to").alias("agent_id")), "login")
            .groupBy("agent_id", "account_id", "open_date")
            .agg(F.sum("notional").cast("decimal(28,4)").alias("notional_usd"),
                 F.max("has_notional").alias("has_positive_notional"))
            .join(names, "agent_id", "left").where(~m.named_like("test"))
            .select("agent_id", "account_id", "open_date", "notional_usd", "has_positive_notional"))


def sales_bonuses(threshold_clients: DataFrame) -> DataFrame:
    """V3: (agent, moment the threshold was reached): client counts in full and half, net, amount bonus."""
    amount = F.col("reached_amount")
    per_client = (threshold_clients.where(F.col("owner").isNotNull())
                  .select(F.col("owner").alias("agent_id"), "reached_at", "account_id", amount,
                          "net_until_qualified"))
    # one row per account already, so distinct accounts are plain counts
    return per_client.groupBy("agent_id", "reached_at").agg(
        F.count("account_id").alias("ftd100_count"),
        F.count_if(amount >= FULL_AMOUNT).alias("ftd100_full_count"),
        F.count_if(amount < FULL_AMOUNT).alias("ftd100_half_count"),
        m.usd_sum(F.col("net_until_qualified")).alias("total_sales_net"),
        F.sum(tiers.amount_bonus(amount)).alias("ftd_amount_bonus"))


def department_group() -> Column:
    """sales, retention or other, from the agent's attributes."""
    full = F.trim(F.coalesce(F.col("full_name"), F.lit("")))
    named = ~m.named_like("duplicated") & ~m.named_like("test", full)
    return (F.when((F.col("dept") == "Sales") & (F.col("team") == "Conversion") & named, "sales")
            .when((F.col("dept") == "Retention") & named & m.not_department(), "retention")
            .otherwise("other"))


def run_rate_base(kpis: DataFrame, agents: DataFrame) -> DataFrame:
    """V4: V1 by department group and over all agents, in one pass.

    Rows of known agents count in their group and in `all`; rows without an agent only in `all`.
    """
    tagged = agents.select("agent_id", department_group().alias("_tag"))
    groups = F.when(F.col("_tag").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.col("_tag")))
    return (kpis.join(tagged, "agent_id", "left")
            .select(F.explode(groups).alias("dept_group"), "tx_date", "qual_date", "net_usd", "deposit_usd",
                    "ftd_count", "ftc_count")
            .groupBy("dept_group", "tx_date", "qual_date")
            .agg(*[F.sum(c).cast("decimal(28,4)").alias(c) for c in ("net_usd", "deposit_usd")],
                 *[F.sum(c).alias(c) for c in ("ftd_count", "ftc_count")]))


def account_stats(accounts: DataFrame, as_of: str) -> DataFrame:
    """V5: new leads and live accounts of the day and of the month so far; one row."""
    day = F.lit(as_of).cast("date")
    made, live = F.to_date("created"), F.col("birth_date").isNotNull()
    today, month = made == day, made >= F.trunc(day, "month")
    return accounts.where(m.live_account() & F.col("created").isNotNull()).agg(
        F.count_if(today).alias("new_leads_today"), F.count_if(month).alias("new_leads_month"),
        F.count_if(today & live).alias("new_live_today"), F.count_if(month & live).alias("new_live_month"))


def second_deposit_clients(money: DataFrame, accounts: DataFrame, threshold=STD_THRESHOLD, piece_rows: int | None = None) -> DataFrame:
    """V6: accounts whose deposits reached the threshold, and their first deposit after that moment."""
    deposits = money.where(m.valid_money(m.MONEY_IN)).select("account_id", "confirmed", "money_id", "usd")
    acc = accounts.where(m.real_account()).select("account_id", "assigned_to")
    crossed = keyed.first_crossing(deposits, ["account_id"], "confirmed", "money_id", "usd", threshold, piece_rows=piece_rows)
    # all uses of the crossings read their time, also where it is dropped later: Spark then computes them once
    reached = crossed.where("crossed_at IS NOT NULL").join(acc, "account_id")
    later = keyed.first_after(deposits, reached.select("account_id", "crossed_at"), ["account_id"], "confirmed", "crossed_at",
                              "second_deposit_at")
    return reached.join(later, "account_id", "left").select(
        "account_id", F.col("second_deposit_at").isNotNull().cast("int").alias("has_second_deposit"),
        "second_deposit_at", F.col("assigned_to").alias("agent_id"))


def retention_traders(volume: DataFrame) -> DataFrame:
    """V7: (day, account, agent) of accounts that opened positive notional that day.

    The source of this view is not published with its consumers; it is defined here on V2, whose grain makes
    the rows distinct already.
    """
    return volume.where("has_positive_notional = 1").select(
        F.col("open_date").alias("day"), "account_id", "agent_id")


def resolved_deals(deals: DataFrame, first_entry_only: bool = False) -> DataFrame:
    """V8: closed notional by login and entry time; `pairs` counts the matched deal pairs behind a row.

    All consumers sum the notional by login and opening time, so pairs are aggregated at that grain.
    """
    return dl.matched_volume(deals, F.col("open_time"), "open_time", first_entry_only)


# V9: view -> what it is built from
DEPENDENCIES: dict[str, tuple[str, ...]] = {
    "threshold_clients": ("money", "accounts"), "daily_kpis": ("money", "accounts", "agents"),
    "volume_stats": ("deals", "positions", "bridge", "accounts", "agents"),
    "sales_bonuses": ("threshold_clients",), "run_rate_base": ("daily_kpis", "agents"),
    "account_stats": ("accounts",), "second_deposit_clients": ("money", "accounts"),
    "retention_traders": ("volume_stats",), "resolved_deals": ("deals",),
}


def build_order(changed: set[str] | None = None) -> list[str]:
    """Views in dependency order; with `changed` tables only those that depend on one of them."""
    order: list[str] = []
    while len(order) < len(DEPENDENCIES):
        ready = [v for v, need in DEPENDENCIES.items()
                 if v not in order and all(n not in DEPENDENCIES or n in order for n in need)]
        if not ready:
            raise ValueError("cyclic view dependencies")
        order += ready
    if changed is None:
        return order
    dirty = set(changed)
    for v in order:
        if dirty & set(DEPENDENCIES[v]):
            dirty.add(v)
    return [v for v in order if v in dirty]
