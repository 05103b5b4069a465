"""Campaign funnel, marketing day table and filter lists (R6-R9), over dynamic dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import buckets as b, calendar as cal, money as m
from ledgerlight.functions.numeric import round_even
from ledgerlight.operators import filters, lattice
from ledgerlight.operators.grouping import ratio, stack_measures
from ledgerlight.plans import scoreboards as sb, views

USD = "decimal(28,4)"
NO = b.UNASSIGNED


def _or(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NO))


def dimensions(as_of: str) -> dict[str, tuple[str | None, Column]]:
    """Group name -> (dimension table it needs, column)."""
    return {
        "marketing_group": ("campaign", _or("marketing_group")), "campaign_legacy_id": ("campaign", _or("legacy_id")),
        "campaign_name": ("campaign", _or("name")), "campaign_channel": ("campaign", _or("channel")),
        "campaign_sub_channel": ("campaign", _or("sub_channel")), "original_affiliate": (None, _or("affiliate")),
        "office_name": ("agent", _or("office_name")), "agent_name": ("agent", _or("agent_name")),
        "agent_team": ("agent", _or("team")), "country": (None, _or("country")),
        "client_classification": (None, _or("score")),
        "segmentation": (None, F.coalesce(b.segment_label(F.col("segment"), F.col("score"), F.col("birth_date"), as_of),
                                          F.lit(NO))),
        "account_id": (None, F.col("account_id").cast("string")),
    }


@dataclass
class Dims:
    """Account attributes prepared for grouping and filtering; joins only the tables a group or filter needs."""

    accounts: DataFrame
    campaigns: DataFrame
    agents: DataFrame
    as_of: str
    groups: tuple = ()
    chosen: dict | None = None

    def prepared(self) -> DataFrame:
        known = dimensions(self.as_of)
        if bad := [g for g in self.groups if g not in known]:
            raise KeyError(f"unknown group {bad}")
        test, needs = filters.attribute_filter(self.chosen or {}, self.as_of)
        needs = needs | {known[g][0] for g in self.groups} - {None}
        rows = self.accounts
        if "campaign" in needs:
            rows = (rows.withColumn("_campaign", F.split_part("campaign", F.lit("."), F.lit(1)))
                    .join(self.campaigns.withColumnRenamed("campaign_id", "_campaign"), "_campaign", "left"))
        if "agent" in needs:
            cols = ["office_name", "agent_name", "team", "desk_name"]
            rows = rows.join(self.agents.select(F.col("agent_id").alias("assigned_to"), *cols), "assigned_to", "left")
        named = [known[g][1].alias(f"g{i + 1}") for i, g in enumerate(self.groups)]
        return rows.where(test).select(*self.accounts.columns, *named)

    @property
    def keys(self) -> list[str]:
        return [f"g{i + 1}" for i in range(len(self.groups))]


def with_live_agents(accounts: DataFrame, agents: DataFrame) -> DataFrame:
    """Accounts not assigned to a test or duplicated agent; unassigned accounts stay."""
    hidden = agents.where(m.named_like("test") | m.named_like("duplicated")).select(F.col("agent_id").alias("assigned_to"))
    return accounts.join(hidden, "assigned_to", "left_anti")


def _exact_avg(value: Column) -> Column:
    return F.round(F.avg(value), 1)


def _day(d: str) -> Column:
    return F.lit(d).cast("date")


# ---- R6 ----------------------------------------------------------------------------------------------------

LTV_WINDOWS = (30, 60, 90, 120)


def marketing_day(money: DataFrame, accounts: DataFrame, campaigns: DataFrame, agents: DataFrame, day: str,
                  group1: str = "marketing_group", group2: str = "country", *, floor_day: str) -> DataFrame:
    """Leads, live, FTD and FTC of one day with conversion rates, and net per FTC over trailing windows.

    The windows are nested, so one pass over the longest one feeds all of them by conditional sums.
    """
    dims = Dims(accounts, campaigns, agents, day, (group1, group2))
    base, keys = dims.prepared().where(m.live_account()), dims.keys
    on = _day(day)
    starts = {w: F.date_sub(on, w - 1) for w in LTV_WINDOWS}
    longest = starts[max(LTV_WINDOWS)]
    live = F.col("birth_date").isNotNull()
    leads = (with_live_agents(base, agents)
             .where(m.between_days("created", day, day) & (F.col("created") >= _day(floor_day).cast("timestamp_ntz")))
             .groupBy(*keys).agg(F.count(F.lit(1)).alias("daily_leads"), F.count_if(live).alias("daily_live"),
                                 _exact_avg(F.when(live, F.col("score"))).alias("live_avg_score"),
                                 F.lit(1).alias("spine")))
    ledger = (views.money_by_account_day(money, (F.col("confirmed") >= longest.cast("timestamp_ntz")) & m.on_or_before("confirmed", day))
              .groupBy("account_id", "tx_date").agg(
                  F.sum(F.col("deposit_usd") - F.col("withdrawal_usd")).cast(USD).alias("net"),
                  F.sum("ftd_count").alias("ftds"), F.sum("ftd_usd").cast(USD).alias("ftd_usd"))
              .join(base.select("account_id", "score", *keys), "account_id"))
    first = (F.col("tx_date") == on) & (F.col("ftds") > 0)
    paid = ledger.groupBy(*keys).agg(
        F.count_if(first).alias("daily_ftd"), F.sum(F.when(first, F.col("ftd_usd"))).cast(USD).alias("daily_ftd_amount"),
        # the score counts once per FTD row, not once per client
        F.round(F.sum(F.when(first, F.col("score") * F.col("ftds")))
                / F.sum(F.when(first & F.col("score").isNotNull(), F.col("ftds"))), 1).alias("ftd_avg_score"),
        F.max(F.when(first, 1)).alias("spine"),
        *[F.sum(F.when(F.col("tx_date") >= s, F.col("net"))).cast(USD).alias(f"net{w}") for w, s in starts.items()])
    qualified = F.to_date("qualified")
    ftc = (base.where(qualified.between(longest, on)).groupBy(*keys).agg(
        F.count_if(qualified == on).alias("daily_ftc"), F.max(F.when(qualified == on, 1)).alias("spine"),
        *[F.count_if(qualified >= s).alias(f"ftc{w}") for w, s in starts.items()]))
    spec = {"daily_leads": "bigint", "daily_live": "bigint", "live_avg_score": "max double", "daily_ftd": "bigint",
            "daily_ftd_amount": USD, "ftd_avg_score": "max double", "daily_ftc": "bigint", "spine": "bigint",
            **{f"net{w}": USD for w in LTV_WINDOWS}, **{f"ftc{w}": "bigint" for w in LTV_WINDOWS}}
    rows = stack_measures([leads, paid, ftc], keys, spec).where("spine > 0").drop("spine")
    rows = (rows.withColumn("cr_lead_live", ratio(F.col("daily_live"), F.col("daily_leads"), 1, 100, None))
            .withColumn("cr_live_ftd", ratio(F.col("daily_ftd"), F.col("daily_live"), 1, 100, None)))
    for w in LTV_WINDOWS:
        rows = rows.withColumn(f"ltv{w}", ratio(F.col(f"net{w}"), F.col(f"ftc{w}"), 2, 1, None))
    return rows.orderBy(F.desc("daily_live"), "g1", "g2")


# ---- R7 ----------------------------------------------------------------------------------------------------


def campaign_cards(money: DataFrame, accounts: DataFrame, campaigns: DataFrame, agents: DataFrame, traders: DataFrame,
                   first: str, last: str, as_of: str, chosen: dict | None = None, *, floor_day: str) -> DataFrame:
    """Leads, live, FTD, FTC (range and last day), money, traders and average scores; one row.

    Filters narrow all figures but traders, which follow the trader report. With filters the money leaves out
    bonus comments, without them it matches V1 less duplicated agents.
    """
    chosen = chosen or {}
    on = _day(last)
    base = Dims(accounts, campaigns, agents, as_of, (), chosen).prepared()
    known = with_live_agents(base.where(m.live_account() & (F.col("created") >= _day(floor_day).cast("timestamp_ntz"))), agents)
    made, qual, live = F.to_date("created"), F.to_date("qualified"), F.col("birth_date").isNotNull()
    q_first, q_last = chosen.get("qualified") or (first, last)   # a qualification filter moves the FTC range
    in_range, q_range = made.between(_day(first), on), qual.between(_day(q_first), _day(q_last))
    score = b.score_or_age(F.col("score"), F.col("birth_date"), as_of)
    people = known.agg(
        F.count_if(made == on).alias("leads_daily"), F.count_if(in_range).alias("leads_range"),
        F.count_if((made == on) & live).alias("live_daily"), F.count_if(in_range & live).alias("live_range"),
        F.count_if(qual == _day(q_last)).alias("ftc_daily"), F.count_if(q_range).alias("ftc_range"),
        _exact_avg(F.when(in_range & live, score)).alias("live_avg_score"))
    ledger = views.money_by_account_day(money, m.between_days("confirmed", first, last), bonus_comments=not chosen)
    hidden = (m.named_like("test") | m.named_like("test", F.trim(F.coalesce("full_name", F.lit(""))))) if chosen else (
        m.named_like("test") | m.named_like("duplicated"))
    owners = agents.where(hidden).select(F.col("agent_id").alias("owner"))
    paid = (ledger.join(owners, "owner", "left_anti")
            .join(base.where(m.real_account()).select("account_id"), "account_id", "left_semi")
            .agg(m.usd_sum(F.col("deposit_usd")).alias("deposits"), m.usd_sum(F.col("withdrawal_usd")).alias("withdrawals"),
                 m.usd_sum(F.col("deposit_usd") - F.col("withdrawal_usd")).alias("net_deposits"),
                 F.coalesce(F.sum("ftd_count"), F.lit(0)).alias("ftd_range"),
                 F.coalesce(F.sum(F.when(F.col("tx_date") == on, F.col("ftd_count"))), F.lit(0)).alias("ftd_daily")))
    clients = (views.money_by_account_day(money, m.is_ftd() & m.between_days("confirmed", first, last))
               .select("account_id").distinct()
               .join(base.where(m.live_account()).select("account_id", score.alias("s")), "account_id")
               .agg(_exact_avg(F.col("s")).alias("ftd_avg_score")))
    team = agents.where(m.not_test_agent() & (F.col("dept") == "Retention")).select("agent_id")
    traded = (traders.where(F.col("day").between(_day(first), on)).join(team, "agent_id", "left_semi")
              .select("account_id").distinct().agg(F.count(F.lit(1)).alias("traders")))
    return sb.one_row(money.sparkSession, people, paid, clients, traded)


# ---- R8 ----------------------------------------------------------------------------------------------------

TABLE_SPEC = {
    "leads": "bigint", "live_accounts": "bigint", "live_avg_score": "max double", "ftc": "bigint", "ftd": "bigint",
    "deposits": USD, "withdrawals": USD, "ftd_avg_score": "max double", "traders": "bigint", "rdp_count": "bigint",
    "rdp_net": USD, "volume_usd": USD,
}


def campaign_table(money: DataFrame, accounts: DataFrame, campaigns: DataFrame, agents: DataFrame, deals: DataFrame,
                   positions: DataFrame, bridge: DataFrame, first: str, last: str, as_of: str,
                   groups: tuple = (), period: str | None = None, chosen: dict | None = None,
                   *, floor_day: str) -> DataFrame:
    """The funnel by up to two groups and a period: six aggregates on one key, stacked and summed once."""
    dims = Dims(accounts, campaigns, agents, as_of, groups, chosen)
    base = dims.prepared()
    keys = (["period"] if period else []) + dims.keys or ["_all"]

    def at(time: Column) -> list[Column]:
        own = [cal.period_start(time, period).alias("period")] if period else []
        return own + [F.col(k) for k in dims.keys] or [F.lit(1).alias("_all")]

    score = b.score_or_age(F.col("score"), F.col("birth_date"), as_of)
    base = base.withColumn("_score", score)
    live = F.col("birth_date").isNotNull()
    known = with_live_agents(base.where(m.live_account() & (F.col("created") >= _day(floor_day).cast("timestamp_ntz"))), agents)
    people = known.where(m.between_days("created", first, last)).groupBy(*at(F.col("created"))).agg(
        F.count(F.lit(1)).alias("leads"), F.count_if(live).alias("live_accounts"),
        _exact_avg(F.when(live, F.col("_score"))).alias("live_avg_score"))
    q_first, q_last = (chosen or {}).get("qualified") or (first, last)   # a qualification filter moves the FTC range
    ftc = known.where(m.between_days("qualified", q_first, q_last)).groupBy(*at(F.col("qualified"))).agg(
        F.count(F.lit(1)).alias("ftc"))
    owners = agents.where(~m.countable_agent()).select(F.col("agent_id").alias("owner"))
    real = base.where(m.real_account()).select("account_id", "qualified", "_score", *dims.keys)
    ledger = (money.where(m.valid_money() & m.not_bonus_comment() & m.between_days("confirmed", first, last))
              .select("account_id", "owner", "confirmed", "type", "ftd", "usd").join(owners, "owner", "left_anti"))
    # the day of a row and whether it came after the qualification are all the later steps need
    by_account = (ledger.join(real.select("account_id", "qualified"), "account_id")
                  .groupBy("account_id", F.to_date("confirmed").alias("day"),
                           F.coalesce(F.col("confirmed") > F.col("qualified"), F.lit(False)).alias("after"))
                  .agg(m.usd_sum(m.money_in()).alias("dep"), m.usd_sum(m.money_out()).alias("wd"),
                       F.count_if(m.is_ftd()).alias("ftds"))
                  .join(real, "account_id"))
    if period:   # an account counts once per period in which it has later money
        paid_keys = at(F.col("day"))
    else:
        paid_keys = at(F.lit(None))
    per_client = by_account.groupBy("account_id", "_score", *paid_keys).agg(
        F.sum("dep").alias("dep"), F.sum("wd").alias("wd"), F.sum("ftds").alias("ftds"),
        F.max("after").alias("after"), F.sum(F.when(F.col("after"), F.col("dep") - F.col("wd"))).alias("later"))
    paid = per_client.groupBy(*keys).agg(
        F.sum("ftds").alias("ftd"), F.sum("dep").cast(USD).alias("deposits"), F.sum("wd").cast(USD).alias("withdrawals"),
        F.round(F.sum(F.col("_score") * F.col("ftds"))
                / F.nullif(F.sum(F.when(F.col("_score").isNotNull(), F.col("ftds"))), F.lit(0)), 1).alias("ftd_avg_score"),
        F.count_if("after").alias("rdp_count"), F.sum("later").cast(USD).alias("rdp_net"))
    # one pass over the trades gives volume and traders: a trader is an account of the retention team that
    # opened positive notional in the period, volume counts openings and closings of every real account
    team = agents.where(m.not_test_agent() & (F.col("dept") == "Retention")).select(
        F.col("agent_id").alias("assigned_to"), F.lit(1).alias("_team"))
    owners = (views.login_accounts(bridge, base).select("login", "account_id", "assigned_to", *dims.keys)
              .join(team, "assigned_to", "left"))
    days = F.col("day").between(_day(first), _day(last))
    opened = views.traded_notional(deals, positions, None).withColumnRenamed("open_date", "day").where(days)
    moves = opened.unionByName(closed_by_day(deals).withColumn("has_notional", F.lit(0)).where(days))
    traded = (moves.join(owners, "login").groupBy("account_id", *at(F.col("day")))
              .agg(F.sum("notional").alias("usd"), F.max(F.col("has_notional") * F.col("_team")).alias("trader"))
              .groupBy(*keys).agg(F.sum("usd").cast(USD).alias("volume_usd"), F.count_if(F.col("trader") == 1).alias("traders")))
    rows = stack_measures([people, ftc, paid, traded], keys, TABLE_SPEC)
    return rows.drop("_all")


SUMS = {**{c: t for c, t in TABLE_SPEC.items() if not t.startswith("max ")},
        "live_score": "double", "live_scored": "bigint", "ftd_score": "double", "ftd_scored": "bigint"}


def client_states(table: DataFrame, names: list[str]) -> DataFrame:
    """R8 by all its dimensions, one of them the account, as measures that add up: averages as a sum and a count.

    Every dimension belongs to the account, so counts of traders and depositors are sums of a client's flags.
    """
    live, ftd = F.col("live_avg_score"), F.col("ftd_avg_score")
    return table.select(*[F.col(f"g{i + 1}").alias(n) for i, n in enumerate(names)], *[c for c in SUMS if c in table.columns],
                        (live * F.col("live_accounts")).alias("live_score"), F.when(live.isNotNull(), F.col("live_accounts")).alias("live_scored"),
                        (ftd * F.col("ftd")).alias("ftd_score"), F.when(ftd.isNotNull(), F.col("ftd")).alias("ftd_scored"))


def all_groupings(money: DataFrame, accounts: DataFrame, campaigns: DataFrame, agents: DataFrame, deals: DataFrame, positions: DataFrame,
                  bridge: DataFrame, first: str, last: str, as_of: str, store: lattice.Store, *, floor_day: str) -> DataFrame:
    """R8 by each one and two of its dimensions and in all, from one pass over the tables."""
    names = list(dimensions(as_of))
    table = campaign_table(money, accounts, campaigns, agents, deals, positions, bridge, first, last, as_of, tuple(names), floor_day=floor_day)
    rows = lattice.groupings(client_states(table, names), names, SUMS, store)
    return with_rates(rows.select(
        "grouping", F.get("labels", F.lit(0)).alias("g1"), F.get("labels", F.lit(1)).alias("g2"), *[c for c in SUMS if c in TABLE_SPEC],
        F.round(F.col("live_score") / F.nullif("live_scored", F.lit(0)), 1).alias("live_avg_score"),
        F.round(F.col("ftd_score") / F.nullif("ftd_scored", F.lit(0)), 1).alias("ftd_avg_score")))


def closed_by_day(deals: DataFrame) -> DataFrame:
    """(login, day) notional of closing deals by the day they closed."""
    return (deals.where((F.col("entry") == 1) & m.closed()).groupBy("login", F.to_date("close_time").alias("day"))
            .agg(F.sum("notional").cast(USD).alias("notional")))


def open_close_volume(deals: DataFrame, positions: DataFrame, first: str, last: str) -> DataFrame:
    """(login, day) volume opened (open positions, closed deals dated by entry) plus volume closed by exit day."""
    inside = F.col("day").between(_day(first), _day(last))
    opened = (views.traded_notional(deals, positions, None)
              .select("login", F.col("open_date").alias("day"), "notional").where(inside))
    return (opened.unionByName(closed_by_day(deals).where(inside)).groupBy("login", "day")
            .agg(F.sum("notional").cast(USD).alias("volume")))


def with_rates(rows: DataFrame) -> DataFrame:
    """Conversion rates and net per client, from the measures of a row."""
    net = F.col("deposits") - F.col("withdrawals")
    return (rows.withColumn("net_deposits", net.cast(USD))
            .withColumn("cr_lead_to_live", ratio(F.col("live_accounts"), F.col("leads"), 2, 100))
            .withColumn("cr_live_to_ftd", ratio(F.col("ftd"), F.col("live_accounts"), 2, 100))
            .withColumn("ltv", ratio(net, F.col("ftc"))).withColumn("ltv_traders", ratio(net, F.col("traders"))))


def table_totals(rows: DataFrame) -> DataFrame:
    """R8 totals: sums, average scores weighted by their counts, then the rates."""
    sums = [F.sum(c).cast(t).alias(c) for c, t in TABLE_SPEC.items() if not t.startswith("max ")]

    def weighted(value: str, weight: str) -> Column:
        known = F.col(value).isNotNull() & (F.col(weight) > 0)
        return round_even(F.sum(F.when(known, F.col(value) * F.col(weight)))
                        / F.nullif(F.sum(F.when(known, F.col(weight))), F.lit(0)), 1).alias(value)

    return with_rates(rows.agg(*sums, weighted("live_avg_score", "live_accounts"), weighted("ftd_avg_score", "ftd")))


def filter_lists(accounts: DataFrame, campaigns: DataFrame, agents: DataFrame) -> DataFrame:
    """The option lists of the report filters, one row per list and value; one pass over each table."""
    used = agents.join(accounts.select(F.col("assigned_to").alias("agent_id")), "agent_id", "left_semi")
    sources = [(campaigns, {"marketing_group": "marketing_group", "channel": "channel", "sub_channel": "sub_channel",
                            "legacy_id": "legacy_id", "campaign_name": "name"}),
               (accounts, {"affiliate": "affiliate", "country": "country"}),
               (used, {"office": "office_name", "agent": "agent_name", "team": "desk_name"})]

    def values(df: DataFrame, lists: dict[str, str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("list"), F.col(c).cast("string").alias("value")) for n, c in lists.items()])
        return (df.select(F.inline(pairs)).where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct())

    parts = [values(df, lists) for df, lists in sources]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
