"""Agent bonuses and first-time-client lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import money as m, tiers
from ledgerlight.functions.numeric import round_even
from ledgerlight.operators import keyed
from ledgerlight.operators.grouping import stack_measures
from ledgerlight.plans import scoreboards as sb, views

USD = "decimal(28,4)"
# Offices whose agents take part in the sales bonus.
SALES_OFFICES = ("GMT", "LAG Nigeria", "ABJ Nigeria", "South Africa", "Cyprus")


def retention_bonus(kpis: DataFrame, volume: DataFrame, targets: DataFrame, agents: DataFrame, first: str,
                    last: str, access: Column | None = None) -> DataFrame:
    """Tiered share of net by office group, target hit and volume ratio."""
    spec = {"net_usd": USD, "open_volume_usd": USD, "target_net": USD}
    measures = stack_measures([sb.kpi_measures(kpis, first, last), sb.volume_measures(volume, first, last), targets],
                              ["agent_id"], spec)
    where = (F.col("dept") == "Retention") & m.countable_agent() & m.not_department()
    rows = (agents.where(where if access is None else where & access).join(measures, "agent_id", "left")
            .fillna(0, list(spec)))
    net, target, vol = (round_even(F.col(c).cast("double"), 2) for c in ("net_usd", "target_net", "open_volume_usd"))
    rows = (rows.select("agent_id", F.coalesce("office_name", F.lit("N/A")).alias("office_name"),
                        F.coalesce("department", F.lit("N/A")).alias("dept_name"),
                        F.coalesce("agent_name", "full_name", F.lit("N/A")).alias("agent_name"),
                        F.coalesce("office", F.lit("")).alias("office"), target.alias("target_net"),
                        net.alias("net_usd"), vol.alias("open_volume_usd"), F.coalesce("status", F.lit("")).alias("status"))
            .withColumn("target_vol", F.col("target_net") * tiers.VOLUME_PER_TARGET))
    group = tiers.office_group(F.col("office"))
    net_ratio = F.when(F.col("target_net") > 0, F.col("net_usd") / F.col("target_net"))
    vol_ratio = F.when(F.col("target_vol") > 0, F.col("open_volume_usd") / F.col("target_vol"))
    on_net = tiers.net_bonus_pct(F.col("net_usd"), group)
    on_target = F.when((group == "A") & (net_ratio >= 1.0), tiers.TARGET_HIT_PCT).otherwise(0.0)
    on_volume = tiers.volume_bonus_pct(vol_ratio, group)
    total = on_net + on_target + on_volume
    return rows.select(
        *rows.columns, round_even(net_ratio, 6).alias("target_net_pct"), round_even(vol_ratio, 6).alias("target_vol_pct"),
        on_net.alias("pct_on_net"), on_target.alias("pct_on_target_net"), on_volume.alias("pct_on_target_vol"),
        round_even(total, 6).alias("total_bonus_pct"), round_even(total * F.col("net_usd"), 2).alias("basic_bonus_usd"),
    ).orderBy(F.asc_nulls_last("office_name"), "dept_name", "agent_name")


def ftc_net(money: DataFrame, accounts: DataFrame, first: str, last: str) -> DataFrame:
    """R18 by (account, agent): net money up to the qualification of accounts that qualified in the range."""
    acc = accounts.where(m.real_account() & m.between_days("qualified", first, last)).select("account_id", "qualified")
    day = F.to_date("confirmed").cast("timestamp_ntz")
    ledger = (money.where(m.valid_money() & m.not_bonus_comment())
              .groupBy("account_id", "owner", day.alias("day"), (F.coalesce("ftd", F.lit(0)) == 1).alias("first"))
              .agg(F.sum(m.signed_usd()).alias("usd")))
    return (ledger.join(acc, "account_id").where((F.col("qualified") >= F.col("day")) | F.col("first"))
            .groupBy("account_id", F.col("owner").alias("agent_id")).agg(F.sum("usd").cast(USD).alias("net_usd")))


def bonus_by_agent(bonuses: DataFrame, first: str, last: str) -> DataFrame:
    """V3 over a range, by agent."""
    return (bonuses.where(m.between_days("reached_at", first, last)).groupBy("agent_id").agg(
        *[F.sum(c).alias(c) for c in ("ftd100_count", "ftd100_full_count", "ftd100_half_count", "ftd_amount_bonus")],
        F.sum("total_sales_net").cast(USD).alias("total_sales_net")))


def _qualify(count: Column, target: Column) -> Column:
    return count >= tiers.QUALIFY_SHARE * target


def in_sales_bonus(offices=SALES_OFFICES, extra_agents=()) -> Column:
    """Conversion agents of the given offices; configured extra agents count as conversion."""
    team = (F.col("dept") == "Sales") & (F.col("team") == "Conversion")
    if extra_agents:
        team = team | F.col("agent_id").isin(*extra_agents)
    where = team & m.countable_agent()
    return where if offices is None else where & F.col("office_name").isin(*offices)


def sales_bonus(kpis: DataFrame, bonuses: DataFrame, net: DataFrame, targets: DataFrame, agents: DataFrame,
                first: str, last: str, offices=SALES_OFFICES, extra_agents=(), access: Column | None = None,
                ordered: bool = True) -> DataFrame:
    """Multiplier by FTD100 count, half weight below the full amount, target and amount bonus.

    Agents take part with at least one FTD100 client or a target above one; a missing target counts as one.
    """
    spec = {"ftc": "bigint", "target_ftc": "bigint", "ftd100_count": "bigint", "ftd100_full_count": "bigint",
            "ftd100_half_count": "bigint", "total_sales_net": USD, "ftd_amount_bonus": "bigint", "net_usd": USD}
    frames = [sb.kpi_measures(kpis, first, last).select("agent_id", "ftc"), targets.select("agent_id", "target_ftc"),
              bonus_by_agent(bonuses, first, last),
              net.groupBy("agent_id").agg(F.sum("net_usd").cast(USD).alias("net_usd"))]
    where = in_sales_bonus(offices, extra_agents)
    rows = (agents.where(where if access is None else where & access)
            .join(stack_measures(frames, ["agent_id"], spec), "agent_id", "left").fillna(0, list(spec))
            .where((F.col("ftd100_count") > 0) | (F.col("target_ftc") > 1))
            .withColumn("target_ftc", F.greatest("target_ftc", F.lit(1))))
    count, target = F.col("ftd100_count"), F.col("target_ftc")
    ok, multiplier = _qualify(count, target), tiers.ftd100_multiplier(count)
    basic = F.when(ok, F.col("ftd100_full_count") * multiplier + F.col("ftd100_half_count") * multiplier / 2).otherwise(0.0)
    hit = F.when(ok, tiers.target_bonus(count, target)).otherwise(0)
    amount = F.when(ok, F.col("ftd_amount_bonus")).otherwise(0)
    out = rows.select(
        "agent_id", F.coalesce("office_name", F.lit("N/A")).alias("office_name"),
        F.coalesce("agent_name", "full_name", F.lit("N/A")).alias("agent_name"), target, F.col("ftc").alias("ftc_count"),
        "ftd100_count", "ftd100_full_count", "ftd100_half_count", F.col("net_usd").alias("ftc_net_usd"),
        "total_sales_net", round_even(basic, 2).alias("basic_bonus"), hit.alias("sales_target_bonus"),
        amount.alias("ftd_amount_bonus"), round_even(basic + hit + amount, 2).alias("total_sales_bonus"),
        round_even(count / target, 6).alias("target_pct"), multiplier.alias("multiplier"),
        F.coalesce("status", F.lit("")).alias("status"))
    return out.orderBy(F.asc_nulls_last("office_name"), F.desc("ftd100_count"), "agent_name") if ordered else out


def first_ftd(money: DataFrame) -> DataFrame:
    """The first approved FTD row per account: owner and day.

    A min by (time, id) combines map-side, so an account with many rows costs one row per task.
    """
    rows = money.where(m.approved() & (F.col("ftd") == 1))
    return rows.groupBy("account_id").agg(
        F.min_by("owner", keyed.order_key("confirmed", "money_id")).alias("ftd_owner"),
        F.to_date(F.min("confirmed")).alias("ftd_day"))


def qualified_accounts(accounts: DataFrame, first: str, last: str) -> DataFrame:
    return accounts.where(m.real_account() & m.between_days("qualified", first, last) & F.col("account_id").isNotNull())


def _ftd100_accounts(clients: DataFrame, first: str, last: str) -> DataFrame:
    amount = F.col("reached_amount")
    return clients.where(m.between_days("reached_at", first, last) & F.col("owner").isNotNull()).select(
        "account_id", F.col("owner").alias("ftd100_agent"),
        F.when(amount >= views.FULL_AMOUNT, "full").otherwise("half").alias("ftd100_type"),
        tiers.amount_bonus(amount).alias("amount_raw"))


def _agent_counts(bonuses: DataFrame, targets: DataFrame, first: str, last: str) -> DataFrame:
    return (bonus_by_agent(bonuses, first, last).select("agent_id", F.col("ftd100_count").alias("ftd100_total"))
            .join(targets.select("agent_id", "target_ftc"), "agent_id", "left").fillna(0, ["target_ftc"]))


def _client_bonus(counts: Column, ok: Column) -> list[Column]:
    multiplier = tiers.ftd100_multiplier(counts)
    basic = F.when(F.col("ftd100_type") == "full", multiplier.cast("double")).otherwise(round_even(multiplier / 2, 2))
    return [F.when(ok, basic).otherwise(0.0).alias("basic_bonus"),
            F.when(ok, F.col("amount_raw")).otherwise(0).alias("ftd_amount_bonus")]


def sales_bonus_accounts(money: DataFrame, accounts: DataFrame, clients: DataFrame, bonuses: DataFrame,
                         targets: DataFrame, agents: DataFrame, first: str, last: str, offices=SALES_OFFICES,
                         extra_agents=(), access: Column | None = None) -> DataFrame:
    """The sales bonus per client, over newly qualified and FTD100 accounts (full outer)."""
    ftc = (qualified_accounts(accounts, first, last).join(first_ftd(money), "account_id", "left")
           .select("account_id", F.coalesce("ftd_owner", "assigned_to").alias("ftc_agent"), F.lit(1).alias("is_ftc")))
    both = (_ftd100_accounts(clients, first, last).withColumn("is_ftd100", F.lit(1)).join(ftc, "account_id", "full")
            .withColumn("agent_id", F.coalesce("ftd100_agent", "ftc_agent"))
            .fillna(0, ["is_ftc", "is_ftd100", "amount_raw"]))
    where = in_sales_bonus(offices, extra_agents)
    team = agents.where(where if access is None else where & access).select(
        "agent_id", "office_name", F.coalesce("agent_name", "full_name", F.lit("N/A")).alias("agent_name"), "status")
    rows = (both.join(team, "agent_id")
            .join(ftc_net(money, accounts, first, last), ["account_id", "agent_id"], "left")
            .join(_agent_counts(bonuses, targets, first, last), "agent_id", "left")
            .fillna(0, ["ftd100_total", "target_ftc", "net_usd"])
            .where((F.col("ftd100_total") > 0) | (F.col("target_ftc") > 1)))
    ok = (F.col("is_ftd100") == 1) & _qualify(F.col("ftd100_total"), F.greatest("target_ftc", F.lit(1)))
    return rows.select("office_name", "agent_name", "account_id", "is_ftc", "is_ftd100",
                       F.col("net_usd").alias("ftc_net_usd"), *_client_bonus(F.col("ftd100_total"), ok),
                       F.coalesce("status", F.lit("")).alias("status")).orderBy(
                           F.asc_nulls_last("office_name"), "agent_name", "account_id")


def all_ftcs(money: DataFrame, accounts: DataFrame, clients: DataFrame, bonuses: DataFrame, targets: DataFrame,
             agents: DataFrame, first: str, last: str, access: Column | None = None) -> DataFrame:
    """Newly qualified accounts by agent with the deposits between first FTD and qualification.

    The current agent gets a zero row when no money of the period is theirs; the credit and the bonus go to
    the agent of the first FTD, and a target is required for it.
    """
    ftc = (qualified_accounts(accounts, first, last).join(first_ftd(money), "account_id", "left")
           .select("account_id", "assigned_to", "qualified", "ftd_day",
                   F.coalesce("ftd_owner", "assigned_to").alias("ftd_agent")))
    ledger = (money.where(m.valid_money() & m.not_bonus_comment() & F.col("owner").isNotNull())
              .select("account_id", "owner", "confirmed", (F.coalesce("ftd", F.lit(0)) == 1).alias("first"),
                      m.money_in().alias("dep"), m.money_out().alias("wd"))
              .join(ftc.select("account_id", "qualified", "ftd_day"), "account_id"))
    inside = ((F.col("ftd_day").isNull() | (F.col("confirmed") >= F.col("ftd_day").cast("timestamp_ntz")) | F.col("first"))
              & ((F.col("confirmed") < F.col("qualified") + F.expr("INTERVAL 1 DAY")) | F.col("first")))
    per_agent = (ledger.where(inside).groupBy("account_id", F.col("owner").alias("agent_id"))
                 .agg(F.sum("dep").cast(USD).alias("ftc_deposit"), F.sum("wd").cast(USD).alias("ftc_wd")))
    zero_rows = ftc.where("assigned_to IS NOT NULL").select(
        "account_id", F.col("assigned_to").alias("agent_id"), F.lit(0).cast(USD).alias("ftc_deposit"),
        F.lit(0).cast(USD).alias("ftc_wd"))
    # the zero row only survives where the agent has no money row: a sum over both keeps one row per pair
    pairs = (per_agent.unionByName(zero_rows).groupBy("account_id", "agent_id")
             .agg(*[F.sum(c).cast(USD).alias(c) for c in ("ftc_deposit", "ftc_wd")]))
    rows = (pairs.join(ftc.select("account_id", "ftd_agent"), "account_id")
            .join(_ftd100_accounts(clients, first, last).drop("ftd100_agent"), "account_id", "left")
            .join(agents.withColumn("_known", F.lit(True)), "agent_id", "left")
            .join(_agent_counts(bonuses, targets, first, last), "agent_id", "left"))
    rows = rows.where(F.col("_known").isNull() | m.countable_agent())
    if access is not None:
        rows = rows.where(access)
    credit = F.coalesce(F.col("agent_id") == F.col("ftd_agent"), F.lit(False))
    total, target = F.coalesce("ftd100_total", F.lit(0)), F.coalesce("target_ftc", F.lit(0))
    ok = credit & F.col("ftd100_type").isNotNull() & (target > 0) & _qualify(total, target)
    return rows.select(
        F.coalesce("agent_name", "full_name", F.lit("N/A")).alias("agent_name"), F.coalesce("desk", F.lit("")).alias("desk"),
        F.coalesce("office_name", F.lit("")).alias("office_name"), F.coalesce("position", F.lit("")).alias("position"),
        "account_id", credit.cast("int").alias("ftc"), "ftc_deposit", "ftc_wd", *_client_bonus(total, ok),
    ).orderBy("agent_name", "account_id")


def kept_totals(rows: DataFrame) -> DataFrame:
    """totals of the rows a text search kept."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("ftc").alias("ftc"),
                    *[F.sum(c).cast(USD).alias(c) for c in ("ftc_deposit", "ftc_wd")],
                    F.sum("basic_bonus").alias("basic_bonus"), F.sum("ftd_amount_bonus").alias("ftd_amount_bonus"))
