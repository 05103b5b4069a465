"""Equity reports: comparisons, historical and live totals, PnL bridges and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import calendar as cal, money as m
from ledgerlight.operators import keyed
from ledgerlight.operators.grouping import stack_measures
from ledgerlight.plans import jobs, scoreboards as sb

USD = "decimal(28,4)"


def _day(d: str) -> Column:
    return F.lit(d).cast("date")


def _ts(d: Column) -> Column:
    return d.cast("timestamp_ntz")


def _net() -> Column:
    return F.coalesce(F.col("balance"), m.zero()) + F.coalesce(F.col("floating"), m.zero())


def _floor(c: Column) -> Column:
    return F.greatest(c, m.zero())


def bonus_until(bonuses: DataFrame, after: Column) -> DataFrame:
    """Bonus balance per login over the rows before a moment."""
    return bonuses.where(F.col("confirmed") < after).groupBy("login").agg(F.sum("amount").cast(USD).alias("bonus"))


def bridge_logins(bridge: DataFrame, accounts: DataFrame, once: bool = True, with_equity: bool = False) -> DataFrame:
    """Logins of non-test accounts on live bridge rows; once each unless repeated rows are to count again."""
    rows = bridge.where(m.not_deleted() & F.col("account_id").isNotNull())
    if with_equity:
        rows = rows.where(F.col("equity") > 0)
    rows = (rows.select(F.expr("try_cast(login AS bigint)").alias("login"), "account_id").where("login IS NOT NULL")
            .join(accounts.where(m.real_account()).select("account_id"), "account_id", "left_semi").select("login"))
    return rows.distinct() if once else rows


def eez_comparison(snapshots: DataFrame, equity: DataFrame, bonuses: DataFrame, bridge: DataFrame,
                   accounts: DataFrame) -> DataFrame:
    """Every login's latest snapshot beside its equity at the end of the month before."""
    last = snapshots.agg(F.max("day")).scalar()
    month = _ts(F.trunc(last, "month"))
    logins = jobs.test_logins(bridge, accounts).where("is_test = 0").select("login")
    before = keyed.newest(equity.where(F.col("at") < month), ["login"], ["at", "source"])
    start = (before.join(bonus_until(bonuses, month), "login", "left")
             .select("login", jobs.equity_floor("balance", "floating", F.col("bonus")).alias("s")))
    return (snapshots.where(F.col("day") == last).join(logins, "login", "left_semi").join(start, "login", "left")
            .select("login", F.coalesce("end_eez", F.lit(0)).cast("decimal(18,2)").alias("end_equity_zeroed"),
                    F.coalesce("s", F.lit(0)).cast("decimal(18,2)").alias("start_equity_zeroed"),
                    F.col("day").alias("snapshot_date"))
            .orderBy(F.desc("end_equity_zeroed"), "login"))


def eez_month(equity: DataFrame, bonuses: DataFrame, bridge: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    """Equity without (clamped) bonus by login in the month of a day, with the equity the month began with."""
    start, after = F.lit(cal.month_start(as_of)), F.lit(cal.next_month(as_of))
    latest = keyed.newest(equity.where((F.col("at") >= _ts(start)) & (F.col("at") < _ts(after))), ["login"], ["at", "source"])
    earlier = equity.where(F.col("at") < _ts(start))
    opening_day = earlier.agg(F.to_date(F.max("at"))).scalar()
    opening = keyed.newest(earlier.where((F.col("at") >= _ts(opening_day)) & (F.col("at") < _ts(F.date_add(opening_day, 1)))), ["login"], ["at", "source"]).select(
        "login", _floor(F.coalesce(F.col("equity"), m.zero())).alias("e"), _floor(_net()).alias("n"))
    flags = jobs.test_logins(bridge, accounts, live_only=False)
    bonus = bonus_until(bonuses, _ts(F.date_add(_day(as_of), 1)))
    off = _floor(F.coalesce(F.col("bonus"), m.zero()))
    return (latest.join(bonus, "login", "left").join(flags, "login", "left").join(opening, "login", "left")
            .select("login", F.coalesce("is_test", F.lit(0)).alias("is_test"),
                    F.round(_floor(_floor(_net()) - off), 2).cast("decimal(18,2)").alias("eez"),
                    F.round(F.coalesce("e", m.zero()), 2).cast("decimal(18,2)").alias("daily_start_equity"),
                    F.round(F.coalesce("n", m.zero()), 2).cast("decimal(18,2)").alias("daily_start_net_equity"))
            .orderBy(F.desc("eez"), "login"))


def historical_total(equity: DataFrame, bonuses: DataFrame, bridge: DataFrame, accounts: DataFrame,
                     snapshots: DataFrame, day: str, once: bool = True) -> DataFrame:
    """Total equity without bonus as of a day, from each login's newest row, and the day's opening total."""
    logins = bridge_logins(bridge, accounts, once)
    valued = (keyed.as_of(equity, ["login"], "at", day, ["source"]).join(logins, "login")
              .join(bonus_until(bonuses, _ts(F.date_add(_day(day), 1))), "login", "left"))
    total = valued.agg(F.coalesce(F.sum(jobs.equity_floor("balance", "floating", F.col("bonus"))), F.lit(0))
                       .cast(USD).alias("total_eez"))
    known = (bridge.where(m.not_deleted() & F.col("account_id").isNotNull())
             .select(F.expr("try_cast(login AS bigint)").alias("login")).where("login IS NOT NULL"))
    start = (snapshots.where(F.col("day") == F.date_sub(_day(day), 1)).join(known, "login", "left_semi")
             .agg(m.usd_sum(F.col("end_eez")).alias("start_eez")))
    return sb.one_row(equity.sparkSession, total, start)


def month_end_total(equity: DataFrame, bonuses: DataFrame, bridge: DataFrame, accounts: DataFrame, agents: DataFrame,
                    last: str, once: bool = True) -> DataFrame:
    """The scoreboard's month-end total: newest row of the month per login, assigned accounts only."""
    rows = equity.where((F.col("at") >= _ts(F.lit(cal.month_start(last)))) & (F.col("at") < _ts(F.lit(cal.next_month(last)))))
    assigned = accounts.join(agents.select(F.col("agent_id").alias("assigned_to")), "assigned_to", "left_semi")
    valued = (keyed.newest(rows, ["login"], ["at", "source"]).join(bridge_logins(bridge, assigned, once), "login")
              .join(bonus_until(bonuses, _ts(F.date_add(_day(last), 1))), "login", "left"))
    return valued.agg(F.coalesce(F.sum(jobs.equity_floor("balance", "floating", F.col("bonus"))), F.lit(0))
                      .cast(USD).alias("end_equity_zeroed"))


def open_floating(positions: DataFrame) -> DataFrame:
    """Floating result of open trades per login."""
    return (positions.where((F.col("cmd") < 2) & m.trade_symbol()).groupBy("login")
            .agg(F.sum(m.deal_result()).cast(USD).alias("floating_now")))


def closed_result(deals: DataFrame, day: str) -> DataFrame:
    """Result of the trades closed on a day, per login."""
    return (deals.where((F.col("entry") == 1) & (F.col("cmd") < 2) & m.trade_symbol() & m.between_days("close_time", day, day))
            .groupBy("login").agg(F.sum(m.deal_result()).cast(USD).alias("closed_pnl")))


def live_balances(users: DataFrame) -> DataFrame:
    """Newest balance and credit per login over its platforms."""
    return keyed.newest(users, ["login"], ["updated", "source"]).select(
        "login", F.coalesce("balance", m.zero()).alias("balance_now"), F.coalesce("credit", m.zero()).alias("credit_now"))


def eod_rows(equity: DataFrame, day: Column) -> DataFrame:
    """Newest equity row per login of one day."""
    rows = equity.where((F.col("at") >= _ts(day)) & (F.col("at") < _ts(F.date_add(day, 1))))
    return keyed.newest(rows, ["login"], ["at", "source"])


def per_login_live(equity: DataFrame, bonuses: DataFrame, bridge: DataFrame, accounts: DataFrame, positions: DataFrame,
                   deals: DataFrame, users: DataFrame, snapshots: DataFrame, day: str, with_equity: bool = True) -> DataFrame:
    """One row per login with everything the live figures fold together; aggregates are stacked, not joined."""
    yesterday = F.date_sub(_day(day), 1)
    eod = eod_rows(equity, yesterday).select("login", _floor(_net()).cast(USD).alias("start_net"),
                                             F.coalesce("floating", m.zero()).cast(USD).alias("eod_floating"))
    start = snapshots.where(F.col("day") == yesterday).select("login", F.col("end_eez").cast(USD).alias("start_eez"))
    open_now = open_floating(positions).withColumn("open_logins", F.lit(1))
    balances = live_balances(users).withColumn("known", F.lit(1))
    spec = {"start_net": USD, "eod_floating": USD, "start_eez": USD, "floating_now": USD, "open_logins": "bigint",
            "balance_now": USD, "credit_now": USD, "known": "bigint", "bonus": USD, "closed_pnl": USD}
    bonus = bonus_until(bonuses, _ts(F.date_add(_day(day), 1)))
    rows = stack_measures([eod, start, open_now, balances, bonus, closed_result(deals, day)], ["login"], spec)
    return rows.join(bridge_logins(bridge, accounts, with_equity=with_equity), "login", "left_semi")


def live_equity(equity: DataFrame, bonuses: DataFrame, bridge: DataFrame, accounts: DataFrame, positions: DataFrame,
                deals: DataFrame, users: DataFrame, snapshots: DataFrame, kpis: DataFrame, day: str) -> DataFrame:
    """Live equity without bonus, the day's PnL and both cash PnL variants; one row.

    Per login: balance plus open floating, less the positive part of the bonus, floored at zero. Opening equity
    counts every live login, the rest only logins whose bridge row shows equity.
    """
    rows = per_login_live(equity, bonuses, bridge, accounts, positions, deals, users, snapshots, day)
    net = F.col("balance_now") + F.col("floating_now")
    known, opened = F.col("known") > 0, F.col("open_logins") > 0

    def total(value: Column, name: str, test: Column = F.lit(True)) -> Column:
        return m.usd_sum(F.when(test, value)).alias(name)

    folded = rows.agg(
        total(_floor(net - _floor(F.col("bonus"))), "total_eez", known), total(_floor(net), "end_net_equity", known),
        total(F.col("floating_now"), "current_floating"), total(F.col("eod_floating"), "eod_floating_yesterday", opened),
        total(F.col("closed_pnl"), "closed_pnl_today"), total(F.col("start_net"), "start_net_equity"))
    start = (snapshots.where(F.col("day") == F.date_sub(_day(day), 1))
             .join(bridge_logins(bridge, accounts), "login", "left_semi").agg(m.usd_sum(F.col("end_eez")).alias("start_eez")))
    net_today = kpis.where(F.col("tx_date") == _day(day)).agg(m.usd_sum(F.col("net_usd")).alias("net_deposits"))
    bonus_today = bonuses.where(m.between_days("confirmed", day, day)).agg(m.usd_sum(F.col("amount")).alias("bonuses_today"))
    row = sb.one_row(equity.sparkSession, folded, start, net_today, bonus_today)
    return (row.withColumn("daily_pnl", F.col("current_floating") - F.col("eod_floating_yesterday") + F.col("closed_pnl_today"))
            .withColumn("pnl_cash", F.col("start_eez") - F.col("total_eez") - F.col("net_deposits"))
            .withColumn("daily_pnl_cash", F.col("end_net_equity") - F.col("start_net_equity") - F.col("net_deposits")
                        - F.col("bonuses_today")))


def pick_fresher(remote: DataFrame | None, local: DataFrame, time: str, oldest: str, last_good: DataFrame | None = None) -> DataFrame:
    """The remote copy while it is fresh enough, else the local one, else the last good rows, as one plan without an action.

    Freshness is a scalar over the remote copy's time column, and the local copy counts if it has rows, so the choice is
    made when the query runs. Without `last_good` an empty local copy is taken as it is.
    """
    labelled = lambda df, name: df.withColumn("data_source", F.lit(name))
    if remote is None:
        fresh, out = F.lit(False), None
    else:
        fresh = remote.agg(F.coalesce(F.max(time) >= F.lit(oldest).cast("timestamp_ntz"), F.lit(False))).scalar()
        out = labelled(remote.where(fresh), "remote")
    held = labelled(local.where(~fresh), "local")
    out = held if out is None else out.unionByName(held)
    if last_good is None:
        return out
    none_local = local.agg(F.count(F.lit(1)) == 0).scalar()
    return out.unionByName(labelled(last_good.where(~fresh & none_local), "last good"))


# ---- R31 ---------------------------------------------------------------------------------------------------


def net_by_login(money: DataFrame, bridge: DataFrame, accounts: DataFrame, day: str) -> DataFrame:
    """Money of a day without bonus comments, of non-test accounts, counted for every live login of the account."""
    logins = (bridge.where(m.not_deleted() & F.col("account_id").isNotNull())
              .select(F.expr("try_cast(login AS bigint)").alias("login"), "account_id").where("login IS NOT NULL"))
    real = accounts.where(m.real_account()).select("account_id")
    paid = (money.where(m.valid_money() & m.not_bonus_comment() & m.between_days("confirmed", day, day))
            .groupBy("account_id").agg(F.sum(m.signed_usd()).cast(USD).alias("usd")).join(real, "account_id", "left_semi"))
    return logins.join(paid, "account_id").groupBy("login").agg(F.sum("usd").cast(USD).alias("net_usd"))


def pnl_bridge(logins: DataFrame, rows: DataFrame, net: DataFrame) -> DataFrame:
    """For each of the logins, and only these, opening equity, money, PnL, what they add up to, the live value and the gap."""
    dpnl = F.col("floating_now") - F.col("eod_floating") + F.col("closed_pnl")
    live = _floor(F.col("balance_now") + F.col("floating_now") - F.col("credit_now") - _floor(F.col("bonus")))
    both = logins.select("login").distinct().join(rows, "login", "left").join(net, "login", "left").fillna(0)
    out = both.select("login", "start_eez", F.col("net_usd").alias("net_dep"), dpnl.cast(USD).alias("daily_pnl"),
                      live.cast(USD).alias("live_eez"))
    out = out.withColumn("formula", (F.col("start_eez") + F.col("net_dep") + F.col("daily_pnl")).cast(USD))
    out = out.withColumn("gap", (F.col("live_eez") - F.col("formula")).cast(USD))
    up, on = F.col("start_eez") > 0, F.col("live_eez") > 0
    return out.withColumn("category", F.when(up & on, "A").when(~up & on, "B").when(up & ~on, "C").otherwise("D"))


def bridge_summary(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("category").agg(
        F.count(F.lit(1)).alias("logins"),
        *[F.sum(c).cast(USD).alias(c) for c in ("start_eez", "net_dep", "daily_pnl", "formula", "live_eez", "gap")])


def top_gaps(bridge: DataFrame, column: str = "gap", least: float = 100, k: int = 20) -> DataFrame:
    """The largest differences by size; ties resolved by login."""
    return (bridge.where(F.abs(F.col(column)) > least).orderBy(F.desc(F.abs(F.col(column))), "login").limit(k))


# ---- R32 ---------------------------------------------------------------------------------------------------


def cash_pnl_series(equity: DataFrame, snapshots: DataFrame, kpis: DataFrame, bonuses: DataFrame,
                    logins: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Daily cash PnL by several formulas side by side, against reference values when given.

    All closing sums of a day come from one pass over the newest row per login and day; the day before is an
    equi join on the shifted date over one row per day. Only equity of the given logins counts: live, not test,
    with equity on the bridge.
    """
    days = jobs.equity_by_day(equity).join(logins.select("login").distinct(), "login", "left_semi")
    credit = _floor(F.col("equity") - F.col("balance") - F.col("floating"))
    floating = F.coalesce(F.col("floating"), m.zero())
    sums = days.groupBy("day").agg(
        m.usd_sum(_floor(_net())).alias("eod_net"), m.usd_sum(_floor(F.col("equity"))).alias("eod_equity"),
        m.usd_sum(_floor(floating)).alias("eod_floating"), m.usd_sum(_floor(F.col("floating") - credit)).alias("eod_float_credit"),
        m.usd_sum(_floor(F.col("prev_equity"))).alias("sod_clipped"), m.usd_sum(F.col("prev_equity")).alias("sod_plain"),
        m.usd_sum(F.col("net_deposit")).alias("platform_net"))
    eez = snapshots.groupBy("day").agg(m.usd_sum(F.col("end_eez")).alias("eez"))
    net = kpis.groupBy(F.col("tx_date").alias("day")).agg(m.usd_sum(F.col("net_usd")).alias("net_dep"))
    bonus = bonuses.groupBy(F.to_date("confirmed").alias("day")).agg(m.usd_sum(F.col("amount")).alias("bonus"))
    now = sums.join(eez, "day", "left")
    before = now.select(F.date_add("day", 1).alias("day"), *[
        F.col(c).alias(f"p_{c}") for c in ("eod_net", "eod_floating", "eod_float_credit", "eez")])
    rows = (now.join(before, "day", "left").join(net, "day", "left").join(bonus, "day", "left")
            .fillna(0, ["net_dep", "bonus"]))
    c = F.col
    rows = rows.select(
        "day", c("net_dep"), c("bonus"), (c("eez") - c("p_eez") - c("net_dep")).alias("eez_formula"),
        (c("eod_net") - c("p_eod_net") - c("net_dep")).alias("f1"),
        (c("eod_net") - c("sod_clipped") - c("net_dep")).alias("f2"),
        (c("eod_net") - c("p_eod_net") - c("net_dep") - c("bonus")).alias("f3"),
        (c("eod_net") - c("sod_plain") - c("net_dep")).alias("f4"),
        (c("eod_equity") - c("sod_clipped") - c("net_dep")).alias("f5"),
        (c("eod_floating") - c("p_eod_floating") - c("net_dep")).alias("floating_only"),
        (c("eod_float_credit") - c("p_eod_float_credit") - c("net_dep")).alias("floating_less_credit"))
    if reference is not None:
        rows = rows.join(reference.select("day", F.col("value").alias("reference")), "day", "left")
        rows = rows.withColumns({f"gap_{f}": F.col(f) - F.col("reference") for f in ("f1", "f2", "f3", "f4", "f5")})
    return rows.orderBy("day")


def signed_login_pnl(equity: DataFrame, net_by_login_day: DataFrame) -> DataFrame:
    """R32 per login: positive closing value less positive opening value less the day's money, summed by day.

    A login without a row on a side counts as zero there; only logins with a row on one of the sides count.
    """
    eod = jobs.equity_by_day(equity).select("login", "day", F.coalesce("floating", m.zero()).cast(USD).alias("end_value"), F.lit(1).alias("sides"))
    opening = eod.select("login", F.date_add("day", 1).alias("day"), F.col("end_value").alias("start_value"), "sides")
    rows = stack_measures([eod, opening, net_by_login_day], ["login", "day"],
                          {"end_value": USD, "start_value": USD, "net_dep": USD, "sides": "bigint"}).where("sides > 0")
    pnl = _floor(F.col("end_value")) - _floor(F.col("start_value")) - F.col("net_dep")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("logins"), F.sum(pnl).cast(USD).alias("pnl")).orderBy("day")


# ---- R35, R36 ----------------------------------------------------------------------------------------------


def login_profile(snapshots: DataFrame, users: DataFrame, bonuses: DataFrame, money: DataFrame, deposits: int = 30,
                  logins: list[int] | None = None) -> DataFrame:
    """Per login the latest snapshot, live balance, bonus sum and its largest deposits, one row per item."""
    last = keyed.newest(snapshots, ["login"], ["day"]).select(
        "login", F.lit("snapshot").alias("item"), F.col("day").cast("string").alias("detail"), F.col("end_eez").cast(USD).alias("value"))
    balance = live_balances(users).select("login", F.lit("balance").alias("item"), F.lit(None).cast("string").alias("detail"),
                                          F.col("balance_now").cast(USD).alias("value"))
    bonus = bonuses.groupBy("login").agg(F.sum("amount").cast(USD).alias("value"), F.count(F.lit(1)).cast("string").alias("detail"))
    bonus = bonus.select("login", F.lit("bonus").alias("item"), "detail", "value")
    paid = money.where(m.approved() & (F.col("type") == "Deposit")).select(
        F.expr("try_cast(login AS bigint)").alias("login"), "money_id", F.col("usd").cast(USD).alias("value"))
    top = keyed.top_rows(paid.where("login IS NOT NULL"), ["login"], [F.desc("value"), F.asc("money_id")], deposits).select(
        "login", F.lit("deposit").alias("item"), F.col("money_id").cast("string").alias("detail"), "value")
    out = last.unionByName(balance).unionByName(bonus).unionByName(top)
    return out if logins is None else out.where(F.col("login").isin(*logins))


def replay(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored against recomputed snapshot totals by day, with the number of logins that differ."""
    a = stored.select("login", "day", F.col("end_eez").alias("s"))
    b = recomputed.select("login", "day", F.col("end_eez").alias("r"))
    return (a.join(b, ["login", "day"], "full").groupBy("day").agg(
        m.usd_sum(F.col("s")).alias("stored"), m.usd_sum(F.col("r")).alias("recomputed"),
        F.count_if(~F.col("s").eqNullSafe(F.col("r"))).alias("logins_off"))
        .withColumn("diff", F.col("recomputed") - F.col("stored")).orderBy("day"))


def snapshot_statistics(snapshots: DataFrame) -> DataFrame:
    """Logins, total, least, greatest and average equity by snapshot day."""
    return snapshots.groupBy("day").agg(
        F.count(F.lit(1)).alias("logins"), m.usd_sum(F.col("end_eez")).alias("total"), F.min("end_eez").alias("least"),
        F.max("end_eez").alias("greatest"), F.round(F.avg("end_eez"), 2).alias("average"))
