"""Agent scoreboards and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import buckets as b, calendar as cal, money as m
from ledgerlight.functions.numeric import round_even
from ledgerlight.operators import keyed
from ledgerlight.operators.grouping import stack_measures
from ledgerlight.plans import views

USD = "decimal(28,4)"


def _d(day: str) -> Column:
    return F.lit(day).cast("date")


def _in(col: str, first: str, last: str) -> Column:
    return F.col(col).between(_d(first), _d(last))


def month_targets(targets: DataFrame, first: str) -> DataFrame:
    """Agent targets of the month the range starts in."""
    return (targets.where(F.col("month") == F.lit(cal.month_start(first)))
            .select(F.expr("try_cast(agent_id AS bigint)").alias("agent_id"),
                    F.col("ftc").cast("int").alias("target_ftc"), F.col("net").cast(USD).alias("target_net")))


def targets_for(first: str, targets: DataFrame, history: DataFrame, switch: str) -> DataFrame:
    """Targets from the plan table, or from the tenure history for months from `switch` on."""
    if first < switch:
        return month_targets(targets, first)
    return (history.where((F.col("report_month") == F.lit(cal.month_start(first))) & F.col("agent_id").isNotNull())
            .select("agent_id", F.col("ftd100_target").alias("target_ftc"),
                    F.col("net_target").cast(USD).alias("target_net")))


def kpi_measures(kpis: DataFrame, first: str, last: str) -> DataFrame:
    """V1 over a range, by agent: both date axes read in one scan, then split by conditional sums."""
    tx, qual = _in("tx_date", first, last), _in("qual_date", first, last)
    today, qual_today = F.col("tx_date") == _d(last), F.col("qual_date") == _d(last)

    def total(test: Column, col: str, name: str) -> Column:
        return F.sum(F.when(test, F.col(col))).alias(name)

    return kpis.where(tx | qual).groupBy("agent_id").agg(
        total(qual, "ftc_count", "ftc"), total(tx, "net_usd", "net_usd"), total(tx, "deposit_usd", "deposit_usd"),
        total(tx, "ftd_count", "ftd_count"), total(tx, "ftd_usd", "ftd_usd"),
        total(today, "ftd_count", "daily_ftd"), total(today, "ftd_usd", "daily_ftd_usd"),
        total(qual_today, "ftc_count", "daily_ftc"), total(today, "net_usd", "daily_net"))


def ftd100_measures(clients: DataFrame, first: str, last: str, accounts: DataFrame | None = None,
                    account_filter: Column | None = None) -> DataFrame:
    rows = clients.where(m.between_days("reached_at", first, last))
    if account_filter is not None:
        rows = rows.join(accounts.where(account_filter).select("account_id"), "account_id", "left_semi")
    return rows.groupBy(F.col("owner").alias("agent_id")).agg(F.count("account_id").alias("ftd100"))


def ftd_scores(money: DataFrame, accounts: DataFrame, first: str, last: str, as_of: str) -> DataFrame:
    """Average score of the distinct clients behind an agent's FTDs: over the range and on its last day."""
    clients = (views.money_by_account_day(money, m.is_ftd() & m.between_days("confirmed", first, last))
               .groupBy("owner", "account_id").agg(F.max(F.col("tx_date") == _d(last)).alias("today")))
    scored = accounts.where(m.real_account()).select(
        "account_id", b.score_or_age(F.col("score"), F.col("birth_date"), as_of).alias("s"))
    return (clients.join(scored.where("s IS NOT NULL"), "account_id")
            .groupBy(F.col("owner").alias("agent_id"))
            .agg(F.round(F.avg("s"), 1).alias("avg_score"),
                 F.round(F.avg(F.when(F.col("today"), F.col("s"))), 1).alias("daily_avg_score")))


SALES_MEASURES = {
    "ftc": "bigint", "net_usd": USD, "ftd_count": "bigint", "ftd_usd": USD, "daily_ftd": "bigint",
    "daily_ftd_usd": USD, "daily_ftc": "bigint", "daily_net": USD, "target_ftc": "bigint", "ftd100": "bigint",
    "avg_score": "max double", "daily_avg_score": "max double",
}


def _agents_with(agents: DataFrame, measures: DataFrame, where: Column, spec: dict) -> DataFrame:
    """Agents that satisfy the report's filter, with their measures or zeros."""
    fill = [c for c, t in spec.items() if not t.startswith("max ")]
    return agents.where(where).join(measures, "agent_id", "left").fillna(0, fill)


def sales_scoreboard(kpis: DataFrame, clients: DataFrame, targets: DataFrame, agents: DataFrame, first: str,
                     last: str, scores: DataFrame | None = None, access: Column | None = None,
                     active_only: bool = True, ftd100: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """R1 / R4 rows: active conversion agents with FTC, target, FTD100, net, FTD and the last day's figures.

    Sorting by range computes the rows twice, once to sample them; callers that only count or test them need no order.
    """
    frames = [kpi_measures(kpis, first, last), targets,
              ftd100 if ftd100 is not None else ftd100_measures(clients, first, last)]
    if scores is not None:
        frames.append(scores)
    measures = stack_measures(frames, ["agent_id"], SALES_MEASURES)
    where = (F.col("dept") == "Sales") & (F.col("team") == "Conversion") & m.countable_agent()
    if active_only:
        where = where & (F.col("status") == "Active")
    if access is not None:
        where = where & access
    out = _agents_with(agents, measures, where, SALES_MEASURES).select(
        "agent_id", F.coalesce("office_name", F.lit("N/A")).alias("office_name"),
        F.coalesce("agent_name", "full_name", F.lit("N/A")).alias("agent_name"), "dept", "ftc", "target_ftc",
        "ftd100", F.col("net_usd").alias("net_deposits"), "ftd_count", F.col("ftd_usd").alias("ftd_amount"),
        "daily_ftd", F.col("daily_ftd_usd").alias("daily_ftd_amount"), "daily_ftc", "daily_net",
        F.coalesce("status", F.lit("")).alias("status"),
        *(["avg_score", "daily_avg_score"] if scores is not None else []))
    return out.orderBy(F.asc_nulls_last("office_name"), F.desc("ftc"), "agent_name") if ordered else out


def company_gap(rows: DataFrame, company_targets: DataFrame, first: str) -> DataFrame:
    """The part of the company target no agent carries, as a row of its own when there is any."""
    company = company_targets.where(F.col("month") == F.lit(cal.month_start(first))).agg(
        F.max("sales_ftc")).scalar()
    gap = rows.agg(F.coalesce(F.sum("target_ftc"), F.lit(0)).alias("t")).select(
        (company - F.col("t")).alias("gap")).where("gap > 0")
    values = {"office_name": F.lit("General"), "agent_name": F.lit("General"), "dept": F.lit("Sales"),
              "target_ftc": round_even(F.col("gap"), 0), "status": F.lit("Active")}
    types = dict(rows.dtypes)
    nulls = ("agent_id", "avg_score", "daily_avg_score")
    extra = gap.select(*[
        values.get(c, F.lit(None) if c in nulls else F.lit(0)).cast(types[c]).alias(c) for c in rows.columns])
    return rows.unionByName(extra)


def rdp_by_agent(money: DataFrame, accounts: DataFrame, first: str, last: str,
                 account_filter: Column | None = None, offset: str = "INTERVAL '23:59:59' HOUR TO SECOND") -> DataFrame:
    """Net money that came later than the qualification plus an offset, by the account's current agent."""
    acc = accounts.where(F.col("qualified").isNotNull())
    if account_filter is not None:
        acc = acc.where(account_filter)
    acc = acc.select("account_id", "assigned_to", (F.col("qualified") + F.expr(offset)).alias("_after"))
    rows = (money.where(m.valid_money() & m.not_bonus_comment() & m.between_days("confirmed", first, last))
            .select("account_id", "confirmed", m.signed_usd().alias("usd")))
    later = keyed.beyond_mark(rows, acc, ["account_id"], "confirmed", "_after", [F.sum("usd").alias("usd")], after=True)
    return (later.groupBy("account_id").agg(F.sum("usd").alias("usd")).join(acc, "account_id")
            .groupBy(F.col("assigned_to").alias("agent_id")).agg(F.sum("usd").cast(USD).alias("rdp_net")))


def trading_activity(volume: DataFrame, accounts: DataFrame, first: str, last: str, as_of: str) -> DataFrame:
    """(agent, account) trading in the range from one pass over V2: notional, and trader flags of live accounts.

    Volume counts every account of V2, traders only live ones with positive notional, so both come from the
    same rows; `traded` and `today` stay false for accounts that only add volume.
    """
    acc = accounts.where(m.live_account()).select(
        "account_id", F.lit(True).alias("live"), b.score_or_age(F.col("score"), F.col("birth_date"), as_of).alias("score_now"),
        b.score_or_age(F.col("score"), F.col("birth_date"), last).alias("score_last"))
    positive, live = F.col("has_positive_notional") == 1, F.coalesce("live", F.lit(False))
    return (volume.where(_in("open_date", first, last)).groupBy("agent_id", "account_id")
            .agg(F.sum("notional_usd").cast(USD).alias("notional_usd"), F.max(positive).alias("_traded"),
                 F.max(positive & (F.col("open_date") == _d(last))).alias("_today"))
            .join(acc, "account_id", "left")
            .withColumn("traded", F.col("_traded") & live).withColumn("today", F.col("_today") & live)
            .drop("_traded", "_today", "live"))


def activity_measures(activity: DataFrame) -> DataFrame:
    """Volume, trader counts and average scores by agent; one row per (agent, account) makes counts plain sums."""
    high = F.coalesce(F.col("score_last").between(6, 10), F.lit(False))
    return activity.groupBy("agent_id").agg(
        F.sum("notional_usd").cast(USD).alias("open_volume_usd"), F.count_if("traded").alias("traders_count"),
        F.count_if("today").alias("daily_traders"), F.count_if(F.col("today") & high).alias("daily_traders_hq"),
        F.round(F.avg(F.when(F.col("traded"), F.col("score_now"))), 1).alias("monthly_avg_score"),
        F.round(F.avg(F.when(F.col("today"), F.col("score_now"))), 1).alias("daily_avg_score"))


def deposit_flags(money: DataFrame, accounts: DataFrame, first: str, last: str) -> DataFrame:
    """(agent, account) pairs with a deposit in the range, and whether on its last day."""
    rows = (views.money_by_account_day(
                money, (F.col("type") == "Deposit") & m.between_days("confirmed", first, last), bonus_comments=False)
            .groupBy("owner", "account_id").agg(F.max(F.col("tx_date") == _d(last)).alias("today")))
    return rows.join(accounts.where(m.live_account()).select("account_id"), "account_id", "left_semi")


def load_measures(flags: DataFrame) -> DataFrame:
    return flags.groupBy(F.col("owner").alias("agent_id")).agg(
        F.count(F.lit(1)).alias("monthly_loads"), F.count_if("today").alias("daily_loads"))


def std_measures(std: DataFrame, first: str, last: str) -> DataFrame:
    at = F.to_date("second_deposit_at")
    return (std.where((F.col("has_second_deposit") == 1) & at.between(_d(first), _d(last))).groupBy("agent_id")
            .agg(F.count("account_id").alias("std_count"), F.count_if(at == _d(last)).alias("daily_std")))


def volume_measures(volume: DataFrame, first: str, last: str) -> DataFrame:
    return (volume.where(_in("open_date", first, last)).groupBy("agent_id")
            .agg(F.sum("notional_usd").cast(USD).alias("open_volume_usd")))


RETENTION_MEASURES = {
    "target_net": USD, "net_usd": USD, "deposit_usd": USD, "daily_net": USD, "open_volume_usd": USD,
    "std_count": "bigint", "daily_std": "bigint", "traders_count": "bigint", "rdp_net": USD,
    "daily_traders": "bigint", "daily_traders_hq": "bigint", "daily_loads": "bigint", "monthly_loads": "bigint",
    "daily_avg_score": "max double", "monthly_avg_score": "max double",
}


def retention_scoreboard(kpis: DataFrame, targets: DataFrame, activity: DataFrame, std: DataFrame, rdp: DataFrame,
                         agents: DataFrame, dept_history: DataFrame, first: str, last: str,
                         loads: DataFrame | None = None, access: Column | None = None) -> DataFrame:
    """R2 / R5 rows: retention agents, by department or by an effective-dated assignment in the range.

    `activity` comes from activity_measures, `loads` from load_measures; without loads the shorter form results.
    """
    frames = [kpi_measures(kpis, first, last), targets, activity, std_measures(std, first, last), rdp]
    frames += [loads] if loads is not None else []
    measures = stack_measures(frames, ["agent_id"], RETENTION_MEASURES)
    moved = (keyed.overlapping(dept_history.where("report_dept = 'Retention'"), "agent_id", first, last)
             .withColumn("_moved", F.lit(True)))
    where = m.countable_agent()
    if access is not None:
        where = where & access
    rows = _agents_with(agents, measures, where, RETENTION_MEASURES).join(moved, "agent_id", "left")
    rows = rows.where((F.col("dept") == "Retention") | F.col("_moved"))
    wide = [] if loads is None else ["daily_traders", "daily_traders_hq", "daily_loads", "monthly_loads",
                                     "daily_std", "daily_avg_score", "monthly_avg_score"]
    return rows.select(
        "agent_id", F.coalesce("office_name", F.lit("N/A")).alias("office_name"),
        F.coalesce("department", F.lit("N/A")).alias("dept_name"),
        F.coalesce("agent_name", "full_name", F.lit("N/A")).alias("agent_name"), "target_net", "net_usd",
        "deposit_usd", "open_volume_usd", F.col("daily_net").alias("daily_net_usd"),
        F.coalesce("status", F.lit("")).alias("status"), "std_count", "traders_count", "rdp_net", *wide,
    ).orderBy(F.asc_nulls_last("office_name"), "dept_name", "agent_name")


def retention_globals(activity: DataFrame, deposits: DataFrame, agents: DataFrame) -> DataFrame:
    """R5 cards: distinct clients over all retention agents, one row.

    An account may sit with several agents, so flags are folded to one row per account before counting.
    """
    team = agents.where(m.not_test_agent() & (F.col("dept") == "Retention")).select("agent_id")
    high = F.coalesce(F.col("score_last").between(6, 10), F.lit(False))
    t = (activity.where("traded").join(team, "agent_id", "left_semi").groupBy("account_id")
         .agg(F.max("today").alias("today"), F.max(F.col("today") & high).alias("hq"))
         .agg(F.count(F.lit(1)).alias("monthly_traders"), F.count_if("today").alias("daily_traders"),
              F.count_if("hq").alias("daily_traders_hq")))
    d = (deposits.join(team, F.col("owner") == F.col("agent_id"), "left_semi").groupBy("account_id")
         .agg(F.max("today").alias("today"))
         .agg(F.count(F.lit(1)).alias("monthly_depositors"), F.count_if("today").alias("daily_depositors")))
    return one_row(activity.sparkSession, t, d)


def one_row(spark, *parts: DataFrame, **extra: Column) -> DataFrame:
    """Side by side view of one-row aggregates: each is a scalar subquery, so nothing is joined."""
    row = spark.range(1).select(*[
        p.select(F.struct(*p.columns).alias("s")).scalar().alias(f"p{i}") for i, p in enumerate(parts)])
    return row.select(*[f"p{i}.{c}" for i, p in enumerate(parts) for c in p.columns],
                      *[c.alias(n) for n, c in extra.items()])


def kpi_totals(kpis: DataFrame, first: str, last: str) -> DataFrame:
    """Grand totals over all agents; one row."""
    tx, qual = _in("tx_date", first, last), _in("qual_date", first, last)
    today, qual_today = F.col("tx_date") == _d(last), F.col("qual_date") == _d(last)

    def total(test: Column, col: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(col))), F.lit(0)).alias(name)

    return kpis.where(tx | qual).agg(
        total(qual, "ftc_count", "grand_ftc"), total(tx, "ftd_count", "grand_ftd"),
        total(today, "ftd_count", "daily_ftd"), total(qual_today, "ftc_count", "daily_ftc"),
        total(tx, "net_usd", "grand_net"), total(today, "net_usd", "daily_net"))


def scoreboard_totals(kpis: DataFrame, volume: DataFrame, accounts: DataFrame, holidays: DataFrame, first: str,
                      last: str, today: str, end_equity: DataFrame | None = None) -> DataFrame:
    """R1 / R2 cards with run rates (R13); one row."""
    spark = kpis.sparkSession
    vol = volume.where(_in("open_date", first, last)).agg(m.usd_sum(F.col("notional_usd")).alias("open_volume"))
    parts = [kpi_totals(kpis, first, last), vol, views.account_stats(accounts, today)]
    if end_equity is not None:
        parts.append(end_equity)
    row = one_row(spark, *parts, **cal.progress(first, last, today, holidays))
    passed, total = F.col("working_days_passed"), F.col("working_days")
    return (row.withColumn("grand_ftc_rr", cal.run_rate(F.col("grand_ftc"), passed, total))
            .withColumn("grand_ftd_rr", cal.run_rate(F.col("grand_ftd"), passed, total))
            .withColumn("grand_net_rr", cal.run_rate(F.col("grand_net"), passed, total, 2))
            .withColumn("open_volume_rr", F.when(F.col("open_volume") > 0,
                                                 cal.run_rate(F.col("open_volume"), passed, total))
                        .otherwise(round_even(F.col("open_volume").cast("double"), 0))))


def dashboard(run_rate: DataFrame, volume: DataFrame, accounts: DataFrame, equity: DataFrame, bridge: DataFrame,
              holidays: DataFrame, today: str) -> DataFrame:
    """Day, month and projected month for net (by department), FTD, FTC and volume; last PnL day; leads."""
    start, end = cal.month_start(today), cal.month_end(today)
    day, first = _d(today), F.lit(start)
    spark = run_rate.sparkSession
    tx = F.col("tx_date").between(first, day)
    qual = F.col("qual_date").between(first, day) & (F.col("dept_group") == "all")

    def pair(test: Column, at: str, col: str, name: str) -> list[Column]:
        return [F.coalesce(F.sum(F.when(test & (F.col(at) == day), F.col(col))), F.lit(0)).alias(f"{name}_daily"),
                F.coalesce(F.sum(F.when(test, F.col(col))), F.lit(0)).alias(f"{name}_monthly")]

    def group(g: str) -> Column:
        return tx & (F.col("dept_group") == g)

    kpi = run_rate.where(tx | qual).agg(
        *pair(group("all"), "tx_date", "net_usd", "net"), *pair(group("sales"), "tx_date", "net_usd", "net_sales"),
        *pair(group("retention"), "tx_date", "net_usd", "net_retention"),
        *pair(group("all"), "tx_date", "ftd_count", "ftd"), *pair(qual, "qual_date", "ftc_count", "ftc"))
    vol = volume.where(F.col("open_date").between(first, day)).agg(
        *pair(F.lit(True), "open_date", "notional_usd", "volume"))
    month_rows = equity.where((F.col("at") >= F.lit(start).cast("timestamp_ntz"))
                              & (F.col("at") < F.lit(cal.next_month(today)).cast("timestamp_ntz")))
    pnl_day = F.coalesce(month_rows.agg(F.to_date(F.max("at"))).scalar(), F.date_sub(day, 1))
    logins = views.login_accounts(bridge, accounts).groupBy("login").agg(F.count(F.lit(1)).alias("n"))
    pnl = (equity.where((F.col("at") >= pnl_day.cast("timestamp_ntz")) & (F.col("at") < F.date_add(pnl_day, 1).cast("timestamp_ntz"))).groupBy("login")
           .agg(F.sum(F.coalesce("closed_pnl", m.zero()) + F.coalesce("delta_floating", m.zero())).alias("v"))
           .join(logins, "login").agg(m.usd_sum(F.col("v") * F.col("n")).alias("pnl_daily")))
    row = one_row(spark, kpi, vol, pnl, views.account_stats(accounts, today), pnl_day=pnl_day,
                  working_days=cal.working_days(start, end, holidays),
                  working_days_passed=cal.working_days(start, today, holidays))
    passed, total = F.col("working_days_passed"), F.col("working_days")
    for name in ("net", "net_sales", "net_retention", "ftd", "ftc", "volume"):
        places = 0 if name in ("ftd", "ftc") else 2
        row = row.withColumn(f"{name}_rr", cal.run_rate(F.col(f"{name}_monthly"), passed, total, places))
    return row


def agent_scorecard(performance: DataFrame, agents: DataFrame, as_of: str, access: Column | None = None,
                    active: bool = False) -> DataFrame:
    """Month-to-date FTC and net by agent from the agents' daily results.

    `active` gives the dimension-driven form: every active agent, zeros included.
    """
    rows = performance.where((F.col("report_date") >= F.lit(cal.month_start(as_of)))
                             & (F.col("report_date") < F.lit(cal.next_month(as_of))))
    sums = [F.sum("ftc").cast(USD).alias("total_ftc"), F.sum("net").cast(USD).alias("total_net"),
            F.count(F.lit(1)).alias("trading_days")]
    ids = agents.where(access) if access is not None else agents
    if active:
        ids = ids.where("status = 'Active'").select(
            F.col("agent_id").cast("string").alias("agent_id"), "full_name", "position", "office", "team")
        return (ids.join(rows.groupBy("agent_id").agg(*sums), "agent_id", "left")
                .fillna(0, ["total_ftc", "total_net", "trading_days"]).orderBy(F.desc("total_net")))
    if access is not None:
        rows = rows.join(ids.select(F.col("agent_id").cast("string").alias("agent_id")), "agent_id", "left_semi")
    return rows.groupBy("agent_id", "full_name").agg(*sums).orderBy(F.desc("total_net"))


def filtered_kpis(money: DataFrame, accounts: DataFrame, bands=(), values=()) -> DataFrame:
    """V1 in the reports' filtered form: by score band or value, without bonus-commented money."""
    return views.daily_kpis(money, accounts, None, b.score_filter(F.col("score"), bands, values),
                            bonus_comments=False)


def restricted_totals(rows: DataFrame) -> DataFrame:
    """Cards of a user who sees only some agents: sums of the rows they may see."""
    return rows.agg(*[F.sum(c).alias(f"total_{c}") for c in
                      ("ftc", "target_ftc", "ftd100", "net_deposits", "ftd_count", "daily_ftd", "daily_ftc", "daily_net")
                      if c in rows.columns])


