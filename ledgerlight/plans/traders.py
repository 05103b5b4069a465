"""Traders and depositors over time (R11) and their split by client quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import buckets as b, money as m
from ledgerlight.operators.grouping import ratio, stack_measures
from ledgerlight.plans import scoreboards as sb

USD = "decimal(28,4)"


def _team(agents: DataFrame, access: Column | None = None) -> DataFrame:
    where = m.not_test_agent() & (F.col("dept") == "Retention")
    return agents.where(where if access is None else where & access).select("agent_id")


def team_traders(traders: DataFrame, accounts: DataFrame, agents: DataFrame, first: str, last: str,
                 chosen: Column | None = None, access: Column | None = None) -> DataFrame:
    """(day, account, agent) of the retention team in the range, with the account's score inputs."""
    acc = accounts if chosen is None else accounts.where(chosen)
    return (traders.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
            .join(_team(agents, access), "agent_id", "left_semi")
            .join(acc.select("account_id", "score", "birth_date"), "account_id"))


def team_money(money: DataFrame, accounts: DataFrame, agents: DataFrame, first: str, last: str,
               chosen: Column | None = None, access: Column | None = None) -> DataFrame:
    """(day, account, agent) money of the retention team: net and whether there was a deposit.

    The pre-aggregate keeps a row per account, owner and day, so deposits are looked for in a second flag.
    """
    acc = accounts.where(m.live_account() if chosen is None else m.live_account() & chosen)
    rows = money.where(m.valid_money() & m.between_days("confirmed", first, last))
    per = rows.groupBy("account_id", "owner", F.to_date("confirmed").alias("day")).agg(
        m.usd_sum(m.signed_usd()).alias("net"), F.max((F.col("type") == "Deposit").cast("int")).alias("deposited"))
    return (per.join(_team(agents, access), F.col("owner") == F.col("agent_id"), "left_semi")
            .join(acc.select("account_id", "score", "birth_date"), "account_id"))


def daily_series(traded: DataFrame, paid: DataFrame, first: str, last: str) -> DataFrame:
    """R11 series: traders, high-quality traders, average score, depositors and net for every weekday."""
    score = b.score_or_age(F.col("score"), F.col("birth_date"), F.col("day"))
    # one row per account and day already, so distinct traders are plain counts
    t = traded.groupBy("day").agg(F.count(F.lit(1)).alias("traders"), F.count_if(F.col("score").between(6, 10)).alias("high_traders"),
                                  F.round(F.avg(score), 2).alias("avg_score"))
    # a client may deposit with two agents on a day: fold before counting
    p = (paid.groupBy("day", "account_id").agg(F.max("deposited").alias("d"), F.sum("net").alias("net"))
         .groupBy("day").agg(F.sum("d").alias("depositors"), F.sum("net").cast(USD).alias("net")))
    spine = (traded.sparkSession.range(1)
             .select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
             .where(F.weekday("day") < 5))
    return (spine.join(t, "day", "left").join(p, "day", "left")
            .fillna(0, ["traders", "high_traders", "avg_score", "depositors", "net"]).orderBy("day"))


def series_totals(traded: DataFrame, paid: DataFrame, ref_day: str) -> DataFrame:
    """R11 totals: distinct clients over the range, average score over (account, day) rows, net and ratios.

    Net covers every day, weekends included, unlike the series.
    """
    score = b.score_or_age(F.col("score"), F.col("birth_date"), ref_day)
    t = (traded.withColumn("s", score).groupBy("account_id").agg(F.sum("s").alias("s"), F.count("s").alias("n"))
         .agg(F.count(F.lit(1)).alias("traders"), F.round(F.sum("s") / F.sum("n"), 2).alias("avg_score")))
    p = (paid.groupBy("account_id").agg(F.max("deposited").alias("d"), F.sum("net").alias("net"))
         .agg(F.coalesce(F.sum("d"), F.lit(0)).alias("depositors"), m.usd_sum(F.col("net")).alias("net")))
    row = sb.one_row(traded.sparkSession, t, p)
    return (row.withColumn("depositor_pct", ratio(F.col("depositors"), F.col("traders"), 2, 100))
            .withColumn("ltv_traders", ratio(F.col("net"), F.col("traders")))
            .withColumn("ltv_depositors", ratio(F.col("net"), F.col("depositors"))))


def agent_matrix(traded: DataFrame, paid: DataFrame, agents: DataFrame, ref_day: str) -> DataFrame:
    """R11 matrix: agent x day figures and, with a NULL day, the agent's totals over the range.

    Inputs hold one row per (agent, account, day), so day figures are plain aggregates; totals count distinct
    clients, so they fold to (agent, account) first and are not sums of days.
    """
    no_day = F.lit(None).cast("date").alias("day")
    on_day = b.score_or_age(F.col("score"), F.col("birth_date"), F.col("day"))
    on_ref = b.score_or_age(F.col("score"), F.col("birth_date"), ref_day)
    t_day = traded.groupBy("agent_id", "day").agg(F.count(F.lit(1)).alias("traders"), F.round(F.avg(on_day), 2).alias("avg_score"))
    t_all = (traded.groupBy("agent_id", "account_id").agg(F.sum(on_ref).alias("s"), F.count(on_ref).alias("n"))
             .groupBy("agent_id", no_day).agg(F.count(F.lit(1)).alias("traders"),
                                              F.round(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), 2).alias("avg_score")))
    p_day = paid.groupBy(F.col("owner").alias("agent_id"), "day").agg(
        F.sum("deposited").alias("depositors"), F.sum("net").cast(USD).alias("net"))
    p_all = (paid.groupBy("owner", "account_id").agg(F.max("deposited").alias("d"), F.sum("net").alias("net"))
             .groupBy(F.col("owner").alias("agent_id"), no_day).agg(F.sum("d").alias("depositors"), F.sum("net").cast(USD).alias("net")))
    both = stack_measures([t_day, t_all, p_day, p_all], ["agent_id", "day"], {
        "traders": "bigint", "avg_score": "max double", "depositors": "bigint", "net": USD})
    names = agents.select("agent_id", F.coalesce("office_name", F.lit("N/A")).alias("office_name"),
                          F.coalesce("department", F.lit("N/A")).alias("dept_name"),
                          F.coalesce("agent_name", "full_name", F.lit("N/A")).alias("agent_name"))
    return both.join(names, "agent_id").orderBy("office_name", "dept_name", "agent_name", "day")


def quality_by_month(traded: DataFrame, paid: DataFrame) -> DataFrame:
    """Traders, depositors, net and net per trader by month and client quality."""
    def label(df: DataFrame) -> DataFrame:
        return df.withColumn("month", F.trunc("day", "month")).withColumn(
            "quality", b.quality_label(F.col("score"), F.col("birth_date"), F.col("day")))

    keys = ["month", "quality"]
    t = label(traded).select(*keys, "account_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("traders"))
    p = (label(paid).groupBy(*keys, "account_id").agg(F.max("deposited").alias("d"), F.sum("net").alias("net"))
         .groupBy(*keys).agg(F.sum("d").alias("depositors"), F.sum("net").cast(USD).alias("net")))
    rows = stack_measures([t, p], keys, {"traders": "bigint", "depositors": "bigint", "net": USD})
    return rows.withColumn("net_per_trader", ratio(F.col("net"), F.col("traders"))).orderBy(*keys)


