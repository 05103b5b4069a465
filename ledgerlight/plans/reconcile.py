"""Lists, sync status and cross-source comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import money as m
from ledgerlight.operators import compare, keyed
from ledgerlight.operators.grouping import stack_measures

USD = "decimal(28,4)"


def transactions(money: DataFrame, accounts: DataFrame, first: str, last: str) -> DataFrame:
    """Approved money of non-test accounts in a day range, newest first."""
    rows = money.where((F.col("approval") == "Approved") & m.between_days("confirmed", first, last))
    real = accounts.where(m.real_account()).select("account_id")
    return (rows.join(real, "account_id", "left_semi")
            .select("money_id", "login", "usd", "type", "owner", "confirmed").orderBy(F.desc("confirmed"), "money_id"))


def sync_status(log: DataFrame, now: str, max_age_hours: float) -> DataFrame:
    """Per table the newest run, the newest success, its age and whether the table is healthy.

    Max over structs in time order combines map-side, so a long log costs one row per table and task.
    """
    run = F.struct("ran_at", "run_id", "status", "rows", "duration_ms", "error")
    stat = log.groupBy("table_name").agg(
        F.max(run).alias("r"), F.max(F.when(F.col("status") == "success", F.col("ran_at"))).alias("last_success"),
        F.count(F.lit(1)).alias("runs"))
    at = F.lit(now).cast("timestamp_ntz")
    age = (F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(F.col("r.ran_at").cast("timestamp"))) / 3600.0
    return stat.select("table_name", "runs", "last_success", F.col("r.status").alias("status"), F.col("r.rows").alias("rows"),
                       F.col("r.error").alias("error"), F.round(age, 1).alias("age_hours"),
                       ((F.col("r.status") == "success") & (age <= max_age_hours)).alias("healthy"))


def last_runs(log: DataFrame, n: int = 50) -> DataFrame:
    """The last n log rows per table."""
    return keyed.top_rows(log, ["table_name"], [F.desc("ran_at"), F.desc("run_id")], n)


def retention_net(money: DataFrame, accounts: DataFrame, agents: DataFrame) -> DataFrame:
    """The ledger's side limited to retention agents: money of real accounts without bonus comments, by owner and day."""
    retention = agents.where("dept = 'Retention'").select(F.col("agent_id").alias("owner"))
    paid = (money.where(m.valid_money() & m.not_bonus_comment())
            .groupBy("owner", "account_id", F.to_date("confirmed").alias("tx_date")).agg(m.usd_sum(m.signed_usd()).alias("net_usd")))
    kept = paid.join(retention, "owner", "left_semi").join(accounts.where(m.real_account()).select("account_id"), "account_id", "left_semi")
    return kept.groupBy(F.col("owner").alias("agent_id"), "tx_date").agg(F.sum("net_usd").cast(USD).alias("net_usd"))


def net_by_source(kpis: DataFrame, equity: DataFrame, balance_ops: DataFrame, adjustments: tuple = (),
                  flag_above: float = 5000) -> DataFrame:
    """Net deposits by day from the ledger, the platform's daily rows and its balance operations.

    Balance operations count with and without adjustment comments; days on which ledger and platform differ by
    more than the limit are flagged.
    """
    ledger = kpis.groupBy(F.col("tx_date").alias("day")).agg(F.sum("net_usd").cast(USD).alias("ledger"))
    daily = equity.groupBy(F.to_date("at").alias("day")).agg(m.usd_sum(F.col("net_deposit")).alias("platform"),
                                                             F.count("net_deposit").alias("platform_rows"))
    plain = ~F.coalesce(F.col("comment").isin(*adjustments), F.lit(False)) if adjustments else F.lit(True)
    ops = balance_ops.where("cmd = 6").groupBy(F.to_date("close_time").alias("day")).agg(
        m.usd_sum(F.col("profit")).alias("operations"), m.usd_sum(F.when(plain, F.col("profit"))).alias("operations_plain"))
    rows = stack_measures([ledger, daily, ops], ["day"], {
        "ledger": USD, "platform": USD, "platform_rows": "bigint", "operations": USD, "operations_plain": USD})
    diff = F.col("ledger") - F.col("platform")
    return rows.withColumn("diff", diff).withColumn("flagged", F.abs(diff) > flag_above).orderBy("day")


def extra_logins(equity_rows: DataFrame, known: DataFrame) -> DataFrame:
    """Logins the platform reports but the warehouse does not count, by source: number, equity, money, ranked by number."""
    extra = equity_rows.join(known.select("login").distinct(), "login", "left_anti")
    value = F.coalesce(F.col("balance"), m.zero()) + F.coalesce(F.col("floating"), m.zero())
    groups = extra.groupBy("source").agg(
        F.count_distinct("login").alias("logins"), F.count_if(value > 0).alias("with_equity"),
        m.usd_sum(F.greatest(value, m.zero())).alias("equity"), m.usd_sum(F.col("net_deposit")).alias("net_deposit"))
    return groups.orderBy(F.desc("logins"), "source")


def daily_counts(rows: DataFrame, time: str, amount: Column | None = None) -> DataFrame:
    """Rows (and their sum) by day."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if amount is not None:
        aggs.append(F.sum(amount).cast(USD).alias("amount"))
    return rows.groupBy(F.to_date(time).alias("day")).agg(*aggs).orderBy("day")


def month_gaps(local: DataFrame, source: DataFrame, time: str) -> DataFrame:
    """Rows per month on both sides."""
    def counts(df: DataFrame) -> DataFrame:
        return df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    both = compare.side_by_side(counts(source), counts(local), ["month"], "n", ("source_rows", "local_rows"))
    return both.withColumn("missing", F.col("source_rows") - F.col("local_rows")).orderBy("month")


def missing_by_type(source: DataFrame, local: DataFrame) -> DataFrame:
    """Q16: source rows the copy lacks, by type and approval."""
    return (source.join(local.select("money_id"), "money_id", "left_anti")
            .groupBy("type", "approval").agg(F.count(F.lit(1)).alias("rows"), m.usd_sum(F.col("usd")).alias("usd")))
