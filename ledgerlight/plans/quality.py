"""Data-quality checks (Q1-Q17). A check yields result rows; results are stacked, scored and kept by date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.operators import compare, merge
from ledgerlight.schemas import SCHEMAS

PASS, WARN, FAIL, ERROR = "PASS", "WARN", "FAIL", "ERROR"
SEVERITY = (PASS, WARN, FAIL, ERROR)
COLUMNS = [f.name for f in SCHEMAS["qa_results"].fields]


def _text(c) -> Column:
    return F.lit(None).cast("string") if c is None else c.cast("string")


def result(check: str, context: Column, status: Column, message: Column, expected: Column | None = None,
           actual: Column | None = None, diff: Column | None = None, pct: Column | None = None) -> Column:
    """One result as a struct; report and section are added when the results are unfolded."""
    number = F.lit(0.0)
    return F.struct(F.lit(check).alias("check_name"), _text(context).alias("context"), _text(expected).alias("expected"),
                    _text(actual).alias("actual"), F.round(F.coalesce(diff, number) if diff is not None else number, 4).alias("diff"),
                    F.round(F.coalesce(pct, number) if pct is not None else number, 6).alias("pct_diff"),
                    status.alias("status"), message.alias("message"))


def unfold(df: DataFrame, report: str, section: str, results: list[Column]) -> DataFrame:
    """All results of every row, computed in one pass over the checked frame."""
    return (df.select(F.explode(F.array(*results)).alias("r"))
            .select(F.lit(report).alias("report"), F.lit(section).alias("section"), "r.*").select(*COLUMNS))


def verdict(ok: Column, bad: str = FAIL) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), PASS).otherwise(bad)


def equal(check: str, context: Column, expected: Column, actual: Column, tolerance: float = 0.0) -> Column:
    """Q2: relative tolerance; against an expected zero the difference itself must be within it."""
    e, a = expected.cast("double"), actual.cast("double")
    return result(check, context, verdict(compare.within(e, a, tolerance)),
                  F.concat(F.lit("expected="), F.coalesce(e.cast("string"), F.lit("NULL")), F.lit(", actual="),
                           F.coalesce(a.cast("string"), F.lit("NULL"))),
                  expected, actual, F.abs(e - a), compare.pct_diff(e, a))


def at_most(check: str, context: Column, low: Column, high: Column, bad: str = FAIL) -> Column:
    """Q6: ordering invariant."""
    return result(check, context, verdict(low <= high, bad), F.lit(f"{check}: first must not exceed second"), high, low)


def not_negative(check: str, context: Column, value: Column) -> Column:
    """Q5: finite and not below zero."""
    v = value.cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf")))
    return result(check, context, verdict(ok), F.lit(f"{check}: finite, not negative"), None, value)


def labelled(check: str, context: Column, value: Column, placeholders=("", "N/A", "Unknown", "(Unassigned)")) -> Column:
    """Q4: a label that is present and not a placeholder."""
    ok = value.isNotNull() & ~F.trim(value).isin(*placeholders)
    return result(check, context, verdict(ok, WARN), F.lit(f"{check}: label missing"), None, value)


def minimum_rows(df: DataFrame, report: str, section: str, least: int) -> DataFrame:
    """Q3: a warning when the frame holds fewer rows."""
    return unfold(df.agg(row_count()), report, section, [enough_rows(least)])


def row_count() -> Column:
    return F.count(F.lit(1)).alias("n")


def enough_rows(least: int) -> Column:
    return result("min_rows", F.lit("All rows"), verdict(F.col("n") >= least, WARN), F.lit(f"at least {least} rows"), F.lit(least), F.col("n"))


def coverage(df: DataFrame, report: str, section: str, condition: Column, least: float = 0.8) -> DataFrame:
    """Q7: share of rows that satisfy the condition."""
    return unfold(df.agg(share_of(condition)), report, section, [covered(least)])


def share_of(condition: Column) -> Column:
    return (F.count_if(condition) / F.count(F.lit(1))).alias("share")


def covered(least: float) -> Column:
    return result("coverage", F.lit("All rows"), verdict(F.col("share") >= least, WARN), F.lit(f"share of rows at least {least}"),
                  F.lit(least), F.round("share", 4))


def expected_groups(df: DataFrame, report: str, section: str, column: str, groups: list[str]) -> DataFrame:
    """Q9: every expected label present; one result per label."""
    spine = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(g) for g in groups])).alias("g"))
    seen = df.select(F.col(column).alias("g")).distinct().withColumn("_seen", F.lit(True))
    return unfold(spine.join(seen, "g", "left"), report, section, [result(
        "group_present", F.col("g"), verdict(F.col("_seen")), F.concat(F.lit("group "), F.col("g")))])


def freshness(log: DataFrame, tables: list[str], now: str, hours: float = 3) -> DataFrame:
    """Q11: age of the newest log row per table; a table without rows is an error."""
    last = log.groupBy(F.col("table_name").alias("t")).agg(F.max("ran_at").alias("at"))
    spine = log.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in tables])).alias("t"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))) / 3600.0
    return unfold(spine.join(last, "t", "left").withColumn("age", F.round(age, 1)), "Freshness", "sync_freshness", [result(
        "age", F.col("t"), verdict(F.col("age") <= hours, ERROR),
        F.coalesce(F.concat("t", F.lit(": last sync "), F.col("age").cast("string"), F.lit("h ago")), F.concat(F.lit("no log row for "), "t")),
        F.lit(hours), F.col("age"))])


def cross_source(left: DataFrame, right: DataFrame, section: str, value: str | None = None, tolerance: float = 0.005) -> DataFrame:
    """Q12: row counts, and a sum, of two sources within a tolerance."""
    def totals(df: DataFrame, p: str) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias(f"{p}_rows")]
        if value:
            aggs.append(F.sum(value).cast("decimal(28,4)").alias(f"{p}_sum"))
        return df.agg(*aggs)
    from ledgerlight.plans.scoreboards import one_row
    both = one_row(left.sparkSession, totals(left, "a"), totals(right, "b"))
    checks = [equal("rows", F.lit("Grand Total"), F.col("a_rows"), F.col("b_rows"), tolerance)]
    if value:
        checks.append(equal(f"sum_{value}", F.lit("Grand Total"), F.col("a_sum"), F.col("b_sum"), tolerance))
    return unfold(both, "Sync", section, checks)


def per_agent(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 0.01, least: float = 0.95,
              k: int = 20, ignore_below: float = 1.0) -> DataFrame:
    """Q13: agents compared on both sides: a summary (95% must match) and the k largest mismatches."""
    pairs = compare.reconcile(left, right, key, value, tolerance, ignore_below)
    total = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if("matches").alias("ok"))
    share = F.when(F.col("n") > 0, F.col("ok") / F.col("n")).otherwise(1.0)
    summary = unfold(total, "Sync", "per_agent", [result(
        f"{value}_summary", F.lit("All agents"), verdict(share >= least),
        F.concat(F.col("ok").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" agents match")), F.col("n"), F.col("ok"))])
    gap = F.abs("diff")
    worst = pairs.where(~F.col("matches")).orderBy(F.desc(gap), key).limit(k)
    rows = unfold(worst, "Sync", "per_agent", [result(
        f"{value}_mismatch", F.col(key), F.lit(WARN), F.lit("sources differ"), F.round("expected", 2), F.round("actual", 2), gap,
        compare.pct_diff(F.col("expected"), F.col("actual")))])
    return summary.unionByName(rows)


def stack(results: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), results)


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s.lower()) for s in SEVERITY]


def score(results: DataFrame) -> DataFrame:
    """Q14: share of passed among passed, failed and broken checks in percent; warnings only inform."""
    c = results.agg(F.count(F.lit(1)).alias("total"), *_counts())
    judged = F.col("pass") + F.col("fail") + F.col("error")
    return c.withColumn("score", F.when(judged > 0, F.round(F.col("pass") / judged * 100, 2)).otherwise(100.0))


def sections(results: DataFrame) -> DataFrame:
    """Q14: roll-up by report and section with the worst status."""
    c = results.groupBy("report", "section").agg(F.count(F.lit(1)).alias("total"), *_counts())
    worst = F.when(F.col("error") > 0, ERROR).when(F.col("fail") > 0, FAIL).when(F.col("warn") > 0, WARN).otherwise(PASS)
    return (c.withColumn("score", F.round(F.col("pass") / F.col("total") * 100, 1)).withColumn("status", worst)
            .orderBy("report", "section"))


def keep_history(history: DataFrame, results: DataFrame, day: str) -> DataFrame:
    """Q15: the day's score, replacing an earlier one of the same day."""
    today = score(results).withColumn("day", F.lit(day).cast("date")).select(*history.columns)
    both = history.withColumn("_run", F.lit(0)).unionByName(today.withColumn("_run", F.lit(1)))
    return merge.keyed.newest(both, ["day"], ["_run"]).drop("_run")


def trend(history: DataFrame) -> DataFrame:
    """Score by day with the change since the run before; one row per day of history."""
    w = F.lag("score").over(merge.keyed.Window.orderBy("day"))
    return history.withColumn("change", F.round(F.col("score") - w, 2)).orderBy("day")


def duplicate_logins(bridge: DataFrame) -> DataFrame:
    """Q16: logins on more than one live bridge row."""
    live = bridge.where("(deleted = 0 OR deleted IS NULL) AND account_id IS NOT NULL")
    return (live.groupBy(F.expr("try_cast(login AS bigint)").alias("login")).agg(F.count(F.lit(1)).alias("rows"))
            .where("rows > 1 AND login IS NOT NULL"))


def snapshot_consistency(equity: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Q17: floating of a day less its change must give the floating of the day before."""
    usd = "decimal(28,4)"
    days = equity.groupBy(F.to_date("at").alias("day")).agg(
        F.sum("floating").cast(usd).alias("floating"), F.sum("delta_floating").cast(usd).alias("delta"))
    before = days.select(F.date_add("day", 1).alias("day"), F.col("floating").alias("prev_floating"))
    implied = (F.col("floating") - F.col("delta")).cast(usd)
    gap = F.abs(implied - F.coalesce("prev_floating", F.lit(0))).cast(usd)
    return (days.join(before, "day", "left").withColumn("implied_prev", implied).withColumn("gap", gap)
            .withColumn("consistent", gap <= tolerance).orderBy("day"))


# ---- checks of the reports ---------------------------------------------------------------------------------


def check_sales(rows: DataFrame) -> DataFrame:
    """Invariants of the sales scoreboard, all in one pass."""
    who = F.col("agent_name")
    return unfold(rows, "Performance", "Sales", [
        labelled("agent_label", who, F.col("agent_name")), labelled("office_label", who, F.col("office_name")),
        not_negative("ftc", who, F.col("ftc")), not_negative("ftd_count", who, F.col("ftd_count")),
        at_most("daily_ftd_within_range", who, F.col("daily_ftd"), F.col("ftd_count")),
        at_most("daily_ftc_within_range", who, F.col("daily_ftc"), F.col("ftc")),
        at_most("ftd100_up_to_ftc", who, F.col("ftd100"), F.col("ftc"), WARN)])


def check_retention(rows: DataFrame) -> DataFrame:
    who = F.col("agent_name")
    return unfold(rows, "Performance", "Retention", [
        at_most("net_up_to_deposit", who, F.col("net_usd"), F.col("deposit_usd")),
        not_negative("open_volume", who, F.col("open_volume_usd")), not_negative("traders", who, F.col("traders_count"))])


def check_sales_bonus(rows: DataFrame) -> DataFrame:
    """Q8: bonus rows against the formula recomputed from their own inputs."""
    who, n, t = F.col("agent_name"), F.col("ftd100_count"), F.col("target_ftc")
    qualified = n >= 0.5 * t
    basic = F.when(qualified, (F.col("ftd100_full_count") + F.col("ftd100_half_count") * 0.5) * F.col("multiplier")).otherwise(0.0)
    return unfold(rows, "Agent Bonuses", "Sales", [
        equal("basic_bonus", who, basic, F.col("basic_bonus"), 0.0001),
        equal("total", who, F.col("basic_bonus") + F.col("sales_target_bonus") + F.col("ftd_amount_bonus"), F.col("total_sales_bonus"), 0.0001),
        equal("full_and_half", who, n, F.col("ftd100_full_count") + F.col("ftd100_half_count")),
        result("qualify_rule", who, verdict(qualified | (F.col("total_sales_bonus") == 0)), F.lit("no bonus below half of the target"))])


def check_aging(rows: DataFrame) -> DataFrame:
    who = F.col("g1")
    return unfold(rows, "Aging", "Groups", [
        at_most("rdp_up_to_ftc", who, F.col("rdp"), F.col("ftc")), at_most("traders_up_to_ftc", who, F.col("traders"), F.col("ftc")),
        equal("net", who, F.col("deposit") - F.col("withdrawal"), F.col("net_deposit"), 0.001),
        result("pct_range", who, verdict(F.col("pct_std").between(0, 100) & F.col("traders_pct").between(0, 100)), F.lit("percentages within 0 and 100"))])


def check_totals(rows: DataFrame, totals: DataFrame, condition: Column, least: int, share: float = 0.8) -> DataFrame:
    """Q3, Q7 on the whole scoreboard, and Q6, Q10: its sums against grand totals of another report, one row each.

    All come from one aggregate, so the scoreboard is computed once for them.
    """
    from ledgerlight.plans.scoreboards import one_row
    parts = rows.agg(F.sum("ftc").alias("p_ftc"), F.sum("ftd_count").alias("p_ftd"), row_count(), share_of(condition))
    both = one_row(rows.sparkSession, parts, totals.select("grand_ftc", "grand_ftd"))
    sums = [at_most("agents_up_to_grand_ftc", F.lit("Grand Total"), F.col("p_ftc"), F.col("grand_ftc")),
            at_most("agents_up_to_grand_ftd", F.lit("Grand Total"), F.col("p_ftd"), F.col("grand_ftd"))]
    named = [("Sales", r) for r in (enough_rows(least), covered(share))] + [("Totals", r) for r in sums]
    return (both.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), r.alias("r")) for s, r in named])).alias("one"))
            .select(F.lit("Performance").alias("report"), "one.section", "one.r.*").select(*COLUMNS))


def office_totals(rows: DataFrame, value: str) -> DataFrame:
    """Totals by office."""
    return rows.groupBy("office_name").agg(F.count(F.lit(1)).alias("agents"), F.sum(value).alias(value))
