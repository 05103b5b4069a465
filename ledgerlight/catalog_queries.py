"""The registered queries, grouped as in the operator inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.catalog import FIRST, LAST, LIVE, Domain, query
from ledgerlight.functions import buckets as b, calendar as cal, money as m
from ledgerlight.operators import compare, filters
from ledgerlight.plans import (aging, bonuses, campaigns, equity, jobs, quality, reconcile, regulatory, scoreboards as sb,
                               traders, views)

# ---- views -----------------------------------------------------------------------------------------------


@query
def V1_daily_kpis(d: Domain):
    return d.kpis


@query
def V2_volume_stats(d: Domain):
    return d.volume


@query
def V3_sales_bonuses(d: Domain):
    return views.sales_bonuses(d.clients)


@query
def V4_run_rate(d: Domain):
    return d.run_rate


@query
def V5_account_stats(d: Domain):
    return views.account_stats(d.accounts, LIVE)


@query
def V6_second_deposit_clients(d: Domain):
    return d.std


@query
def V7_retention_traders(d: Domain):
    return d.traders


@query
def V8_resolved_deals(d: Domain):
    return d.resolved


@query
def D1_threshold_clients(d: Domain):
    return d.clients


@query
def D3_equity_snapshots(d: Domain):
    return d.snapshots


# ---- scoreboards -----------------------------------------------------------------------------------------


@query
def R1_sales_scoreboard(d: Domain):
    return sb.sales_scoreboard(d.kpis, d.clients, sb.month_targets(d.targets, FIRST), d.agents, FIRST, LAST)


@query
def R1_sales_scoreboard_high_scores(d: Domain):
    band = b.score_filter(F.col("score"), ["high"])
    return sb.sales_scoreboard(
        sb.filtered_kpis(d.money, d.accounts, ["high"]), d.clients, sb.month_targets(d.targets, FIRST), d.agents,
        FIRST, LAST, ftd100=sb.ftd100_measures(d.clients, FIRST, LAST, d.accounts, band))


@query
def R1_scoreboard_totals(d: Domain):
    return sb.scoreboard_totals(d.kpis, d.volume, d.accounts, d.holidays, FIRST, LAST, "1995-01-20")


@query
def R1_restricted_totals(d: Domain):
    rows = sb.sales_scoreboard(d.kpis, d.clients, sb.month_targets(d.targets, FIRST), d.agents, FIRST, LAST,
                               access=filters.access("sales_gmt", ["sales_sa"]))
    return sb.restricted_totals(rows)


def _activity(d: Domain):
    return sb.trading_activity(d.range_volume, d.accounts, FIRST, LAST, LIVE)


@query
def R2_retention_scoreboard(d: Domain):
    return sb.retention_scoreboard(
        d.range_kpis, sb.month_targets(d.targets, FIRST), sb.activity_measures(_activity(d)), d.std,
        sb.rdp_by_agent(d.money, d.accounts, FIRST, LAST), d.agents, d.dept_history, FIRST, LAST)


@query
def R3_rdp_net(d: Domain):
    return sb.rdp_by_agent(d.money, d.accounts, FIRST, LAST)


@query
def R4_daily_monthly_sales(d: Domain):
    rows = sb.sales_scoreboard(
        d.kpis, d.clients, sb.month_targets(d.targets, FIRST), d.agents, FIRST, LAST, active_only=False,
        scores=sb.ftd_scores(d.money, d.accounts, FIRST, LAST, LIVE))
    return sb.company_gap(rows, d.company_targets, FIRST)


@query
def R5_daily_monthly_retention(d: Domain):
    return sb.retention_scoreboard(
        d.range_kpis, sb.month_targets(d.targets, FIRST), sb.activity_measures(_activity(d)), d.std,
        sb.rdp_by_agent(d.money, d.accounts, FIRST, LAST), d.agents, d.dept_history, FIRST, LAST,
        loads=sb.load_measures(sb.deposit_flags(d.money, d.accounts, FIRST, LAST)))


@query
def R5_global_counts(d: Domain):
    return sb.retention_globals(_activity(d), sb.deposit_flags(d.money, d.accounts, FIRST, LAST), d.agents)


@query
def R12_dashboard(d: Domain):
    return sb.dashboard(d.run_rate, d.volume, d.accounts, d.equity, d.bridge, d.holidays, LIVE)


@query
def R13_working_days(d: Domain):
    """Working days, days passed and the projection of net deposits for every month of the ledger."""
    months = (d.kpis.groupBy(F.trunc("tx_date", "month").alias("month"))
              .agg(F.sum("net_usd").cast("decimal(28,4)").alias("net_usd"), F.max("tx_date").alias("last_day")))
    off = d.holidays.where(F.weekday("holiday") < 5).agg(F.sort_array(F.collect_set("holiday"))).scalar()
    start, end = F.col("month"), F.last_day("month")

    def days(a, z):
        return cal.weekdays(a, z) - F.size(F.filter("off", lambda h: h.between(a, z)))

    return (months.withColumn("off", off).withColumn("working_days", days(start, end))
            .withColumn("passed", days(start, F.col("last_day"))).drop("off")
            .withColumn("net_rr", cal.run_rate(F.col("net_usd"), F.col("passed"), F.col("working_days"), 2)))


@query
def R18_ftc_net(d: Domain):
    return bonuses.ftc_net(d.money, d.accounts, FIRST, LAST).groupBy("agent_id").agg(
        F.sum("net_usd").cast("decimal(28,4)").alias("net_usd"))


@query
def R29_agent_scorecard(d: Domain):
    return sb.agent_scorecard(jobs.agent_scores(d.targets, d.agents), d.agents, FIRST,
                              access=filters.access("retention_gmt", ["sales_all"]))


@query
def R29_active_agents(d: Domain):
    return sb.agent_scorecard(jobs.agent_scores(d.targets, d.agents), d.agents, FIRST, active=True)


# ---- bonuses ---------------------------------------------------------------------------------------------


def _v3(d: Domain):
    return views.sales_bonuses(d.clients)


@query
def R14_retention_bonus(d: Domain):
    return bonuses.retention_bonus(d.kpis, d.volume, sb.month_targets(d.targets, FIRST), d.agents, FIRST, LAST)


def _sales_bonus(d: Domain, ordered: bool = True):
    return bonuses.sales_bonus(d.kpis, _v3(d), bonuses.ftc_net(d.money, d.accounts, FIRST, LAST),
                               sb.month_targets(d.targets, FIRST), d.agents, FIRST, LAST, offices=None, ordered=ordered)


@query
def R15_sales_bonus(d: Domain):
    return _sales_bonus(d)


@query
def R16_sales_bonus_accounts(d: Domain):
    return bonuses.sales_bonus_accounts(d.money, d.accounts, d.clients, _v3(d), sb.month_targets(d.targets, FIRST),
                                        d.agents, FIRST, LAST, offices=None)


def _ftcs(d: Domain):
    return bonuses.all_ftcs(d.money, d.accounts, d.clients, _v3(d), sb.month_targets(d.targets, FIRST), d.agents, FIRST, LAST)


@query
def R17_all_ftcs(d: Domain):
    return _ftcs(d)


@query
def F17_search_totals(d: Domain):
    return bonuses.kept_totals(filters.search(_ftcs(d), " NATION_1 ", ["account_id", "agent_name", "desk", "office_name"]))


# ---- campaigns, aging, traders ---------------------------------------------------------------------------

FLOOR = "1995-01-01"


@query
def R6_marketing_day(d: Domain):
    return campaigns.marketing_day(d.money, d.accounts, d.campaigns, d.agents, LIVE, "campaign_channel", "country", floor_day=FLOOR)


def _cards(d: Domain, chosen=None):
    return campaigns.campaign_cards(d.money, d.accounts, d.campaigns, d.agents, d.traders, FIRST, LAST, LIVE, chosen, floor_day=FLOOR)


@query
def R7_campaign_cards(d: Domain):
    return _cards(d)


@query
def R7_campaign_cards_filtered(d: Domain):
    return _cards(d, {"marketing_group": ["PPC", "Organic", "IB"], "quality": "High Quality",
                      "qualified": ("1995-06-01", "2001-05-31"), "affiliate": ["MACHINERY", "FURNITURE", "BUILDING"]})


def _table(d: Domain, groups, period=None, chosen=None):
    return campaigns.campaign_table(d.money, d.accounts, d.campaigns, d.agents, d.deals, d.positions, d.bridge, FIRST, LAST, LIVE,
                                    groups, period, chosen, floor_day=FLOOR)


@query
def R8_campaign_table(d: Domain):
    return campaigns.with_rates(_table(d, ("marketing_group", "segmentation")))


@query
def R8_campaign_table_qualified(d: Domain):
    """With a qualification filter, which takes the place of the report's range for FTC."""
    out = campaigns.campaign_table(d.money, d.accounts, d.campaigns, d.agents, d.deals, d.positions, d.bridge, "1998-01-01", "1998-06-30", LIVE,
                                   ("marketing_group",), None, {"qualified": ("1995-06-01", "2001-05-31")}, floor_day=FLOOR)
    return campaigns.with_rates(out)


@query
def R8_campaign_table_by_month(d: Domain):
    return campaigns.with_rates(_table(d, ("office_name",), "month"))


@query
def R8_campaign_totals(d: Domain):
    return campaigns.table_totals(_table(d, ("campaign_sub_channel", "client_classification"), "year",
                                         {"team": ["Desk 1", "Desk 2", "Desk 3"],
                                          "aging": ["31 - 60 days", "91 - 120 days", "120+ days"]}))


@query
def R9_filter_lists(d: Domain):
    return campaigns.filter_lists(d.accounts, d.campaigns, d.agents)


def _aging(d: Domain, groups, labels=None, chosen=None):
    traded = views.traded_notional(d.deals, d.positions, None)
    return aging.aging_report(d.money, d.accounts, d.agents, d.campaigns, d.std, aging.traded_accounts(traded, d.bridge),
                              LAST, groups, labels, chosen, floor_day=FLOOR)


@query
def R10_aging(d: Domain):
    return aging.with_grand_total(_aging(d, ("days_from_ftc",)))


@query
def R10_aging_two_groups(d: Domain):
    return aging.ordered(aging.with_rates(_aging(d, ("age_group", "segmentation"), chosen=b.score_filter(F.col("score"), ["high", "none"]))))


@query
def R10_aging_by_region(d: Domain):
    """Codes that share a label fall together before grouping."""
    regions = d.accounts.select("country").distinct().where("country IS NOT NULL").select(
        F.col("country").alias("code"), F.when(F.col("country").startswith("X1"), "Region one").otherwise("Region two").alias("label"))
    return aging.with_rates(_aging(d, ("region", "client_potential"), {"region": regions.where("code <> 'X23'")}))


def _paid(d: Domain):
    return traders.team_money(d.money, d.accounts, d.agents, FIRST, LAST)


def _traded(d: Domain):
    return traders.team_traders(d.traders, d.accounts, d.agents, FIRST, LAST)


@query
def R11_trader_series(d: Domain):
    return traders.daily_series(_traded(d), _paid(d), FIRST, LAST)


@query
def R11_trader_totals(d: Domain):
    return traders.series_totals(_traded(d), _paid(d), LAST)


@query
def R11_agent_matrix(d: Domain):
    return traders.agent_matrix(_traded(d), _paid(d), d.agents, LAST)


@query
def R30_quality_by_month(d: Domain):
    return traders.quality_by_month(_traded(d), _paid(d))


# ---- equity ----------------------------------------------------------------------------------------------


@query
def R19_eez_comparison(d: Domain):
    return equity.eez_comparison(d.snapshots, d.equity, d.bonuses, d.bridge, d.accounts)


@query
def R20_eez_month(d: Domain):
    return equity.eez_month(d.equity, d.bonuses, d.bridge, d.accounts, LIVE)


@query
def R21_historical_total(d: Domain):
    return equity.historical_total(d.equity, d.bonuses, d.bridge, d.accounts, d.snapshots, LIVE)


@query
def R21_historical_total_repeated_rows(d: Domain):
    return equity.historical_total(d.equity, d.bonuses, d.bridge, d.accounts, d.snapshots, LIVE, once=False)


@query
def R22_live_equity(d: Domain):
    return equity.live_equity(d.equity, d.bonuses, d.bridge, d.accounts, d.positions, d.deals, d.platform_users,
                              d.snapshots, d.kpis, LIVE)


@query
def R23_month_end_total(d: Domain):
    return equity.month_end_total(d.equity, d.bonuses, d.bridge, d.accounts, d.agents, LIVE)


def _bridge(d: Domain):
    rows = equity.per_login_live(d.equity, d.bonuses, d.bridge, d.accounts, d.positions, d.deals, d.platform_users,
                                 d.snapshots, LIVE, with_equity=False)
    return equity.pnl_bridge(equity.bridge_logins(d.bridge, d.accounts), rows,
                             equity.net_by_login(d.money, d.bridge, d.accounts, LIVE))


@query
def R31_pnl_bridge(d: Domain):
    return _bridge(d)


@query
def R31_bridge_summary(d: Domain):
    return equity.bridge_summary(_bridge(d))


@query
def R31_top_gaps(d: Domain):
    return equity.top_gaps(_bridge(d))


@query
def R32_cash_pnl_series(d: Domain):
    return equity.cash_pnl_series(d.equity, d.snapshots, d.kpis, d.bonuses, equity.bridge_logins(d.bridge, d.accounts, with_equity=True))


@query
def R32_signed_login_pnl(d: Domain):
    net = (d.balance_ops.where("cmd = 6").groupBy("login", F.to_date("close_time").alias("day"))
           .agg(F.sum("profit").cast("decimal(28,4)").alias("net_dep")))
    return equity.signed_login_pnl(d.equity, net)


@query
def R35_login_profile(d: Domain):
    return equity.login_profile(d.snapshots, d.platform_users, d.bonuses, d.money)


@query
def R36_snapshot_replay(d: Domain):
    """Stored snapshots against a recomputation that ignores negative bonus balances."""
    again = jobs.equity_snapshots(d.equity, d.bonuses, d.bridge, d.accounts, clamp_bonus=True)
    return equity.replay(d.snapshots, again)


@query
def A14_snapshot_statistics(d: Domain):
    return equity.snapshot_statistics(d.snapshots)


@query
def D4_snapshot_repair(d: Domain):
    return jobs.repair_snapshots(d.equity, d.bonuses, d.bridge, d.accounts, LIVE, days=28)


# ---- regulatory ------------------------------------------------------------------------------------------

YEAR, QUARTER, REP = 1999, 1, 7


@query
def R24_regulatory_clients(d: Domain):
    return regulatory.clients(d.accounts, d.snapshots, d.bridge, YEAR, QUARTER, REP)


@query
def R25_regulatory_countries(d: Domain):
    return regulatory.by_country(d.accounts, d.deals, d.positions, d.bridge, YEAR, QUARTER, REP)


@query
def R26_regulatory_equity(d: Domain):
    return regulatory.equity_ratio(d.equity, d.bridge, d.accounts, YEAR, QUARTER, REP)


@query
def R26_regulatory_equity_by_day(d: Domain):
    return regulatory.equity_ratio(d.equity, d.bridge, d.accounts, YEAR, QUARTER, REP, by_day=True)


@query
def R27_regulatory_income(d: Domain):
    return regulatory.income(d.money, d.deals, d.positions, d.equity, d.bridge, d.accounts, YEAR, QUARTER, REP, by_day=True)


@query
def R33_volume_per_login(d: Domain):
    return regulatory.volume_per_login(d.deals, d.bridge, d.accounts, FIRST, LAST, REP)


# ---- lists, status, reconciliation -----------------------------------------------------------------------


@query
def R28_transactions(d: Domain):
    return reconcile.transactions(d.money, d.accounts, FIRST, LAST)


@query
def R34_sync_status(d: Domain):
    return reconcile.sync_status(d.sync_log, "1999-01-16 00:00:00", 8)


@query
def O4_last_runs(d: Domain):
    return reconcile.last_runs(d.sync_log, 25)


@query
def R37_net_by_source(d: Domain):
    return reconcile.net_by_source(d.kpis, d.equity, d.balance_ops, ("Deposit Void", "Withdrawal Void", "FRF", "Cash ADVANCE"), 50)


@query
def R37_retention_net_by_source(d: Domain):
    ledger = reconcile.retention_net(d.money, d.accounts, d.agents)
    return reconcile.net_by_source(ledger, d.equity, d.balance_ops, ("Deposit Void", "Withdrawal Void", "FRF", "Cash ADVANCE"), 50)


@query
def R38_extra_logins(d: Domain):
    return reconcile.extra_logins(jobs.equity_by_day(d.equity), equity.bridge_logins(d.bridge, d.accounts, with_equity=True))


@query
def R39_daily_leads(d: Domain):
    return reconcile.daily_counts(d.accounts.where("created IS NOT NULL"), "created")


@query
def R39_daily_bonuses(d: Domain):
    return reconcile.daily_counts(d.bonuses, "confirmed", F.col("amount"))


@query
def A15_month_gaps(d: Domain):
    return reconcile.month_gaps(d.money.where("deleted = 0"), d.money, "confirmed")


@query
def D10_incomplete_months(d: Domain):
    return jobs.incomplete_months(d.money.where(m.approved()), d.money, "confirmed")


@query
def J20_key_diff(d: Domain):
    """Logins with equity rows against logins on the live bridge, both ways."""
    live = equity.bridge_logins(d.bridge, d.accounts)
    return compare.key_diff(d.equity.select("login"), live, ["login"])


@query
def Q16_missing_by_type(d: Domain):
    return reconcile.missing_by_type(d.money, d.money.where(m.not_bonus_comment()))


# ---- quality ---------------------------------------------------------------------------------------------


def _sales(d: Domain):
    return sb.sales_scoreboard(d.kpis, d.clients, sb.month_targets(d.targets, FIRST), d.agents, FIRST, LAST, ordered=False)


def _results(d: Domain):
    sales = _sales(d)
    return quality.stack([
        quality.check_sales(sales),
        quality.check_totals(sales, sb.kpi_totals(d.kpis, FIRST, LAST), F.col("target_ftc") > 0, 5),
        quality.check_sales_bonus(_sales_bonus(d, ordered=False)), quality.check_aging(aging.with_rates(_aging(d, ("days_from_ftc",)))),
        quality.expected_groups(_aging(d, ("days_from_ftc",)), "Aging", "Groups", "g1", [r[2] for r in b.AGING]),
        quality.freshness(d.sync_log, ["signup", "error", "purchase", "refund"], "1999-01-16 00:00:00", 8)])


@query
def Q2_Q10_check_results(d: Domain):
    return _results(d).drop("message", "expected", "actual")


@query
def Q14_sections(d: Domain):
    return quality.sections(_results(d))


@query
def Q14_score(d: Domain):
    return quality.score(_results(d))


@query
def Q12_cross_source(d: Domain):
    return quality.cross_source(d.money.where(m.valid_money()), d.money.where(m.valid_money() & m.not_bonus_comment()),
                                "payments", "usd", 0.05).drop("message", "expected", "actual")


@query
def Q13_per_agent(d: Domain):
    """Net by agent from the ledger against net by agent without bonus-commented rows."""
    left = d.kpis.groupBy("agent_id").agg(F.sum("net_usd").alias("net"))
    plain = views.daily_kpis(d.money, d.accounts, d.agents, bonus_comments=False)
    right = plain.groupBy("agent_id").agg(F.sum("net_usd").alias("net"))
    return quality.per_agent(left, right, "agent_id", "net").drop("expected", "actual")


@query
def Q16_duplicate_logins(d: Domain):
    return quality.duplicate_logins(d.bridge)


@query
def Q16_corrupt_rows(d: Domain):
    _, bad = jobs.drop_corrupt(d.equity)
    return bad.select(F.col("at").alias("stamp"), "login", "source", "floating", "balance")


@query
def Q17_snapshot_consistency(d: Domain):
    return quality.snapshot_consistency(d.equity)


@query
def A16_office_totals(d: Domain):
    return quality.office_totals(_sales(d), "net_deposits")
