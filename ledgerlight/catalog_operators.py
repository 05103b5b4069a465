"""Registered queries of the single operators: pulls, merge rules, filters, projections, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.catalog import FIRST, LAST, LIVE, Domain, query
from ledgerlight.functions import buckets as b, calendar as cal, clean, money as m, tiers
from ledgerlight.operators import filters, keyed, merge
from ledgerlight.plans import bonuses, campaigns, equity, jobs, regulatory, scoreboards as sb, traders, views
from ledgerlight.sources import feeds

USD = "decimal(28,4)"

# ---- sources ---------------------------------------------------------------------------------------------


def _accounts(d: Domain, **bounds):
    return feeds.accounts(d.raw_users, d.raw_user_info, d.raw_user_totals, d.raw_apps, **bounds)


@query
def S1_accounts_incremental(d: Domain):
    return _accounts(d, cutoff=LIVE)


@query
def S2_accounts_full(d: Domain):
    return _accounts(d)


@query
def S3_accounts_qualified_since(d: Domain):
    return _accounts(d, qualified_since=LIVE)


@query
def S4_accounts_created_since(d: Domain):
    return _accounts(d, created_since=LIVE)


def _payments(d: Domain, **bounds):
    return feeds.payments(d.raw_payments, d.raw_platform_accounts, d.raw_lookups, **bounds)


@query
def S5_payments_incremental(d: Domain):
    return _payments(d, cutoff=LIVE)


@query
def S6_payments_full(d: Domain):
    return _payments(d)


@query
def S7_payments_confirmed_since(d: Domain):
    return _payments(d, confirmed_since=LIVE)


@query
def F14_rejected_payments(d: Domain):
    """Payments that a cap of 1,000 keeps out; with the feed's own cap the test tables have none."""
    return _payments(d, cap=1000, rejected=True)


@query
def S8_agents(d: Domain):
    return feeds.agents(d.raw_operators, d.raw_operator_desks, d.raw_desks, d.raw_offices, d.raw_roles)


@query
def S9_directory_agents(d: Domain):
    return feeds.directory_agents(d.agents.withColumnRenamed("full_name", "user_name").drop("agent_name", "desk", "desk_name", "dept", "office_name"))


@query
def S10_trading_accounts(d: Domain):
    return feeds.trading_accounts(d.raw_platform_accounts, d.raw_users)


@query
def S11_campaigns(d: Domain):
    return feeds.campaign_rows(d.raw_campaigns, d.raw_lookups)


@query
def S12_operator_names(d: Domain):
    return feeds.operator_names(d.raw_operators)


@query
def S13_targets(d: Domain):
    return feeds.target_rows(d.targets)


@query
def S13_classification(d: Domain):
    return feeds.classification(d.accounts.withColumnRenamed("potential", "classification"))


@query
def S14_test_account_override(d: Domain):
    """M2: accounts another source marks as test are test here, whatever this source says."""
    marked = feeds.test_ids(d.raw_users)
    clean_rows = d.accounts.select("account_id", "country", F.lit(0).alias("is_test"))
    return merge.override_flag(clean_rows, marked, "account_id", "is_test")


@query
def S15_label_tables(d: Domain):
    return feeds.label_table(d.accounts.select(F.lower("country").alias("country"), F.concat(F.lit(" Land "), "country").alias("name")),
                             "country", "name")


@query
def S16_bonus_ledger(d: Domain):
    return feeds.bonus_ledger(d.money)


@query
def S17_type_names(d: Domain):
    return feeds.type_names(d.money, d.bonuses)


@query
def S18_deals_after_ticket(d: Domain):
    return feeds.after_key(d.deals, ["ticket"], [60]).select("ticket", "source", "login", "notional")


@query
def S19_platform_users_since(d: Domain):
    """Rows newer than the newest one stored, less a margin; the bonus ledger stands for the stored copy."""
    stored = d.bonuses.where("locked").select(F.col("confirmed").alias("updated"))
    return feeds.since_high_water(d.platform_users, stored, "updated", "1 day").select("login", "source", "balance", "credit")


@query
def S20_trades(d: Domain):
    return feeds.trades(d.deals, "open_time", "1996-01-01").select("ticket", "source", "login", "symbol", "notional")


@query
def S21_daily_rows_range(d: Domain):
    return feeds.day_range(d.equity, "at", "1998-12-20", LIVE).select("login", "source", F.to_date("at").alias("day"), "balance")


@query
def S21_daily_rows_resume(d: Domain):
    """Resume after a (time, login, source) key compared as a row value."""
    return feeds.after_key(d.equity, ["at", "login", "source"], ["1998-12-25 00:00:00", 10, "S0"]).select("login", "source", "balance", "floating")


@query
def S22_deals_utc(d: Domain):
    return feeds.deals_utc(d.deals, "1995-01-01").select("ticket", "source", "open_time", "close_time")


@query
def S23_open_positions(d: Domain):
    return feeds.open_trades(d.positions).select("position_id", "login", "symbol", "notional")


@query
def S24_live_figures(d: Domain):
    return feeds.live_figures(equity.bridge_logins(d.bridge, d.accounts), d.platform_users, d.positions, d.deals, LIVE)


@query
def S25_newest_per_login(d: Domain):
    return feeds.newest_per_login(d.deals, "open_time").select("login", "ticket", "open_time", "notional")


# ---- merge rules -----------------------------------------------------------------------------------------


def _base(d: Domain):
    """Accounts created up to a date, and two thirds of those without one."""
    return d.accounts.where("created < '1998-06-01' OR (created IS NULL AND account_id % 3 < 2)").select("account_id", "is_test", "score", "country", "funded",
                                                             (F.col("pep") == 1).alias("locked"))


def _delta(d: Domain):
    """Accounts created from a date on, and two thirds of those without one, of which half are in the base."""
    return d.accounts.where("created >= '1997-01-01' OR (created IS NULL AND account_id % 3 > 0)").select(
        "account_id", F.lit(0).alias("is_test"), F.when(F.col("score") > 6, F.col("score")).alias("score"),
        F.concat("country", F.lit("*")).alias("country"), (1 - F.col("funded")).alias("funded"), F.lit(False).alias("locked"))


@query
def M1_M3_M4_M5_merge(d: Domain):
    """Keyed merge: last writer wins, sticky maximum, keep if new is missing, guarded by a flag of the stored row."""
    rules = {"is_test": merge.GREATEST, "score": merge.KEEP_IF_NULL, "funded": merge.guarded("locked"), "locked": merge.GREATEST}
    return merge.merge_by_key(_base(d), _delta(d), ["account_id"], ["account_id"], rules)


@query
def M6_insert_missing(d: Domain):
    return merge.insert_missing(_base(d), _delta(d), ["account_id"])


@query
def M7_last_per_key(d: Domain):
    return merge.last_per_key(d.deals, ["source", "ticket"], ["sync_time", "notional", "login"]).select("source", "ticket", "notional")


@query
def M10_snapshot_sync(d: Domain):
    return merge.sync_snapshot(d.positions, ["position_id"], ["last_update", "notional", "login"]).select("position_id", "notional")


@query
def M11_clean_values(d: Domain):
    raw = d.accounts.select("account_id", F.when(F.col("score").isNull(), "").otherwise(F.concat("affiliate", F.lit("\x00"))).alias("affiliate"),
                            F.concat(F.lit(" "), F.col("score").cast("string"), F.lit(".0 ")).alias("score"),
                            F.when(F.col("funded") == 0, F.lit(float("nan"))).otherwise(F.col("account_id") / 4).alias("ratio"))
    return raw.select("account_id", clean.text(F.col("affiliate"), 6).alias("affiliate"), clean.whole_number(F.col("score")).alias("score"),
                      clean.finite(F.col("ratio")).alias("ratio"))


@query
def M12_reject_absurd(d: Domain):
    kept, _ = jobs.drop_corrupt(d.equity)
    return kept.groupBy("login").agg(F.count(F.lit(1)).alias("rows"), F.sum("floating").cast(USD).alias("floating"))


@query
def M13_override_values(d: Domain):
    """Configured values per id win over merged ones; the department history stands for the configuration."""
    config = d.dept_history.where("valid_to IS NULL").select("agent_id", F.col("report_dept").alias("dept"))
    return merge.override_values(d.agents.select("agent_id", "dept", "office"), config, ["agent_id"])


@query
def M14_drop_null_keys(d: Domain):
    return merge.drop_null_keys(d.money.select(F.col("owner").alias("agent_id"), "money_id"), ["agent_id"])


@query
def M18_shift_stored(d: Domain):
    return d.deals.select("ticket", "notional", "login", clean.shift_stored(F.col("close_time"), "EET", "1971-01-01").alias("close_time"))


# ---- filters ---------------------------------------------------------------------------------------------


@query
def F1_valid_money(d: Domain):
    return d.money.where(m.valid_money()).select("money_id", "account_id", "type", "usd")


@query
def F2_F3_agent_exclusions(d: Domain):
    return d.agents.select("agent_id", m.countable_agent().alias("countable"), m.not_test_agent().alias("not_test"),
                           m.not_department().alias("in_department"), views.department_group().alias("dept_group"))


@query
def F4_bonus_comments(d: Domain):
    return d.money.groupBy(m.not_bonus_comment().alias("plain")).agg(F.count(F.lit(1)).alias("rows"), F.sum("usd").cast(USD).alias("usd"))


@query
def F5_real_accounts(d: Domain):
    return d.accounts.where(m.live_account()).select("account_id", "country")


@query
def F6_date_range(d: Domain):
    return d.money.where(m.between_days("confirmed", "1996-02-01", "1999-02-28")).groupBy("type").agg(F.count(F.lit(1)).alias("rows"))


@query
def F7_two_axis_measures(d: Domain):
    return sb.kpi_measures(d.kpis, "1997-01-01", "1998-06-15")


@query
def F8_score_bands(d: Domain):
    return d.accounts.where(b.score_filter(F.col("score"), ["high", "none"])).groupBy("score").agg(F.count(F.lit(1)).alias("rows"))


@query
def F9_aging_filter(d: Domain):
    return d.accounts.where(b.aging_filter(F.col("qualified"), LIVE, ["8 - 14 days", "61 - 90 days", "120+ days"])).select("account_id")


@query
def F11_role_access(d: Domain):
    return d.agents.where(filters.access("retention_sa", ["sales_gmt", "nobody"])).select("agent_id", "dept", "office")


@query
def F12_trade_symbols(d: Domain):
    return (d.deals.where((F.col("cmd") < 2) & m.trade_symbol()).groupBy("symbol", "cmd")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("notional").cast(USD).alias("notional")))


@query
def F13_floor_date(d: Domain):
    return views.volume_stats(d.deals, d.positions, d.bridge, d.accounts, d.agents, floor_day="1998-01-01")


@query
def F15_dynamic_groups(d: Domain):
    """Clients by each whitelisted group of the campaign report, in one pass over the accounts."""
    names = tuple(campaigns.dimensions(LIVE))
    rows = campaigns.Dims(d.accounts, d.campaigns, d.agents, LIVE, names).prepared()
    each = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(f"g{i + 1}").alias("label")) for i, n in enumerate(names)])
    return rows.select(F.inline(each)).groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("clients"))


@query
def F16_active_clients(d: Domain):
    active = F.col("compliance").isin(*regulatory.ACTIVE)
    return d.accounts.groupBy("country").agg(F.count_if(active).alias("active"), F.count_if(~active).alias("inactive"))


# ---- projections -----------------------------------------------------------------------------------------


@query
def P1_signed_amount(d: Domain):
    return d.money.select("money_id", m.signed_usd().alias("signed"), m.money_in().alias("paid_in"), m.money_out().alias("paid_out"))


@query
def P2_transaction_types(d: Domain):
    """Every branch of the rule table over payments with their platform comments."""
    return jobs.typed_money(d.raw_money.withColumn("type", F.lit(None).cast("string")), d.balance_ops).select("money_id", "type")


@query
def M19_retyping_changed(d: Domain):
    """Only changed rows are typed again; the others keep their type."""
    rows = d.raw_money.withColumn("type", F.lit("kept"))
    return (jobs.typed_money(rows, d.balance_ops, only=F.col("created") >= F.lit("2022-12-01").cast("timestamp_ntz"))
            .groupBy("type").agg(F.count(F.lit(1)).alias("rows")))


@query
def P5_office_and_group(d: Domain):
    return (d.agents.select(F.col("agent_id").cast("string").alias("id"), m.office_name(F.col("office")).alias("label"))
            .unionByName(d.campaigns.select(F.concat(F.lit("c"), "campaign_id").alias("id"), m.marketing_group(F.col("channel")).alias("label"))))


@query
def P8_score_text(d: Domain):
    return d.accounts.select("account_id", clean.score_1_to_10(F.col("potential")).alias("truncated"),
                             clean.score_1_to_10(F.col("potential"), rounding=True).alias("rounded"))


@query
def P9_score_or_age(d: Domain):
    return d.accounts.select("account_id", b.score_or_age(F.col("score"), F.col("birth_date"), LIVE).alias("score"))


@query
def P10_score_backfill(d: Domain):
    return jobs.backfill_scores(d.accounts, LIVE).select("account_id", "score")


@query
def P11_P15_labels(d: Domain):
    score, birth = F.col("score"), F.col("birth_date")
    return d.accounts.select(
        "account_id", b.segment_label(F.col("segment"), score, birth, LIVE).alias("segment"), b.score_band(score).alias("band"),
        b.aging_bucket(F.col("qualified"), LIVE).alias("aging"), b.aging_sort(F.col("qualified"), LIVE).alias("aging_sort"),
        b.age_group(birth, LIVE).alias("age_group"), b.age_sort(birth, LIVE).alias("age_sort"),
        b.quality_label(score, birth, LIVE).alias("quality"), b.age_years(birth, LIVE).alias("age"))


@query
def P16_countries(d: Domain):
    shown = regulatory.country()
    kind = F.when(shown.isin(*regulatory.EU), "European Union").when(shown.isin(*regulatory.OTHER_FOREIGN), "Other Foreign")
    return d.accounts.groupBy(shown.alias("shown"), kind.alias("investor_type")).agg(F.count(F.lit(1)).alias("clients"))


@query
def P_bonus_tiers(d: Domain):
    """R14 / R15 tier tables and A11 over the money of every agent."""
    net = d.kpis.groupBy("agent_id").agg(F.sum("net_usd").cast(USD).alias("net"), F.sum("ftc_count").alias("n"))
    return net.select("agent_id", tiers.net_bonus_pct(F.col("net") * 10, F.lit("A")).alias("pct_a"), tiers.net_bonus_pct(F.col("net") * 10, F.lit("B")).alias("pct_b"),
                      tiers.volume_bonus_pct(F.col("net") / 3000, F.lit("A")).alias("volume_pct"), tiers.ftd100_multiplier(F.col("n")).alias("multiplier"),
                      tiers.target_bonus(F.col("n"), F.lit(6)).alias("target_bonus"), tiers.amount_bonus(F.col("net")).alias("amount_bonus"))


# ---- joins -----------------------------------------------------------------------------------------------


@query
def J3_login_accounts(d: Domain):
    return views.login_accounts(d.bridge, d.accounts).select("login", "account_id", "assigned_to")


@query
def J4_first_entry_volume(d: Domain):
    """Exit notional dated by the earliest entry of the position, each exit counted once."""
    return views.resolved_deals(d.deals, first_entry_only=True)


@query
def J6_semi_join(d: Domain):
    return d.money.join(d.accounts.where(regulatory.in_scope(7, funded=False)).select("account_id"), "account_id", "left_semi").select("money_id")


@query
def J7_null_aware_exclusion(d: Domain):
    return campaigns.with_live_agents(d.accounts, d.agents).select("account_id", "assigned_to")


@query
def J8_no_money(d: Domain):
    return d.accounts.join(d.money.where(m.valid_money()).select("account_id"), "account_id", "left_anti").select("account_id")


@query
def J9_as_of(d: Domain):
    return keyed.as_of(d.equity, ["login"], "at", "1998-12-31", ["source"]).select("login", "source", "balance", "floating")


@query
def J10_effective_dated(d: Domain):
    return keyed.overlapping(d.dept_history.where("report_dept = 'Retention'"), "agent_id", "1996-01-01", "1997-03-31")


@query
def J12_state_at_cutoff(d: Domain):
    ledger = d.money.where(m.valid_money()).select("account_id", "confirmed", "money_id", "owner", m.signed_usd().alias("amount"))
    return keyed.value_at_cutoff(ledger, d.accounts.where("qualified IS NOT NULL").select("account_id", "qualified"), ["account_id"], "confirmed",
                                 "qualified", "amount", ["confirmed", "money_id"], ["confirmed", "owner"])


@query
def J14_campaign_key(d: Domain):
    rows = d.accounts.withColumn("campaign_id", F.split_part("campaign", F.lit("."), F.lit(1)))
    return rows.join(d.campaigns, "campaign_id").groupBy("marketing_group").agg(F.count(F.lit(1)).alias("clients"))


@query
def J15_email_match(d: Domain):
    return jobs.match_agents(d.agents_master, d.agents).select("agent_name", "agent_id")


# ---- aggregates, windows, order --------------------------------------------------------------------------


@query
def A2_A3_distinct_counts(d: Domain):
    """Distinct first-time clients per agent, beside the sum of the distinct counts per cell (kept apart)."""
    cells = d.kpis.groupBy("agent_id").agg(F.sum("ftc_count").alias("sum_of_distinct"))
    real = d.accounts.where(m.real_account()).select("account_id")
    true = (views.money_by_account_day(d.money).where("ftd_count > 0").join(real, "account_id", "left_semi")
            .select(F.col("owner").alias("agent_id"), "account_id").distinct()
            .groupBy("agent_id").agg(F.count(F.lit(1)).alias("true_distinct")))
    return cells.join(true, "agent_id", "left").fillna(0, ["true_distinct"]).where("agent_id IS NOT NULL")


@query
def A5_average_scores(d: Domain):
    return sb.ftd_scores(d.money, d.accounts, FIRST, LAST, LIVE)


@query
def A8_net_by_period(d: Domain):
    return (d.kpis.groupBy(cal.period_start(F.col("tx_date"), "year").alias("year"), cal.period_start(F.col("tx_date"), "month").alias("month"))
            .agg(F.sum("net_usd").cast(USD).alias("net_usd"), F.sum("ftd_count").alias("ftd_count")))


@query
def A12_first_crossing(d: Domain):
    ledger = d.money.where(m.valid_money()).select("account_id", "confirmed", "money_id", m.signed_usd().alias("amount"))
    return keyed.first_crossing(ledger, ["account_id"], "confirmed", "money_id", "amount", 150)


@query
def A13_floored_total(d: Domain):
    return d.equity.groupBy("source").agg(m.usd_sum(F.greatest(F.col("equity"), m.zero())).alias("floored"), m.usd_sum(F.col("equity")).alias("plain"))


@query
def W1_running_total(d: Domain):
    ledger = d.money.where(m.valid_money()).select("account_id", "confirmed", "money_id", m.signed_usd().alias("amount"))
    return keyed.running_total(ledger, ["account_id"], "confirmed", "money_id", "amount").select("money_id", "running")


@query
def W3_newest_money(d: Domain):
    """The newest row per account."""
    return keyed.newest(d.money.where(m.valid_money()), ["account_id"], ["confirmed", "money_id"]).select("account_id", "money_id", "owner")


@query
def W4_first_ftd(d: Domain):
    return bonuses.first_ftd(d.money)


@query
def W5_newest_per_day(d: Domain):
    return jobs.equity_by_day(d.equity).select("login", "day", "source", "balance", "floating")


@query
def O3_top_payments(d: Domain):
    """The 25 largest payments by size, ties by id."""
    return d.money.where(m.valid_money()).orderBy(F.desc(F.abs("usd")), "money_id").limit(25).select("money_id", "usd")


@query
def U1_traded_notional(d: Domain):
    return views.traded_notional(d.deals, d.positions, None)


@query
def U5_common_logins(d: Domain):
    return d.equity.select("login").intersect(equity.bridge_logins(d.bridge, d.accounts))


# ---- jobs ------------------------------------------------------------------------------------------------


@query
def D5_target_backfill(d: Domain):
    return jobs.backfill_targets(d.agents_master, d.agents, None, "2000-06-15")


@query
def D6_month_append(d: Domain):
    history = jobs.backfill_targets(d.agents_master, d.agents, None, "2000-03-15")
    return jobs.append_month(d.agents_master, d.agents, history, "2000-06-15")


@query
def D7_unmatched_agents(d: Domain):
    return jobs.unmatched_agents(d.agents_master)


@query
def D7_match_counts(d: Domain):
    return jobs.match_counts(d.agents_master)


@query
def D8_open_holidays(d: Domain):
    """Payments on seeded holidays, by holiday."""
    return (d.money.select(F.to_date("confirmed").alias("holiday")).join(d.holidays, "holiday").groupBy("holiday", "description")
            .agg(F.count(F.lit(1)).alias("rows")))


@query
def D9_agent_scores(d: Domain):
    return jobs.agent_scores(d.targets, d.agents.where("agent_name IS NOT NULL"))


@query
def D11_members(d: Domain):
    members = d.agents_master.where("agent_id IS NOT NULL").select(
        "agent_id", F.lower(F.trim("email")).alias("email"), F.col("agent_name").alias("full_name"), F.lit("agent").alias("role"), F.lit(True).alias("is_active"))
    return jobs.new_members(members, d.agents).select("agent_id", "full_name", "role", "is_active")


@query
def I7_fresher_copy(d: Domain):
    """Remote balances while fresh enough, else the local copy; here the remote side is the older source."""
    remote, local = d.platform_users.where("source = 'S0'"), d.platform_users.where("source = 'S1'")
    return equity.pick_fresher(remote, local, "updated", "1999-01-10 00:00:00").select("login", "balance", "data_source")


@query
def R11_two_filters(d: Domain):
    """Trader totals of one office and one score band."""
    band, office = b.score_filter(F.col("score"), ["low"]), F.col("office") == "GMT"
    return traders.series_totals(traders.team_traders(d.traders, d.accounts, d.agents, FIRST, LAST, band, office),
                                 traders.team_money(d.money, d.accounts, d.agents, FIRST, LAST, band, office), LAST)
