"""Comparison SQL of the single operators."""

from __future__ import annotations

from oracle import sql_equity as eq, sql_reports as rp
from oracle.base import (COUNTABLE, DEP, FULL, LABEL, LAST, LIVE, LIVEACC, NET, NOBONUS, NODEPT, NOTEST, OK, VALID, WDR, age, out,
                         rng, score)

SQL: dict[str, str] = {}

# ---- sources -------------------------------------------------------------------------------------------------
TS = f"TIMESTAMP '{LIVE} 00:00:00'"


def athens(c: str) -> str:
    return f"(({c}) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens'"


BOUND = f"(({TS}) AT TIME ZONE 'Europe/Athens') AT TIME ZONE 'UTC'"
CHOICE = """CASE WHEN u.acquisition = 0 AND u.sales_rep <> 0 THEN u.sales_rep WHEN u.acquisition = 0 AND u.sales_rep = 0 THEN u.sales_desk
    WHEN u.acquisition = 1 AND u.retention_rep <> 0 THEN u.retention_rep ELSE u.retention_desk END"""


def truncated(c: str) -> str:
    t = f"CAST(TRUNC(TRY_CAST(TRIM({c}) AS DECIMAL(20, 6))) AS INTEGER)"
    return f"CASE WHEN {t} BETWEEN 1 AND 10 THEN {t} END"


def source_accounts(where: str = "TRUE") -> str:
    return out(f"""
        SELECT u.user_id AS account_id, u.is_test, u.is_demo, u.country, CASE u.gender WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE CAST(u.gender AS STRING) END AS gender,
               i.tracking_campaign AS campaign, CASE WHEN u.acquisition = 0 THEN 'Sales' ELSE 'Retention' END AS account_status, {CHOICE} AS assigned_to,
               u.sales_rep, {athens('u.creation_time')} AS created, {athens('i.qualification_time')} AS qualified,
               CASE WHEN u.date_of_birth < DATE '1900-01-01' THEN NULL ELSE u.date_of_birth END AS birth_date, COALESCE(i.customer_ref, u.user_id) AS customer_id,
               UPPER(p.app_name) AS regulation, t.balance, t.net_deposit, i.potential, {truncated('i.potential')} AS score
        FROM raw_users u LEFT JOIN raw_user_info i ON i.user_id = u.user_id LEFT JOIN raw_user_totals t ON t.user_id = u.user_id AND t.latest <> 0
        LEFT JOIN raw_apps p ON p.app_id = u.app_id WHERE {where}""", "created qualified birth_date", "balance net_deposit", "is_test is_demo score")


SQL["S1_accounts_incremental"] = source_accounts(f"i.last_contact >= {TS} OR u.updated >= {TS} OR u.creation_time >= {TS}")
SQL["S2_accounts_full"] = source_accounts()
SQL["S3_accounts_qualified_since"] = source_accounts(f"i.qualification_time >= {BOUND}")
SQL["S4_accounts_created_since"] = source_accounts(f"u.creation_time >= {BOUND}")


def source_payments(where: str = "TRUE", kept: str = "usd < 10000000") -> str:
    return out(f"""
        SELECT * FROM (
            SELECT p.payment_id AS money_id, p.user_id AS account_id, b.external_id AS login, CASE WHEN s.value = 'Success' THEN 'Approved' ELSE s.value END AS approval,
                   y.value AS raw_type, e.value AS method, CASE WHEN p.acquisition = 1 OR p.sales_rep = 0 THEN p.retention_rep
                   WHEN p.acquisition = 0 OR p.sales_rep <> 0 THEN p.sales_rep END AS owner, p.is_ftd AS ftd, CAST(p.amount_cents AS DECIMAL(20, 2)) / 100 AS usd,
                   {athens('p.decision_time')} AS confirmed, {athens('p.creation_time')} AS created, p.updated AS modified
            FROM raw_payments p JOIN raw_platform_accounts b ON b.platform_account_id = p.platform_account_id AND b.is_demo = 0
            LEFT JOIN raw_lookups e ON e.kind = 'method' AND e.key = p.method_key LEFT JOIN raw_lookups s ON s.kind = 'status' AND s.key = p.status_key
            LEFT JOIN raw_lookups y ON y.kind = 'type' AND y.key = p.type_key WHERE {where}) x WHERE {kept}""", "confirmed created modified", "usd")


SQL["S5_payments_incremental"] = source_payments(f"p.updated >= {TS} OR p.decision_time >= {TS}")
SQL["S6_payments_full"] = source_payments()
SQL["F14_rejected_payments"] = source_payments(kept="usd >= 1000 OR usd IS NULL")
SQL["S7_payments_confirmed_since"] = source_payments(f"p.decision_time >= {BOUND}")
OFFICES = (("IN", "India"), ("UY", "Uruguay"), ("SA", "South Africa"), ("LAG-NG", "LAG Nigeria"), ("IL", "Israel"), ("GMT", "GMT"), ("General", "General"),
           ("Global", "General"), ("DU", "Dubai"), ("CO", "Columbia"), ("CY", "Cyprus"), ("BG", "Bulgaria"), ("ABJ-NG", "ABJ Nigeria"), ("VN", "Vietnam"))


def office(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR TRIM({c}) = '' THEN 'General' " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in OFFICES) + f" ELSE {c} END"


def piece(c: str, i: int) -> str:
    return {1: f"TRIM(SPLIT_PART({c}, '-', 1))", 2: f"SPLIT_PART({c}, '-', 2)", -1: f"TRIM(SPLIT_PART({c}, '-', -1))"}[i]


SELLS = "(r.role_name IS NULL OR r.role_name LIKE '%Agent%' OR r.role_name = 'BDM')"
DEPT = "CASE WHEN LOWER(TRIM(SPLIT_PART(d.desk_name, '-', 1))) LIKE '%conversion%' THEN 'Sales' ELSE 'Retention' END"
NAMED = "REPLACE(o.full_name, '.', ' ')"
SQL["S8_agents"] = out(f"""
    SELECT o.operator_id AS agent_id, MAX(o.full_name) AS full_name, MAX(o.full_name) AS agent_name, MAX(CASE WHEN o.is_active = 1 THEN 'Active' ELSE 'Inactive' END) AS status,
           MAX(SPLIT_PART({NAMED}, ' ', 1)) AS first_name, MAX(SPLIT_PART({NAMED}, ' ', -1)) AS last_name, MAX(d.desk_name) AS desk_name,
           MAX(CASE WHEN {SELLS} THEN {piece('d.desk_name', 1)} ELSE '' END) AS team, MAX(CASE WHEN {SELLS} THEN {piece('d.desk_name', -1)} ELSE '' END) AS department,
           MAX({piece('d.desk_name', 2)}) AS desk, MAX(CASE WHEN {SELLS} THEN f.office ELSE 'General' END) AS office, MAX({office('f.office')}) AS office_name, MAX({DEPT}) AS dept
    FROM raw_operators o LEFT JOIN raw_operator_desks od ON od.operator_id = o.operator_id LEFT JOIN raw_desks d ON d.desk_id = od.desk_id
    LEFT JOIN raw_offices f ON f.office_id = d.office_id LEFT JOIN raw_roles r ON r.role_id = o.role_id
    WHERE r.role_name IS NULL OR (r.role_name NOT IN ('Affiliate', 'Dialer') AND r.role_name NOT LIKE '%Admin') GROUP BY 1
    UNION SELECT d.desk_id, d.desk_name, d.desk_name, 'Active', NULL, NULL, d.desk_name, {piece('d.desk_name', 1)}, {piece('d.desk_name', -1)}, {piece('d.desk_name', 2)},
                 f.office, {office('f.office')}, {DEPT} FROM raw_desks d LEFT JOIN raw_offices f ON f.office_id = d.office_id""")
SQL["S9_directory_agents"] = out(f"""
    SELECT agent_id, full_name, full_name AS agent_name, email, status, department, department AS desk, department AS desk_name, team, office, {office('office')} AS office_name,
           CASE WHEN LOWER(COALESCE(team, '')) LIKE '%conversion%' THEN 'Sales' ELSE 'Retention' END AS dept FROM agents""")
SQL["S10_trading_accounts"] = out(f"""
    SELECT b.platform_account_id AS bridge_id, b.user_id AS account_id, b.external_id AS login, CAST(b.equity_cents AS DECIMAL(20, 2)) / 100 AS equity,
           CAST(b.balance_cents AS DECIMAL(20, 2)) / 100 AS balance, CASE WHEN b.is_demo = 1 THEN 1 ELSE 2 END AS server_id, {CHOICE} AS assigned_to,
           b.is_deleted AS deleted, b.updated AS last_update
    FROM raw_platform_accounts b LEFT JOIN raw_users u ON u.user_id = b.user_id""", "last_update", "equity balance", "assigned_to")
SQL["S11_campaigns"] = out("""
    SELECT c.campaign_id, c.name, l1.value AS channel, l2.value AS sub_channel, CASE WHEN c.is_deleted = 0 THEN 1 ELSE 0 END AS active,
           CASE WHEN l1.value LIKE '%IB%' THEN 'IB' WHEN l1.value LIKE '%PPC%' THEN 'PPC' WHEN l1.value LIKE '%Direct%' THEN 'Organic' ELSE 'Other' END AS marketing_group
    FROM raw_campaigns c LEFT JOIN raw_lookups l1 ON l1.kind = 'channel' AND l1.key = c.channel_key
    LEFT JOIN raw_lookups l2 ON l2.kind = 'sub_channel' AND l2.key = c.sub_channel_key WHERE c.external_id IS NOT NULL""")
SQL["S12_operator_names"] = out("SELECT operator_id AS agent_id, full_name FROM raw_operators")
SQL["S13_targets"] = out("SELECT month, agent_id, ftc, net FROM targets", "month", "ftc net")
SQL["S13_classification"] = out(f"""
    SELECT account_id, s AS score, CASE WHEN s BETWEEN 6 AND 10 THEN 'High Quality' WHEN s BETWEEN 1 AND 5 THEN 'Low Quality' ELSE 'No segmentation' END AS band
    FROM (SELECT account_id, {truncated('potential')} AS s FROM accounts) x""")
SQL["S14_test_account_override"] = out("""
    SELECT a.account_id, a.country, CASE WHEN u.is_test = 1 THEN 1 ELSE 0 END AS is_test FROM accounts a LEFT JOIN raw_users u ON u.user_id = a.account_id""")
SQL["S15_label_tables"] = out("SELECT DISTINCT UPPER(country) AS code, 'Land ' || country AS label FROM accounts WHERE country IS NOT NULL")
SQL["S16_bonus_ledger"] = out(f"""
    SELECT t.money_id, TRY_CAST(t.login AS BIGINT) AS login, CASE WHEN t.raw_type = 'Deposit' THEN t.usd ELSE -t.usd END AS amount, t.confirmed FROM money t
    WHERE {OK} AND ((t.raw_type = 'Deposit' AND t.type IN ('FRF Commission', 'Bonus')) OR (t.raw_type = 'Withdrawal' AND t.type IN ('FRF Commission Cancelled', 'BonusCancelled')))""",
    "confirmed", "amount")
SQL["S17_type_names"] = out("SELECT money_id, type FROM money WHERE money_id IN (SELECT money_id FROM bonuses)")
SQL["S18_deals_after_ticket"] = out("SELECT ticket, source, login, notional FROM deals WHERE ticket > 60", "", "notional")
SQL["S19_platform_users_since"] = out("""
    SELECT login, source, balance, credit FROM platform_users
    WHERE updated > (SELECT MAX(confirmed) FROM bonuses WHERE locked) - INTERVAL '1' DAY""", "", "balance credit")
SQL["S20_trades"] = out(f"""
    SELECT ticket, source, login, symbol, notional FROM deals WHERE cmd IN (0, 1) AND {eq.TRADE} AND open_time >= DATE '1996-01-01'""", "", "notional")
SQL["S21_daily_rows_range"] = out(f"SELECT login, source, CAST(e.at AS DATE) AS day, balance FROM equity e WHERE {rng('e.at', '1998-12-20', LIVE)}", "day", "balance")
SQL["S21_daily_rows_resume"] = out("""
    SELECT login, source, balance, floating FROM equity e WHERE (e.at, e.login, e.source) > (TIMESTAMP '1998-12-25 00:00:00', 10, 'S0')""", "", "balance floating")


def eet(c: str, after: str = "2000-01-01") -> str:
    return f"CASE WHEN {c} > TIMESTAMP '{after} 00:00:00' THEN (({c}) AT TIME ZONE 'EET') AT TIME ZONE 'UTC' ELSE {c} END"


SQL["S22_deals_utc"] = out(f"""
    SELECT ticket, source, {eet('open_time')} AS open_time, {eet('close_time')} AS close_time FROM deals
    WHERE cmd IN (0, 1) AND {eq.TRADE} AND sync_time >= DATE '1995-01-01'""", "open_time close_time")
SQL["S23_open_positions"] = out(f"SELECT position_id, login, symbol, notional FROM positions WHERE cmd IN (0, 1) AND {eq.TRADE}", "", "notional")
SQL["S24_live_figures"] = out(f"""
    SELECT g.login, b.bal AS balance_now, b.cr AS credit_now, f.f AS floating_now, c.c AS closed_pnl FROM (SELECT DISTINCT login FROM {eq.GOOD} q) g
    LEFT JOIN {eq.BAL} b ON b.login = g.login LEFT JOIN {eq.FLOAT} f ON f.login = g.login LEFT JOIN {eq.CLOSED} c ON c.login = g.login""", "",
    "balance_now credit_now floating_now closed_pnl")
SQL["S25_newest_per_login"] = out("""
    SELECT login, ticket, open_time, notional FROM (SELECT *, RANK() OVER (PARTITION BY login ORDER BY open_time DESC) AS rk FROM deals) d WHERE rk = 1""", "open_time", "notional")

# ---- merge rules ---------------------------------------------------------------------------------------------
BASE = "(SELECT account_id, is_test, score, country, funded, pep = 1 AS locked FROM accounts WHERE created < DATE '1998-06-01' OR (created IS NULL AND account_id % 3 < 2))"
DELTA = """(SELECT account_id, 0 AS is_test, CASE WHEN score > 6 THEN score END AS score, country || '*' AS country, 1 - funded AS funded, FALSE AS locked
            FROM accounts WHERE created >= DATE '1997-01-01' OR (created IS NULL AND account_id % 3 > 0))"""
SQL["M1_M3_M4_M5_merge"] = out(f"""
    SELECT COALESCE(d.account_id, b.account_id) AS account_id,
           CASE WHEN d.account_id IS NULL THEN b.is_test WHEN b.account_id IS NULL THEN d.is_test ELSE GREATEST(d.is_test, b.is_test) END AS is_test,
           CASE WHEN d.account_id IS NULL THEN b.score ELSE COALESCE(d.score, b.score) END AS score,
           CASE WHEN d.account_id IS NULL THEN b.country ELSE d.country END AS country,
           CASE WHEN d.account_id IS NULL OR b.locked THEN b.funded ELSE d.funded END AS funded,
           CAST(CASE WHEN d.account_id IS NULL THEN b.locked ELSE COALESCE(b.locked, FALSE) OR d.locked END AS BIGINT) AS locked
    FROM {BASE} b FULL JOIN {DELTA} d ON d.account_id = b.account_id""")
SQL["M6_insert_missing"] = out(f"""
    SELECT account_id, is_test, score, country, funded, CAST(locked AS BIGINT) AS locked FROM {BASE} b UNION ALL
    SELECT account_id, is_test, score, country, funded, CAST(locked AS BIGINT) FROM {DELTA} d WHERE account_id NOT IN (SELECT account_id FROM {BASE} b)""")
SQL["M7_last_per_key"] = out("""
    SELECT source, ticket, notional FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, ticket ORDER BY sync_time DESC, notional DESC, login DESC) AS rn FROM deals) d
    WHERE rn = 1""", "", "notional")
SQL["M10_snapshot_sync"] = out("""
    SELECT position_id, notional FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY position_id ORDER BY last_update DESC, notional DESC, login DESC) AS rn FROM positions) d
    WHERE rn = 1""", "", "notional")
SQL["M11_clean_values"] = out("""
    SELECT account_id, CASE WHEN score IS NULL THEN NULL ELSE SUBSTRING(affiliate, 1, 6) END AS affiliate, CAST(score AS BIGINT) AS score,
           CASE WHEN funded = 0 THEN NULL ELSE account_id / 4.0 END AS ratio FROM accounts""", "", "ratio")
SQL["M12_reject_absurd"] = out("""
    SELECT login, COUNT(*) AS rows, SUM(floating) AS floating FROM equity WHERE floating IS NULL OR ABS(floating) < 100000000 GROUP BY 1""", "", "floating")
SQL["M13_override_values"] = out("""
    SELECT u.agent_id, COALESCE(h.report_dept, u.dept) AS dept, u.office FROM agents u LEFT JOIN dept_history h ON h.agent_id = u.agent_id AND h.valid_to IS NULL""")
SQL["M14_drop_null_keys"] = out("SELECT owner AS agent_id, money_id FROM money WHERE owner IS NOT NULL")
SQL["M18_shift_stored"] = out(f"SELECT ticket, notional, login, {eet('close_time', '1971-01-01')} AS close_time FROM deals", "close_time", "notional")

# ---- filters -------------------------------------------------------------------------------------------------
SQL["F1_valid_money"] = out(f"SELECT t.money_id, t.account_id, t.type, t.usd FROM money t WHERE {VALID}", "", "usd")
SQL["F2_F3_agent_exclusions"] = out(f"""
    SELECT u.agent_id, CAST(({COUNTABLE}) AS BIGINT) AS countable, CAST(({NOTEST}) AS BIGINT) AS not_test, CAST(({NODEPT}) AS BIGINT) AS in_department,
           CASE WHEN u.dept = 'Sales' AND u.team = 'Conversion' AND {LABEL} NOT ILIKE 'duplicated%' AND {FULL} NOT ILIKE 'test%' THEN 'sales'
                WHEN u.dept = 'Retention' AND {LABEL} NOT ILIKE 'duplicated%' AND {FULL} NOT ILIKE 'test%' AND {NODEPT} THEN 'retention' ELSE 'other' END AS dept_group
    FROM agents u""")
SQL["F4_bonus_comments"] = out(f"SELECT CAST(({NOBONUS}) AS BIGINT) AS plain, COUNT(*) AS rows, SUM(t.usd) AS usd FROM money t GROUP BY 1", "", "usd")
SQL["F5_real_accounts"] = out(f"SELECT a.account_id, a.country FROM accounts a WHERE {LIVEACC}")
SQL["F6_date_range"] = out(f"SELECT type, COUNT(*) AS rows FROM money WHERE {rng('confirmed', '1996-02-01', '1999-02-28')} GROUP BY 1")
A0, A1 = "1997-01-01", "1998-06-15"
SQL["F7_two_axis_measures"] = out(f"""
    SELECT agent_id, SUM(CASE WHEN {rng('qual_date', A0, A1)} THEN ftc_count END) AS ftc, SUM(CASE WHEN {rng('tx_date', A0, A1)} THEN net_usd END) AS net_usd,
           SUM(CASE WHEN {rng('tx_date', A0, A1)} THEN deposit_usd END) AS deposit_usd, SUM(CASE WHEN {rng('tx_date', A0, A1)} THEN ftd_count END) AS ftd_count,
           SUM(CASE WHEN {rng('tx_date', A0, A1)} THEN ftd_usd END) AS ftd_usd, SUM(CASE WHEN tx_date = DATE '{A1}' THEN ftd_count END) AS daily_ftd,
           SUM(CASE WHEN tx_date = DATE '{A1}' THEN ftd_usd END) AS daily_ftd_usd, SUM(CASE WHEN qual_date = DATE '{A1}' THEN ftc_count END) AS daily_ftc,
           SUM(CASE WHEN tx_date = DATE '{A1}' THEN net_usd END) AS daily_net
    FROM kpis WHERE ({rng('qual_date', A0, A1)}) OR ({rng('tx_date', A0, A1)}) GROUP BY 1""", "", "net_usd deposit_usd ftd_usd daily_ftd_usd daily_net",
    "ftc ftd_count daily_ftd daily_ftc")
SQL["F8_score_bands"] = out("""
    SELECT score, COUNT(*) AS rows FROM accounts WHERE score BETWEEN 6 AND 10 OR score IS NULL OR score NOT BETWEEN 1 AND 10 GROUP BY 1""")
DAYS = f"(DATE '{LIVE}' - CAST(a.qualified AS DATE))"
SQL["F9_aging_filter"] = out(f"SELECT a.account_id FROM accounts a WHERE {DAYS} BETWEEN 8 AND 14 OR {DAYS} BETWEEN 61 AND 90 OR {DAYS} > 120")
SQL["F11_role_access"] = out("""
    SELECT agent_id, dept, office FROM agents WHERE (dept = 'Retention' AND office = 'SA') OR (dept = 'Sales' AND office = 'GMT')""")
SQL["F12_trade_symbols"] = out(f"SELECT symbol, cmd, COUNT(*) AS rows, SUM(notional) AS notional FROM deals WHERE cmd < 2 AND {eq.TRADE} GROUP BY 1, 2", "", "notional")
SQL["F13_floor_date"] = out("SELECT * FROM volume WHERE open_date >= DATE '1998-01-01'", "open_date", "notional_usd", "has_positive_notional")
GROUPS = {"marketing_group": "c.marketing_group", "campaign_legacy_id": "c.legacy_id", "campaign_name": "c.name", "campaign_channel": "c.channel",
          "campaign_sub_channel": "c.sub_channel", "original_affiliate": "a.affiliate", "office_name": "cu.office_name", "agent_name": "cu.agent_name",
          "agent_team": "cu.team", "country": "a.country", "client_classification": "CAST(a.score AS STRING)",
          "segmentation": rp.segment(f"DATE '{LIVE}'"), "account_id": "CAST(a.account_id AS STRING)"}
SQL["F15_dynamic_groups"] = out(" UNION ALL ".join(
    f"SELECT '{n}' AS dimension, COALESCE({e}, '(Unassigned)') AS label, COUNT(*) AS clients FROM accounts a {rp.CAMP} "
    f"LEFT JOIN agents cu ON cu.agent_id = a.assigned_to GROUP BY 1, 2" for n, e in GROUPS.items()))
SQL["F16_active_clients"] = out("""
    SELECT country, COUNT(*) FILTER (WHERE compliance IN ('4', '9')) AS active, COUNT(*) FILTER (WHERE compliance NOT IN ('4', '9')) AS inactive FROM accounts GROUP BY 1""")

# ---- projections ---------------------------------------------------------------------------------------------
SQL["P1_signed_amount"] = out(f"SELECT t.money_id, {NET} AS signed, {DEP} AS paid_in, {WDR} AS paid_out FROM money t", "", "signed paid_in paid_out")


# The typing rules, written out here once more, so that a change of the rule table shows.
TYPING = """CASE
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Adjustment') AND t.subtype IN ('IB Commission') AND t.created <= DATE '2023-01-01' THEN 'IB Commission'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Commission') AND t.subtype IN ('IB Commission') AND t.created <= DATE '2023-01-01' THEN 'IB Commission'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Commission') AND t.created <= DATE '2023-01-01' AND (o.comment IN ('Affiliate Payment To Trading Pl')) THEN 'IB Commission'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Adjustment') AND t.subtype IN ('IB Commission') AND t.created <= DATE '2023-01-01' THEN 'IB Commission Cancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Commission') AND t.subtype IN ('IB Commission') AND t.created <= DATE '2023-01-01' THEN 'IB Commission Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('IB commission') AND (o.comment IN ('IB Commission PayOut Cancelled', 'IB Commission PayOut Void')) THEN 'IB Commission PayOut Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('IB commission') AND (o.comment IN ('IB Commission')) THEN 'IB Commission'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('IB commission') AND t.created <= DATE '2023-01-01' THEN 'IB Commission PayOut'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('IB commission') AND (o.comment IN ('IB Commission Void')) THEN 'IB Commission Cancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('IB commission') AND (o.comment IN ('IB Commission PayOut')) THEN 'IB Commission PayOut'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Commission') AND t.subtype IN ('FRF Commission') AND t.created <= DATE '2022-12-05' THEN 'FRF Commission'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Adjustment') AND t.subtype IN ('FRF Commission') AND t.created <= DATE '2022-12-05' THEN 'FRF Commission'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Commission') AND t.subtype IN ('FRF Commission') AND t.created <= DATE '2022-12-05' THEN 'FRF Commission Cancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Adjustment') AND t.subtype IN ('FRF Commission') AND t.created <= DATE '2022-12-05' THEN 'FRF Commission Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('FRF commission') AND t.created >= DATE '2022-12-05' AND (o.comment IN ('FRF PayOut Cancelled', 'FRF PayOut Void')) THEN 'FRF Commission PayOutCancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('FRF commission') AND t.created >= DATE '2022-12-05' AND (o.comment IN ('FRF - Transfer to Balance')) THEN 'FRF Commission Transfer to Balance'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('FRF commission') AND t.created >= DATE '2022-12-05' AND (o.comment IN ('FRF - Transfer to Balance Void')) THEN 'FRF Commission Transfer to Balance Cancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('FRF commission') AND t.created >= DATE '2022-12-05' AND (o.comment IN ('FRF PayOut')) THEN 'FRF Commission PayOut'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('FRF commission') AND t.created < DATE '2022-12-05' THEN 'FRF Commission Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('FRF commission') AND t.created < DATE '2022-12-05' THEN 'FRF Commission'
    WHEN t.raw_type = 'Credit In' AND (o.comment IN ('FRF') OR o.comment ILIKE '%FRF Commission%' OR o.comment ILIKE '%Refer a friend%' OR o.comment ILIKE '%FRF Bonus%') THEN 'FRF Commission'
    WHEN t.raw_type = 'Credit Out' AND (o.comment IN ('FRF Void') OR o.comment ILIKE '%FRF Commission%' OR o.comment ILIKE '%Refer a friend%' OR o.comment ILIKE '%FRF Bonus%') THEN 'FRF Commission Cancelled'
    WHEN t.raw_type = 'Credit In' AND (o.comment ILIKE '%advance%') THEN 'Credit In Advance'
    WHEN t.raw_type = 'Credit Out' AND (o.comment ILIKE '%advance%') THEN 'Credit In Advance Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Bonus') AND t.created <= DATE '2022-11-01' THEN 'Bonus'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Bonus') AND (o.comment IN ('Deposit,Bonus', 'Bonus', 'CashBack Bonus')) THEN 'Bonus'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Bonus') AND (o.comment LIKE '%Transfer to Balance%') THEN 'Bonus Transfer to Balance'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Bonus') AND (o.comment LIKE 'Bonus Transfer to Balance Cancel%') THEN 'Bonus Transfer to Balance Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Bonus') AND (o.comment IN ('Bonus PayOut Cancelled', 'Bonus PayOut Void')) THEN 'Bonus PayOut Cancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Bonus') AND t.created <= DATE '2022-11-01' THEN 'BonusCancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Bonus') AND (o.comment IN ('Bonus PayOut')) THEN 'Bonus PayOut'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Bonus') THEN 'BonusCancelled'
    WHEN t.raw_type = 'Credit In' THEN 'Bonus'
    WHEN t.raw_type = 'Credit Out' THEN 'BonusCancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Adjustment') AND t.subtype IN ('Deposit Void') AND t.created <= DATE '2023-01-01' THEN 'Deposit Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Adjustment') AND t.subtype IN ('Withdrawal Void') AND t.created <= DATE '2023-01-01' THEN 'Withdrawal Cancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Credit card', 'Electronic payment', 'Wire transfer', 'CryptoWallet', 'Cash') AND (o.comment IN ('Deposit Cancelled', 'Deposit Void')) THEN 'Deposit Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Credit card', 'Electronic payment', 'Wire transfer', 'CryptoWallet', 'Cash') AND (o.comment IN ('Withdrawal Cancelled', 'Withdrawal Void')) THEN 'Withdrawal Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('None', 'Wire', 'Credit card', 'ElectronicPayment', 'Electronic payment', 'Wire transfer', 'Crypto', 'CryptoWallet', 'Cash', 'External', 'CreditCard') THEN 'Deposit'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('None', 'Wire', 'Credit card', 'ElectronicPayment', 'Electronic payment', 'Wire transfer', 'Crypto', 'CryptoWallet', 'Cash', 'External', 'CreditCard') THEN 'Withdrawal'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Chargeback') THEN 'Charge Back Cancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Chargeback') THEN 'Charge Back'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Processing fees') THEN 'Fee Cancelled'
    WHEN t.raw_type = 'Fee' THEN 'Fee'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Processing fees', 'Fee', 'ProcessingFee') THEN 'Fee'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Transfer') THEN 'Transfer To Account'
    WHEN t.raw_type = 'TransferIn' THEN 'Transfer To Account'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Transfer') THEN 'Transfer From Account'
    WHEN t.raw_type = 'TransferOut' THEN 'Transfer From Account'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Adjustment') AND t.subtype IN ('Gift') AND t.created < DATE '2023-01-01' THEN 'Gift'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Commission') AND t.subtype IN ('Gift') AND t.created < DATE '2023-01-01' THEN 'Gift'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Adjustment') AND t.subtype IN ('Gift') AND t.created < DATE '2023-01-01' THEN 'Gift Cancelled'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Commission') AND t.subtype IN ('Gift') AND t.created < DATE '2023-01-01' THEN 'Gift Cancelled'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Adjustment') AND (o.comment ILIKE '%transfer%') THEN 'Transfer To Account'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Adjustment') AND (o.comment ILIKE '%transfer%') THEN 'Transfer From Account'
    WHEN t.raw_type = 'Deposit' AND t.method IN ('Adjustment') THEN 'Positive Trading Adjustment'
    WHEN t.raw_type LIKE 'Withdraw%' AND t.method IN ('Adjustment') THEN 'Negative Trading Adjustment'
    ELSE 'Not Set' END"""
TYPED = f"""(SELECT t.money_id, t.created, {TYPING} AS type
    FROM raw_money t LEFT JOIN balance_ops o ON o.cmd = 6 AND REGEXP_MATCHES(t.order_ref, '^[0-9]+(\\.[0-9]*)?$')
     AND o.ticket = CAST(ROUND(TRY_CAST(RTRIM(t.order_ref, '.') AS DECIMAL(38, 6))) AS BIGINT))"""
SQL["P2_transaction_types"] = out(f"SELECT money_id, type FROM {TYPED} x")
SQL["M19_retyping_changed"] = out(f"""
    SELECT CASE WHEN created >= DATE '2022-12-01' THEN type ELSE 'kept' END AS type, COUNT(*) AS rows FROM {TYPED} x GROUP BY 1""")
SQL["P5_office_and_group"] = out(f"""
    SELECT CAST(agent_id AS STRING) AS id, {office('office')} AS label FROM agents UNION ALL SELECT 'c' || campaign_id, marketing_group FROM campaigns""")
ROUNDED = "CAST(ROUND(TRY_CAST(TRIM(potential) AS DECIMAL(20, 6))) AS INTEGER)"
SQL["P8_score_text"] = out(f"SELECT account_id, {truncated('potential')} AS truncated, CASE WHEN {ROUNDED} BETWEEN 1 AND 10 THEN {ROUNDED} END AS rounded FROM accounts")
ON = f"DATE '{LIVE}'"
SQL["P9_score_or_age"] = out(f"SELECT a.account_id, {score(ON)} AS score FROM accounts a")
Y = age("a.birth_date", ON)
SQL["P10_score_backfill"] = out(f"""
    SELECT a.account_id, CASE WHEN a.birth_date IS NOT NULL AND {LIVEACC} AND (a.score IS NULL OR a.score NOT BETWEEN 1 AND 10)
        THEN CASE WHEN {Y} < 25 THEN 3 WHEN {Y} < 30 THEN 4 WHEN {Y} < 35 THEN 5 WHEN {Y} < 45 THEN 6 ELSE 7 END ELSE a.score END AS score FROM accounts a""")
SQL["P11_P15_labels"] = out(f"""
    SELECT a.account_id, {rp.segment(ON)} AS segment,
           CASE WHEN a.score BETWEEN 6 AND 10 THEN 'High Quality' WHEN a.score BETWEEN 1 AND 5 THEN 'Low Quality' ELSE 'No segmentation' END AS band,
           {rp.bucket(DAYS, rp.BUCKETS, "'(Unknown)'")} AS aging, {rp.bucket(DAYS, rp.BUCKETS, "99", False)} AS aging_sort,
           {rp.bucket(Y, rp.AGES, "'(Unknown)'")} AS age_group, {rp.bucket(Y, rp.AGES, "99", False)} AS age_sort,
           CASE WHEN COALESCE(a.score, 0) BETWEEN 6 AND 10 THEN 'High' WHEN COALESCE(a.score, 0) BETWEEN 1 AND 5 THEN 'Low'
                WHEN a.birth_date IS NOT NULL AND {Y} >= 30 THEN 'High' WHEN a.birth_date IS NOT NULL THEN 'Low' ELSE 'N/A' END AS quality, {Y} AS age
    FROM accounts a""", "", "", "aging_sort age_sort age")
SQL["P16_countries"] = out("""
    SELECT s AS shown, CASE WHEN s IN ('SE', 'DK', 'NL', 'ES', 'FI', 'NO') THEN 'European Union' WHEN s IN ('CM', 'KE', 'ZM') THEN 'Other Foreign' END AS investor_type, COUNT(*) AS clients
    FROM (SELECT CASE WHEN country = 'AW' THEN 'NL' ELSE country END AS s FROM accounts) x GROUP BY 1, 2""")


def steps(c: str, rows, other: str = "0") -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {b} THEN {v}" for b, v in rows) + f" ELSE {other} END"


SQL["P_bonus_tiers"] = out(f"""
    SELECT agent_id, {steps('net * 10', ((200000, .04), (150000, .0375), (100000, .035), (75000, .03), (50000, .02), (20000, .015)))} AS pct_a,
           {steps('net * 10', ((100000, .035), (80000, .03), (60000, .028), (50000, .025), (40000, .02), (30000, .018), (20000, .015), (10000, .01)))} AS pct_b,
           CASE WHEN net IS NULL THEN 0 ELSE {steps('net / 3000', ((2, .015), (1.5, .0125), (1, .01), (.75, .005), (.5, .002)))} END AS volume_pct,
           {rp.mult('n')} AS multiplier, CASE WHEN n >= 6 THEN {steps('n', ((60, 1500), (50, 1000), (35, 500), (30, 300), (25, 200), (20, 150), (5, 100)))} ELSE 0 END AS target_bonus,
           CASE WHEN net < 500 THEN 0 WHEN net < 1000 THEN 10 WHEN net < 5000 THEN 20 ELSE 50 END AS amount_bonus
    FROM (SELECT agent_id, SUM(net_usd) AS net, SUM(ftc_count) AS n FROM kpis GROUP BY 1) x""", "", "pct_a pct_b volume_pct")

# ---- joins ---------------------------------------------------------------------------------------------------
SQL["J3_login_accounts"] = out("SELECT l.login, l.account_id, a.assigned_to FROM logins l JOIN accounts a ON a.account_id = l.account_id WHERE a.is_test = 0")
SQL["J4_first_entry_volume"] = out("""
    SELECT x.login, e.open_time, SUM(x.notional) AS notional, COUNT(*) AS pairs, MAX(CASE WHEN x.notional > 0 THEN 1 ELSE 0 END) AS has_notional
    FROM deals x JOIN (SELECT position_id, source, MIN(open_time) AS open_time FROM deals WHERE entry = 0 GROUP BY 1, 2) e
      ON e.position_id = x.position_id AND e.source = x.source
    WHERE x.entry = 1 AND x.close_time > TIMESTAMP '1971-01-01 00:00:00' GROUP BY 1, 2""", "open_time", "notional", "has_notional")
SQL["J6_semi_join"] = out(f"SELECT money_id FROM money WHERE account_id IN (SELECT a.account_id FROM accounts a WHERE {eq.SCOPE})")
SQL["J7_null_aware_exclusion"] = out(f"SELECT a.account_id, a.assigned_to FROM accounts a WHERE {rp.SHOWN}")
SQL["J8_no_money"] = out(f"SELECT a.account_id FROM accounts a WHERE NOT EXISTS (SELECT 1 FROM money t WHERE t.account_id = a.account_id AND {VALID})")
SQL["J9_as_of"] = out(f"SELECT login, source, balance, floating FROM {eq.newest(chr(39).join(('e.at < DATE ', '1999-01-01', '')))} q", "", "balance floating")
SQL["J10_effective_dated"] = out("""
    SELECT DISTINCT agent_id FROM dept_history WHERE report_dept = 'Retention' AND valid_from <= DATE '1997-03-31' AND (valid_to IS NULL OR valid_to >= DATE '1996-01-01')""")
SQL["J12_state_at_cutoff"] = out(f"""
    SELECT account_id, running AS total, confirmed, owner FROM (
        SELECT t.account_id, t.confirmed, t.owner, SUM({NET}) OVER (PARTITION BY t.account_id ORDER BY t.confirmed, t.money_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
               ROW_NUMBER() OVER (PARTITION BY t.account_id ORDER BY t.confirmed DESC, t.money_id DESC) AS rn
        FROM money t JOIN accounts a ON a.account_id = t.account_id WHERE {VALID} AND a.qualified IS NOT NULL AND t.confirmed <= a.qualified) x WHERE rn = 1""",
    "confirmed", "total")
SQL["J14_campaign_key"] = out("""
    SELECT c.marketing_group, COUNT(*) AS clients FROM accounts a JOIN campaigns c ON c.campaign_id = SPLIT_PART(a.campaign, '.', 1) GROUP BY 1""")
SQL["J15_email_match"] = out("""
    SELECT x.agent_name, COALESCE(x.agent_id, u.agent_id) AS agent_id FROM agents_master x LEFT JOIN agents u ON LOWER(TRIM(u.email)) = LOWER(TRIM(x.email))""")

# ---- aggregates, windows, order ------------------------------------------------------------------------------
SQL["A2_A3_distinct_counts"] = out(f"""
    SELECT k.agent_id, k.sum_of_distinct, COALESCE(x.n, 0) AS true_distinct FROM (SELECT agent_id, SUM(ftc_count) AS sum_of_distinct FROM kpis WHERE agent_id IS NOT NULL GROUP BY 1) k
    LEFT JOIN (SELECT t.owner, COUNT(DISTINCT t.account_id) AS n FROM money t JOIN accounts a ON a.account_id = t.account_id
               WHERE {VALID} AND t.type = 'Deposit' AND t.ftd = 1 AND a.is_test = 0 GROUP BY 1) x ON x.owner = k.agent_id""", "", "", "sum_of_distinct")
SCORES = f"""SELECT DISTINCT t.owner AS agent_id, t.account_id, {score(ON)} AS s FROM money t JOIN accounts a ON a.account_id = t.account_id
    WHERE {VALID} AND t.type = 'Deposit' AND t.ftd = 1 AND a.is_test = 0"""
SQL["A5_average_scores"] = out(f"""
    SELECT x.agent_id, x.v AS avg_score, y.v AS daily_avg_score
    FROM (SELECT agent_id, ROUND(AVG(s), 1) AS v FROM ({SCORES} AND {rng('t.confirmed')}) a WHERE s IS NOT NULL GROUP BY 1) x
    LEFT JOIN (SELECT agent_id, ROUND(AVG(s), 1) AS v FROM ({SCORES} AND {rng('t.confirmed', LAST, LAST)}) b WHERE s IS NOT NULL GROUP BY 1) y
      ON y.agent_id IS NOT DISTINCT FROM x.agent_id""")
SQL["A8_net_by_period"] = out("""
    SELECT CAST(DATE_TRUNC('year', tx_date) AS DATE) AS year, CAST(DATE_TRUNC('month', tx_date) AS DATE) AS month, SUM(net_usd) AS net_usd, SUM(ftd_count) AS ftd_count
    FROM kpis GROUP BY 1, 2""", "year month", "net_usd", "ftd_count")
RUNNING = f"""(SELECT t.account_id, t.money_id, t.confirmed, SUM({NET}) OVER (PARTITION BY t.account_id ORDER BY t.confirmed, t.money_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM money t WHERE {VALID})"""
SQL["A12_first_crossing"] = out(f"SELECT account_id, MIN(confirmed) AS crossed_at FROM {RUNNING} x WHERE running >= 150 GROUP BY 1", "crossed_at")
SQL["A13_floored_total"] = out("SELECT source, SUM(GREATEST(equity, 0)) AS floored, SUM(equity) AS plain FROM equity GROUP BY 1", "", "floored plain")
SQL["W1_running_total"] = out(f"SELECT money_id, running FROM {RUNNING} x", "", "running")
SQL["W3_newest_money"] = out(f"""
    SELECT account_id, money_id, owner FROM (SELECT t.*, ROW_NUMBER() OVER (PARTITION BY t.account_id ORDER BY t.confirmed DESC, t.money_id DESC) AS rn
                                             FROM money t WHERE {VALID}) x WHERE rn = 1""")
SQL["W4_first_ftd"] = out(f"SELECT account_id, owner AS ftd_owner, day AS ftd_day FROM {rp.FIRST_FTD} x", "ftd_day")
SQL["W5_newest_per_day"] = out("SELECT login, day, source, balance, floating FROM equity_days", "day", "balance floating")
SQL["O3_top_payments"] = out(f"SELECT t.money_id, t.usd FROM money t WHERE {VALID} ORDER BY ABS(t.usd) DESC, t.money_id LIMIT 25", "", "usd")
SQL["U1_traded_notional"] = out("""
    SELECT login, CAST(open_time AS DATE) AS open_date, SUM(notional) AS notional, MAX(CASE WHEN notional > 0 THEN 1 ELSE 0 END) AS has_notional
    FROM (SELECT login, open_time, notional FROM positions UNION ALL SELECT login, open_time, notional FROM resolved) x GROUP BY 1, 2""", "open_date", "notional", "has_notional")
SQL["U5_common_logins"] = out(f"SELECT login FROM equity INTERSECT SELECT login FROM {eq.GOOD} g")

# ---- jobs ----------------------------------------------------------------------------------------------------
MATCHED = """(SELECT x.agent_name, x.office_name, x.email, x.start_date, x.target_group, x.is_active, COALESCE(x.agent_id, u.agent_id) AS agent_id
    FROM agents_master x LEFT JOIN agents u ON LOWER(TRIM(u.email)) = LOWER(TRIM(x.email)))"""


def ladder(until: str, only: str = "TRUE") -> str:
    tenure = """GREATEST((YEAR(month) - YEAR(start_date)) * 12 + MONTH(month) - MONTH(start_date) - CASE WHEN DAY(start_date) > 1 THEN 1 ELSE 0 END, 0)"""
    return f"""SELECT agent_name, office_name, email, start_date, target_group, agent_id, month AS report_month, t AS tenure_months,
            CASE WHEN LOWER(TRIM(office_name)) = 'general' THEN NULL WHEN t <= 1 THEN 0 WHEN t <= 5 THEN (t - 1) * 10000 WHEN t = 6 THEN 55000
                 WHEN t = 7 THEN 75000 WHEN t = 8 THEN 85000 ELSE 100000 END AS net_target, LEAST(t * 5, 35) AS ftd100_target
        FROM (SELECT *, {tenure} AS t FROM (
            SELECT a.*, CAST(g.m AS DATE) AS month FROM {MATCHED} a JOIN GENERATE_SERIES(TIMESTAMP '1998-01-01 00:00:00', TIMESTAMP '{until}-01 00:00:00', INTERVAL '1' MONTH) g(m)
              ON g.m >= DATE_TRUNC('month', a.start_date) WHERE a.start_date <= DATE '{until}-15') x) y WHERE {only}"""


SQL["D5_target_backfill"] = out(ladder("2000-06"), "start_date report_month", "", "tenure_months net_target ftd100_target")
SQL["D6_month_append"] = out(f"{ladder('2000-03')} UNION ALL {ladder('2000-06', chr(39).join(('is_active AND month = DATE ', '2000-06-01', '')))}",
                             "start_date report_month", "", "tenure_months net_target ftd100_target")
SQL["D7_unmatched_agents"] = out("SELECT agent_name, email, target_group, start_date FROM agents_master WHERE agent_id IS NULL", "start_date")
SQL["D7_match_counts"] = out("SELECT COUNT(agent_id) AS matched, COUNT(*) - COUNT(agent_id) AS unmatched FROM agents_master")
SQL["D8_open_holidays"] = out("""
    SELECT h.holiday, CASE STRFTIME(h.holiday, '%m-%d') WHEN '01-01' THEN 'New Year''s Day' WHEN '12-24' THEN 'Christmas Eve' WHEN '12-25' THEN 'Christmas Day'
           WHEN '12-26' THEN 'Boxing Day' ELSE 'New Year''s Eve' END AS description, COUNT(*) AS rows
    FROM money t JOIN holidays h ON h.holiday = CAST(t.confirmed AS DATE) GROUP BY 1, 2""", "holiday")
SQL["D9_agent_scores"] = out("""
    SELECT t.month AS report_date, t.agent_id, COALESCE(u.full_name, 'Unknown') AS full_name, t.ftc, t.net
    FROM targets t LEFT JOIN agents u ON CAST(u.agent_id AS STRING) = t.agent_id AND u.agent_name IS NOT NULL""", "report_date", "ftc net")
SQL["D11_members"] = out("""
    SELECT x.agent_id, x.agent_name AS full_name, 'agent' AS role, CASE WHEN u.status <> 'Active' THEN 0 ELSE 1 END AS is_active
    FROM agents_master x JOIN agents u ON u.agent_id = x.agent_id
    UNION ALL SELECT u.agent_id, COALESCE(NULLIF(TRIM(u.agent_name), ''), NULLIF(TRIM(u.full_name), '')), 'agent', 1 FROM agents u
    WHERE u.status = 'Active' AND u.agent_id NOT IN (SELECT agent_id FROM agents_master WHERE agent_id IS NOT NULL)""")
SQL["I7_fresher_copy"] = out("""
    SELECT login, balance, CASE WHEN source = 'S0' THEN 'remote' ELSE 'local' END AS data_source FROM platform_users
    WHERE source = CASE WHEN (SELECT MAX(updated) FROM platform_users WHERE source = 'S0') >= TIMESTAMP '1999-01-10 00:00:00' THEN 'S0' ELSE 'S1' END""", "", "balance")
LOW = "AND a.score BETWEEN 1 AND 5"
SQL["R11_two_filters"] = out(f"""
    SELECT t.traders, t.avg_score, p.depositors, p.net,
           CASE WHEN t.traders <> 0 THEN ROUND_EVEN(CAST(p.depositors AS DOUBLE) / t.traders * 100, 2) ELSE 0 END AS depositor_pct,
           CASE WHEN t.traders <> 0 THEN ROUND_EVEN(CAST(p.net AS DOUBLE) / t.traders, 2) ELSE 0 END AS ltv_traders,
           CASE WHEN p.depositors <> 0 THEN ROUND_EVEN(CAST(p.net AS DOUBLE) / p.depositors, 2) ELSE 0 END AS ltv_depositors
    FROM (SELECT COUNT(DISTINCT account_id) AS traders, ROUND(AVG(s_ref), 2) AS avg_score FROM {rp.TRADED.replace("WHERE", f"WHERE u.office = 'GMT' {LOW} AND", 1)} x) t,
         (SELECT COUNT(DISTINCT CASE WHEN type = 'Deposit' THEN account_id END) AS depositors, COALESCE(SUM(net), 0) AS net
          FROM {rp.PAID.replace("WHERE", f"WHERE u.office = 'GMT' {LOW} AND", 1)} y) p""", "", "net")

# ---- streams -------------------------------------------------------------------------------------------------
SQL["I1_stream_merge"] = out("SELECT money_id, account_id, type, usd, confirmed FROM money", "confirmed", "usd")
SQL["I3_resume_after_max"] = out("""
    SELECT payment_id, user_id FROM raw_payments WHERE payment_id > (SELECT MAX(platform_account_id) FROM raw_platform_accounts)""")
SQL["I4_stream_deduplicated"] = out("SELECT money_id, type, usd, confirmed FROM money", "confirmed", "usd")
SQL["I5_M16_reprocessed_days"] = out(f"""
    WITH c AS (SELECT e.login, e.day, CASE WHEN e.net <= 0 THEN 0 ELSE ROUND(GREATEST(e.net - GREATEST(COALESCE(b.bonus, 0), 0), 0), 2) END AS eez
               FROM (SELECT d.login, d.day, {eq.NETEQ} AS net FROM equity_days d JOIN test_logins tl ON tl.login = d.login AND tl.is_test = 0) e
               LEFT JOIN (SELECT d2.login, d2.day, SUM(b.amount) AS bonus FROM equity_days d2 JOIN bonuses b ON b.login = d2.login
                          AND CAST(b.confirmed AS DATE) <= d2.day GROUP BY 1, 2) b ON b.login = e.login AND b.day = e.day)
    SELECT login, day, end_eez, start_eez FROM snap WHERE day BETWEEN DATE '1998-12-25' AND DATE '1999-01-20'
    UNION ALL SELECT n.login, n.day, n.eez, p.eez FROM c n LEFT JOIN c p ON p.login = n.login AND p.day = n.day - 1
    WHERE n.day NOT BETWEEN DATE '1998-12-25' AND DATE '1999-01-20'""", "day", "end_eez start_eez")
SQL["I6_stream_daily_totals"] = out(f"""
    SELECT t.owner AS agent_id, CAST(t.confirmed AS DATE) AS tx_date, SUM({NET}) AS net_usd, SUM({DEP}) AS deposit_usd, SUM({WDR}) AS withdrawal_usd,
           COUNT(*) FILTER (WHERE t.type = 'Deposit' AND t.ftd = 1) AS ftd_count FROM money t WHERE {VALID} AND t.owner IS NOT NULL GROUP BY 1, 2""", "tx_date",
    "net_usd deposit_usd withdrawal_usd")


# ---- stored views --------------------------------------------------------------------------------------------
SQL["M15_audit_rows"] = out("""
    SELECT 'daily_kpis' AS table_name, COUNT(*) AS rows, 'success' AS status, CAST(NULL AS STRING) AS error FROM kpis
    UNION ALL SELECT 'run_rate_base', COUNT(*), 'success', NULL FROM run_rate""")
SQL["R13_targets_by_source"] = out("""
    SELECT s.side, TRY_CAST(t.agent_id AS BIGINT) AS agent_id, CAST(t.ftc AS INTEGER) AS target_ftc, t.net AS target_net
    FROM targets t, (VALUES ('plan'), ('history')) s(side) WHERE t.month = DATE '1995-01-01' AND (s.side = 'plan' OR TRY_CAST(t.agent_id AS BIGINT) IS NOT NULL)""",
    "", "target_net", "target_ftc")
