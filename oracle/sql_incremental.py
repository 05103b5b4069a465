"""Comparison SQL of stored tables that change in batches: a kept view equals the view of the final tables."""

from __future__ import annotations

from oracle.base import VALID, out
from oracle.sql_reports import FTCS

SQL: dict[str, str] = {}
#: query of a kept view -> query whose SQL gives the same rows
SAME = {"V1_kept_by_changes": "V1_daily_kpis", "V4_kept_by_changes": "V4_run_rate", "V6_kept_by_changes": "V6_second_deposit_clients",
        "I6_kept_by_changes": "I6_stream_daily_totals"}


def _open(day: str) -> str:
    held = f"(DATE '{day}' - CAST(open_time AS DATE))"
    return (f"(SELECT position_id, notional, swap FROM (SELECT position_id, notional, CASE WHEN {held} > 60 THEN swap * 2 ELSE swap END AS swap, "
            f"ROW_NUMBER() OVER (PARTITION BY position_id ORDER BY last_update DESC, notional DESC, login DESC) AS rn "
            f"FROM positions WHERE {held} BETWEEN 0 AND 90) p WHERE rn = 1)")


SQL["M10_snapshot_changes"] = out(f"""
    SELECT COALESCE(a.position_id, b.position_id) AS position_id,
           CASE WHEN a.position_id IS NULL THEN 'insert' WHEN b.position_id IS NULL THEN 'delete' ELSE 'update' END AS operation,
           a.swap AS old_swap, b.swap AS new_swap, COALESCE(b.notional, a.notional) AS notional
    FROM {_open('1996-02-15')} a FULL JOIN {_open('1996-04-01')} b ON b.position_id = a.position_id
    WHERE a.position_id IS NULL OR b.position_id IS NULL OR a.swap IS DISTINCT FROM b.swap OR a.notional IS DISTINCT FROM b.notional""",
    "", "old_swap new_swap notional")
_SIDE = "(SELECT login, MAX(balance) AS balance, MAX(credit) AS credit FROM platform_users WHERE source = '{}' GROUP BY 1)"
SQL["J20_changed_balances"] = out(f"""
    SELECT COALESCE(a.login, b.login) AS login, CASE WHEN a.login IS NULL THEN 'insert' WHEN b.login IS NULL THEN 'delete' ELSE 'update' END AS operation,
           a.balance AS old_balance, b.balance AS new_balance
    FROM {_SIDE.format('S0')} a FULL JOIN {_SIDE.format('S1')} b ON b.login = a.login
    WHERE a.login IS NULL OR b.login IS NULL OR a.balance IS DISTINCT FROM b.balance OR a.credit IS DISTINCT FROM b.credit""",
    "", "old_balance new_balance")
_FIRSTS = f"""(SELECT t.owner AS agent_id, CAST(DATE_TRUNC('month', t.confirmed) AS DATE) AS month, t.account_id
    FROM money t JOIN accounts a ON a.account_id = t.account_id WHERE {VALID} AND t.type = 'Deposit' AND t.ftd = 1 AND a.is_test = 0)"""
SQL["A2_A3_distinct_by_range"] = out(f"""
    SELECT 'agent month' AS level, agent_id, month, COUNT(DISTINCT account_id) AS clients FROM {_FIRSTS} x GROUP BY 2, 3
    UNION ALL SELECT 'agent', agent_id, NULL, COUNT(DISTINCT account_id) FROM {_FIRSTS} x GROUP BY 2
    UNION ALL SELECT 'month', NULL, month, COUNT(DISTINCT account_id) FROM {_FIRSTS} x GROUP BY 3
    UNION ALL SELECT 'all', NULL, NULL, COUNT(DISTINCT account_id) FROM {_FIRSTS} x""", "month")
SQL["F17_indexed_totals"] = out(f"""
    SELECT n.needle, COUNT(r.account_id) AS rows, SUM(ftc) AS ftc, SUM(ftc_deposit) AS ftc_deposit, SUM(ftc_wd) AS ftc_wd, SUM(basic_bonus) AS basic_bonus,
           SUM(ftd_amount_bonus) AS ftd_amount_bonus
    FROM (VALUES ('NATION_1'), ('nation_2'), ('10'), ('Agent'), ('no such text')) n(needle) LEFT JOIN ({FTCS}) r
      ON CONTAINS(LOWER(CAST(r.account_id AS STRING)), LOWER(n.needle)) OR CONTAINS(LOWER(r.agent_name), LOWER(n.needle))
      OR CONTAINS(LOWER(r.desk), LOWER(n.needle)) OR CONTAINS(LOWER(r.office_name), LOWER(n.needle)) GROUP BY 1""",
    "", "ftc_deposit ftc_wd basic_bonus", "ftc ftd_amount_bonus")
SQL["I1_state_upserts"] = out("""
    SELECT money_id, CASE WHEN money_id % 3 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN money_id % 3 = 0 THEN 'Pending' ELSE approval END AS approval, usd,
           CASE WHEN money_id % 3 < 2 THEN usd + 10 ELSE usd END AS peak FROM money""", "", "usd peak", "version")
SQL["I7_last_good_copy"] = out("SELECT login, balance, 'last good' AS data_source FROM platform_users WHERE source = 'S1'", "", "balance")
