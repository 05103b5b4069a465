"""Comparison SQL of lists, status, reconciliation and quality checks."""

from __future__ import annotations

from oracle import sql_equity as eq
from oracle.base import NET, NOBONUS, OK, VALID, out, rng

SQL: dict[str, str] = {}

SQL["R28_transactions"] = out(f"""
    SELECT t.money_id, t.login, t.usd, t.type, t.owner, t.confirmed FROM money t JOIN accounts a ON a.account_id = t.account_id
    WHERE t.approval = 'Approved' AND a.is_test = 0 AND {rng('t.confirmed')}""", "confirmed", "usd")
NOW = "TIMESTAMP '1999-01-16 00:00:00'"
SQL["R34_sync_status"] = out(f"""
    SELECT l.table_name, n.runs, n.last_success, l.status, l.rows, l.error,
           ROUND((EPOCH({NOW}) - EPOCH(DATE_TRUNC('second', l.ran_at))) / 3600.0, 1) AS age_hours,
           CASE WHEN l.status = 'success' AND (EPOCH({NOW}) - EPOCH(DATE_TRUNC('second', l.ran_at))) / 3600.0 <= 8 THEN 1 ELSE 0 END AS healthy
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name ORDER BY ran_at DESC, run_id DESC) AS rn FROM sync_log) l
    JOIN (SELECT table_name, COUNT(*) AS runs, MAX(CASE WHEN status = 'success' THEN ran_at END) AS last_success FROM sync_log GROUP BY 1) n
      ON n.table_name = l.table_name WHERE l.rn = 1""", "last_success")
SQL["O4_last_runs"] = out("""
    SELECT table_name, cutoff, rows, duration_ms, status, error, run_id, ran_at FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name ORDER BY ran_at DESC, run_id DESC) AS rn FROM sync_log) l WHERE rn <= 25""", "cutoff ran_at")
R37 = """
    SELECT day, COALESCE(ledger, 0) AS ledger, COALESCE(platform, 0) AS platform, COALESCE(platform_rows, 0) AS platform_rows,
           COALESCE(operations, 0) AS operations, COALESCE(operations_plain, 0) AS operations_plain, COALESCE(ledger, 0) - COALESCE(platform, 0) AS diff,
           CASE WHEN ABS(COALESCE(ledger, 0) - COALESCE(platform, 0)) > 50 THEN 1 ELSE 0 END AS flagged
    FROM (SELECT tx_date AS day, SUM(net_usd) AS ledger FROM kpis GROUP BY 1) a
    FULL JOIN (SELECT CAST(at AS DATE) AS day, COALESCE(SUM(net_deposit), 0) AS platform, COUNT(net_deposit) AS platform_rows
               FROM (SELECT e.at AS at, e.net_deposit FROM equity e) e2 GROUP BY 1) b USING (day)
    FULL JOIN (SELECT CAST(close_time AS DATE) AS day, SUM(profit) AS operations,
                      COALESCE(SUM(CASE WHEN comment IS NULL OR comment NOT IN ('Deposit Void', 'Withdrawal Void', 'FRF', 'Cash ADVANCE') THEN profit END), 0) AS operations_plain
               FROM balance_ops WHERE cmd = 6 GROUP BY 1) c USING (day)""".replace("CAST(at AS DATE)", "CAST(e2.at AS DATE)")
SQL["R37_net_by_source"] = out(R37, "day", "ledger platform operations operations_plain diff")
_RETENTION = f"""(SELECT CAST(t.confirmed AS DATE) AS day, SUM({NET}) AS ledger FROM money t JOIN accounts a ON a.account_id = t.account_id
    WHERE {VALID} AND {NOBONUS} AND a.is_test = 0 AND t.owner IN (SELECT u.agent_id FROM agents u WHERE u.dept = 'Retention') GROUP BY 1)"""
_KPIS = "(SELECT tx_date AS day, SUM(net_usd) AS ledger FROM kpis GROUP BY 1)"
SQL["R37_retention_net_by_source"] = out(R37.replace(_KPIS, _RETENTION), "day", "ledger platform operations operations_plain diff", "flagged")
SQL["R38_extra_logins"] = out(f"""
    SELECT source, COUNT(DISTINCT login) AS logins, COUNT(*) FILTER (WHERE {eq.NETEQ} > 0) AS with_equity,
           SUM(GREATEST({eq.NETEQ}, 0)) AS equity, COALESCE(SUM(net_deposit), 0) AS net_deposit
    FROM equity_days WHERE login NOT IN (SELECT login FROM {eq.EQL} e) GROUP BY 1""", "", "equity net_deposit")
SQL["R39_daily_leads"] = out("SELECT CAST(created AS DATE) AS day, COUNT(*) AS rows FROM accounts WHERE created IS NOT NULL GROUP BY 1", "day")
SQL["R39_daily_bonuses"] = out("SELECT CAST(confirmed AS DATE) AS day, COUNT(*) AS rows, SUM(amount) AS amount FROM bonuses GROUP BY 1", "day", "amount")
SQL["A15_month_gaps"] = out("""
    SELECT STRFTIME(confirmed, '%Y-%m') AS month, COUNT(*) AS source_rows, COUNT(*) FILTER (WHERE deleted = 0) AS local_rows,
           COUNT(*) - COUNT(*) FILTER (WHERE deleted = 0) AS missing FROM money GROUP BY 1""")
SQL["D10_incomplete_months"] = out(f"""
    SELECT * FROM (SELECT STRFTIME(t.confirmed, '%Y-%m') AS month, COUNT(*) AS source_rows, COUNT(*) FILTER (WHERE {OK}) AS local_rows,
                          CAST(DATE_TRUNC('month', MIN(t.confirmed)) AS DATE) AS date_from, LAST_DAY(MIN(t.confirmed)) AS date_to
                   FROM money t GROUP BY 1) x WHERE local_rows < source_rows""", "date_from date_to")
SQL["J20_key_diff"] = out(f"""
    SELECT DISTINCT login, 'missing' AS side FROM equity WHERE login NOT IN (SELECT login FROM {eq.GOOD} g)
    UNION ALL SELECT DISTINCT login, 'extra' FROM {eq.GOOD} g WHERE login NOT IN (SELECT login FROM equity)""")
SQL["Q16_missing_by_type"] = out(f"""
    SELECT t.type, t.approval, COUNT(*) AS rows, SUM(t.usd) AS usd FROM money t WHERE NOT ({NOBONUS}) GROUP BY 1, 2""", "", "usd")
SQL["Q16_duplicate_logins"] = out("""
    SELECT login, COUNT(*) AS rows FROM logins WHERE deleted = 0 OR deleted IS NULL GROUP BY 1 HAVING COUNT(*) > 1""")
SQL["Q16_corrupt_rows"] = out("SELECT e.at AS stamp, e.login, e.source, e.floating, e.balance FROM equity e WHERE ABS(e.floating) >= 100000000",
                              "stamp", "floating balance")
SQL["Q17_snapshot_consistency"] = out("""
    SELECT a.day, a.floating, a.delta, b.floating AS prev_floating, a.floating - a.delta AS implied_prev,
           ABS(a.floating - a.delta - COALESCE(b.floating, 0)) AS gap,
           CASE WHEN ABS(a.floating - a.delta - COALESCE(b.floating, 0)) <= 1 THEN 1 ELSE 0 END AS consistent
    FROM (SELECT CAST(e.at AS DATE) AS day, SUM(floating) AS floating, SUM(delta_floating) AS delta FROM equity e GROUP BY 1) a
    LEFT JOIN (SELECT CAST(e.at AS DATE) AS day, SUM(floating) AS floating FROM equity e GROUP BY 1) b ON b.day = a.day - 1""", "day",
    "floating delta prev_floating implied_prev gap")
SQL["Q12_cross_source"] = out(f"""
    SELECT 'Sync' AS report, 'payments' AS section, c AS check_name, 'Grand Total' AS context, ROUND(ABS(e - a), 4) AS diff, ROUND(ABS(e - a) / ABS(e), 6) AS pct_diff,
           CASE WHEN ABS(e - a) / ABS(e) <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT 'rows' AS c, CAST(COUNT(*) AS DOUBLE) AS e, CAST(COUNT(*) FILTER (WHERE {NOBONUS}) AS DOUBLE) AS a FROM money t WHERE {VALID}
          UNION ALL SELECT 'sum_usd', CAST(SUM(t.usd) AS DOUBLE), CAST(SUM(t.usd) FILTER (WHERE {NOBONUS}) AS DOUBLE) FROM money t WHERE {VALID}) x""")
PAIRS = f"""(SELECT agent_id, CAST(COALESCE(l.net, 0) AS DOUBLE) AS e, CAST(COALESCE(r.net, 0) AS DOUBLE) AS a
    FROM (SELECT agent_id, SUM(net_usd) AS net FROM kpis WHERE agent_id IS NOT NULL GROUP BY 1) l FULL JOIN (
        SELECT t.owner AS agent_id, SUM({NET}) AS net FROM money t JOIN accounts a ON a.account_id = t.account_id LEFT JOIN agents u ON u.agent_id = t.owner
        WHERE {VALID} AND {NOBONUS} AND a.is_test = 0 AND t.owner IS NOT NULL AND TRIM(COALESCE(u.agent_name, u.full_name, '')) NOT ILIKE 'test%' GROUP BY 1) r USING (agent_id)
    UNION ALL SELECT NULL, (SELECT CAST(SUM(net_usd) AS DOUBLE) FROM kpis WHERE agent_id IS NULL), 0
    UNION ALL SELECT NULL, 0, (SELECT CAST(SUM({NET}) AS DOUBLE) FROM money t JOIN accounts a ON a.account_id = t.account_id
        WHERE {VALID} AND {NOBONUS} AND a.is_test = 0 AND t.owner IS NULL))"""
MATCH = "COALESCE(CASE WHEN e = 0 THEN ABS(e - a) <= 0.01 ELSE ABS(e - a) / ABS(e) <= 0.01 END, FALSE)"
SQL["Q13_per_agent"] = out(f"""
    SELECT 'Sync' AS report, 'per_agent' AS section, 'net_summary' AS check_name, 'All agents' AS context, 0.0 AS diff, 0.0 AS pct_diff,
           CASE WHEN CAST(COUNT(*) FILTER (WHERE {MATCH}) AS DOUBLE) / COUNT(*) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS status,
           CAST(COUNT(*) FILTER (WHERE {MATCH}) AS STRING) || ' of ' || CAST(COUNT(*) AS STRING) || ' agents match' AS message
    FROM {PAIRS} p WHERE ABS(e) >= 1 OR ABS(a) >= 1
    UNION ALL SELECT * FROM (SELECT 'Sync', 'per_agent', 'net_mismatch', CAST(agent_id AS STRING), ROUND(ABS(e - a), 4),
        COALESCE(ROUND(CASE WHEN e <> 0 THEN ABS(e - a) / ABS(e) END, 6), 0), 'WARN', 'sources differ'
        FROM {PAIRS} p WHERE (ABS(e) >= 1 OR ABS(a) >= 1) AND NOT {MATCH} ORDER BY ABS(a - e) DESC, agent_id NULLS FIRST LIMIT 20) z""", "", "diff pct_diff")
