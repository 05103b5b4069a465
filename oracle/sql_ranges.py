"""Comparison SQL of queries that split keys and ranges: the same results over whole keys."""

from __future__ import annotations

from itertools import combinations

from oracle import sql_equity as eq, sql_reports as rp
from oracle.base import NET, NOBONUS, OK, VALID, out
from oracle.sql_operators import GROUPS, TYPED, eet

SQL: dict[str, str] = {}
#: query that works in pieces -> query whose SQL gives the same rows
SAME = {"D1_threshold_clients_by_pieces": "D1_threshold_clients", "V6_second_deposits_by_pieces": "V6_second_deposit_clients",
        "D4_snapshots_by_ranges": "D3_equity_snapshots"}

_BOOK = f"""(SELECT t.money_id, t.confirmed, SUM({NET}) OVER (ORDER BY t.confirmed, t.money_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
    FROM money t WHERE {VALID} AND t.confirmed IS NOT NULL)"""
SQL["W1_book_running_total"] = out(f"SELECT money_id, running FROM {_BOOK} x", "", "running")
SQL["A12_book_crossing"] = out(f"""
    SELECT k.mark, MIN(x.confirmed) AS crossed_at FROM {_BOOK} x JOIN (VALUES (1000), (20000), (100000)) k(mark) ON x.running >= k.mark GROUP BY 1""",
    "crossed_at", "", "mark")
SQL["W6_row_numbers"] = out("SELECT money_id, ROW_NUMBER() OVER (ORDER BY confirmed NULLS LAST, money_id) AS place FROM money")

_PERIODS = f"""(SELECT agent_id, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS days, SUM(net) AS net_usd FROM (
        SELECT *, SUM(begins) OVER (PARTITION BY agent_id ORDER BY day) AS run FROM (
            SELECT *, CASE WHEN day - LAG(day) OVER (PARTITION BY agent_id ORDER BY day) <= 20 THEN 0 ELSE 1 END AS begins FROM (
                SELECT t.owner AS agent_id, CAST(t.confirmed AS DATE) AS day, SUM({NET}) AS net FROM money t
                WHERE {VALID} AND t.owner IS NOT NULL AND t.confirmed IS NOT NULL GROUP BY 1, 2) d) g) r GROUP BY agent_id, run)"""
SQL["J10_activity_in_departments"] = out(f"""
    SELECT h.agent_id, h.report_dept, h.valid_from, h.valid_to, p.first_day, p.last_day, p.days, p.net_usd,
           GREATEST(h.valid_from, p.first_day) AS overlap_from, CASE WHEN h.valid_to IS NULL THEN p.last_day ELSE LEAST(h.valid_to, p.last_day) END AS overlap_to
    FROM dept_history h JOIN {_PERIODS} p ON p.agent_id = h.agent_id AND h.valid_from <= p.last_day AND (h.valid_to IS NULL OR p.first_day <= h.valid_to)""",
    "valid_from valid_to first_day last_day overlap_from overlap_to", "net_usd")
SQL["J10_net_by_department"] = out(f"""
    SELECT h.report_dept, COUNT(*) AS agent_days, SUM(x.net) AS net_usd
    FROM (SELECT t.owner AS agent_id, CAST(t.confirmed AS DATE) AS day, SUM({NET}) AS net FROM money t WHERE {VALID} AND t.confirmed IS NOT NULL GROUP BY 1, 2) x
    JOIN dept_history h ON h.agent_id = x.agent_id AND x.day >= h.valid_from AND (h.valid_to IS NULL OR x.day <= h.valid_to) GROUP BY 1""", "", "net_usd")
SQL["M19_ranged_retyping"] = out(f"SELECT money_id, type FROM {TYPED} x")

_COPY = """(SELECT money_id, CASE WHEN CAST(confirmed AS DATE) = DATE '1998-03-10' THEN 'Stale' ELSE approval END AS approval, usd FROM money WHERE NOT money_id BETWEEN 700 AND 749
    UNION ALL SELECT -money_id - 1, approval, usd FROM money WHERE money_id < 300 AND type = 'Withdrawal')"""
_DIFFERENT = f"""
    SELECT COALESCE(c.money_id, t.money_id) AS money_id, CASE WHEN c.money_id IS NULL THEN 'insert' WHEN t.money_id IS NULL THEN 'delete' ELSE 'update' END AS operation,
           c.approval AS old_approval, t.approval AS new_approval, COALESCE(t.usd, c.usd) AS usd
    FROM {_COPY} c FULL JOIN money t ON t.money_id = c.money_id
    WHERE c.money_id IS NULL OR t.money_id IS NULL OR c.approval IS DISTINCT FROM t.approval"""
SQL["J20_tree_differences"] = out(_DIFFERENT, "", "usd")
SQL["D10_tree_resync"] = out(f"SELECT * FROM ({_DIFFERENT}) x WHERE operation <> 'insert'", "", "usd")

_BONUS = f"""SELECT t.money_id, TRY_CAST(t.login AS BIGINT) AS login, CASE WHEN t.raw_type = 'Deposit' THEN t.usd ELSE -t.usd END AS amount, t.confirmed FROM money t
    WHERE {OK} AND ((t.raw_type = 'Deposit' AND t.type IN ('FRF Commission', 'Bonus')) OR (t.raw_type = 'Withdrawal' AND t.type IN ('FRF Commission Cancelled', 'BonusCancelled')))"""
SQL["S16_bonus_ledger_lookback"] = out(f"{_BONUS} AND (t.modified >= DATE '1998-06-01' OR t.confirmed >= DATE '1998-06-01')", "confirmed", "amount")
SQL["S16_bonus_ledger_after_id"] = out(f"{_BONUS} AND t.money_id > 5000", "confirmed", "amount")
_TRADES = f"SELECT ticket, source, login, symbol, notional FROM deals d WHERE cmd IN (0, 1) AND {eq.TRADE}"
_STORED = "(ticket, source) NOT IN (SELECT (s.ticket, s.source) FROM deals s WHERE s.{} < DATE '1996-01-01')"
SQL["S20_trades_full"] = out(_TRADES, "", "notional")
SQL["S20_trades_missing"] = out(f"{_TRADES} AND {_STORED.format('open_time')}", "", "notional")
SQL["S20_trades_open"] = out(f"{_TRADES} AND (close_time IS NULL OR close_time <= DATE '1971-01-01')", "", "notional")
_UTC = f"""SELECT ticket, source, {eet('open_time')} AS open_time, {eet('close_time')} AS close_time FROM deals d WHERE cmd IN (0, 1) AND {eq.TRADE}"""
SQL["S22_deals_utc_full"] = out(_UTC, "open_time close_time")
SQL["S22_deals_utc_missing"] = out(f"{_UTC} AND {_STORED.format('sync_time')}", "open_time close_time")
SQL["S26_ids_from_text"] = out("""
    SELECT e.login, e.source, CAST(e.at AS DATE) AS day, e.balance FROM equity e
    WHERE e.login IN (SELECT TRY_CAST(TRIM(b.login) AS BIGINT) FROM bridge b WHERE b.deleted = 0 OR b.deleted IS NULL)""", "day", "balance")
SQL["S26_sheet_totals"] = out("SELECT agent_id, SUM(net_usd) AS net_usd FROM kpis GROUP BY 1", "", "net_usd")


def _day_score(tolerance: float, day: str) -> str:
    return f"""SELECT DATE '{day}' AS day, COUNT(*) AS total, COUNT(*) FILTER (WHERE ok) AS pass, 0 AS warn, COUNT(*) FILTER (WHERE NOT ok) AS fail, 0 AS error,
        ROUND(CAST(COUNT(*) FILTER (WHERE ok) AS DOUBLE) / COUNT(*) * 100, 2) AS score FROM (SELECT ABS(e - a) / ABS(e) <= {tolerance} AS ok
            FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS e, CAST(COUNT(*) FILTER (WHERE {NOBONUS}) AS DOUBLE) AS a FROM money t WHERE {VALID}
                  UNION ALL SELECT CAST(SUM(t.usd) AS DOUBLE), CAST(SUM(t.usd) FILTER (WHERE {NOBONUS}) AS DOUBLE) FROM money t WHERE {VALID}) x) y"""


SQL["Q15_score_trend"] = out(f"""
    SELECT *, ROUND(score - LAG(score) OVER (ORDER BY day), 2) AS change FROM ({_day_score(0.0, '1999-01-08')} UNION ALL {_day_score(1.0, '1999-01-09')}) h""", "day")

_SUMMED = "leads live_accounts ftc ftd deposits withdrawals traders rdp_count rdp_net volume_usd".split()
_SETS = [(), *((g,) for g in GROUPS), *combinations(GROUPS, 2)]
_CASES = " ".join(f"WHEN GROUPING({', '.join(GROUPS)}) = {int(''.join('0' if g in s else '1' for g in GROUPS), 2)} THEN ({{}})".replace("{}", "{" + str(i) + "}") for i, s in enumerate(_SETS))


def _by_set(pick) -> str:
    return "CASE " + _CASES.format(*map(pick, _SETS)) + " END"


SQL["R8_all_groupings"] = out(rp.rates(f"""
    SELECT {_by_set(lambda s: "'" + ",".join(s) + "'")} AS "grouping", {_by_set(lambda s: s[0] if s else "NULL")} AS g1, {_by_set(lambda s: s[1] if len(s) > 1 else "NULL")} AS g2,
           {', '.join(f'SUM({c}) AS {c}' for c in _SUMMED)},
           ROUND(CAST(SUM(live_avg_score * live_accounts) AS DOUBLE) / NULLIF(SUM(CASE WHEN live_avg_score IS NOT NULL THEN live_accounts END), 0), 1) AS live_avg_score,
           ROUND(CAST(SUM(ftd_avg_score * ftd) AS DOUBLE) / NULLIF(SUM(CASE WHEN ftd_avg_score IS NOT NULL THEN ftd END), 0), 1) AS ftd_avg_score
    FROM (SELECT x.* EXCLUDE (g1), {', '.join(f"COALESCE({e}, '(Unassigned)') AS {g}" for g, e in GROUPS.items())}
          FROM ({rp.table('CAST(a.account_id AS STRING)', None, None)}) x JOIN accounts a ON CAST(a.account_id AS STRING) = x.g1 {rp.CAMP}
          LEFT JOIN agents cu ON cu.agent_id = a.assigned_to) y
    GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in _SETS)})"""), "", "deposits withdrawals rdp_net volume_usd net_deposits")
