"""Shared pieces of the comparison SQL: adapter views and derived tables as common table expressions."""

from __future__ import annotations

import re

from ledgerlight.sources.driver_tables import VIEWS, view_sql

FIRST, LAST, LIVE = "1995-01-01", "2001-07-31", "1999-01-10"

IN = "('Deposit', 'Withdrawal Cancelled')"
OUT = "('Withdrawal', 'Deposit Cancelled')"
ALL = "('Deposit', 'Withdrawal Cancelled', 'Withdrawal', 'Deposit Cancelled')"
NET = f"CASE WHEN t.type IN {IN} THEN t.usd WHEN t.type IN {OUT} THEN -t.usd END"
DEP = f"CASE WHEN t.type IN {IN} THEN t.usd ELSE 0 END"
WDR = f"CASE WHEN t.type IN {OUT} THEN t.usd ELSE 0 END"
OK = "t.approval = 'Approved' AND (t.deleted = 0 OR t.deleted IS NULL)"
VALID = f"{OK} AND t.type IN {ALL} AND t.account_id IS NOT NULL"
NOBONUS = "LOWER(COALESCE(t.comment, '')) NOT LIKE '%bonus%'"
LIVEACC = "a.is_test = 0 AND (a.is_demo = 0 OR a.is_demo IS NULL)"
LABEL = "TRIM(COALESCE(u.agent_name, u.full_name, ''))"
FULL = "TRIM(COALESCE(u.full_name, ''))"
NOTEST = f"{LABEL} NOT ILIKE 'test%' AND {FULL} NOT ILIKE 'test%'"
COUNTABLE = f"{NOTEST} AND {LABEL} NOT ILIKE 'duplicated%'"
NODEPT = " AND ".join(f"TRIM(COALESCE(u.department, '')) NOT ILIKE '%{w}%'"
                      for w in ("Retention", "Conversion", "Support", "General"))


def rng(col: str, first: str = FIRST, last: str = LAST) -> str:
    return f"{col} >= DATE '{first}' AND {col} < DATE '{last}' + INTERVAL '1' DAY"


def age(birth: str, on: str) -> str:
    return f"DATE_PART('year', AGE(CAST({on} AS TIMESTAMP), CAST({birth} AS TIMESTAMP)))"


def score(on: str) -> str:
    y = age("a.birth_date", on)
    return (f"CASE WHEN a.score IS NOT NULL AND a.score > 0 THEN a.score WHEN a.birth_date IS NOT NULL THEN "
            f"CASE WHEN {y} BETWEEN 25 AND 29 THEN 4 WHEN {y} BETWEEN 30 AND 34 THEN 5 "
            f"WHEN {y} BETWEEN 35 AND 44 THEN 6 WHEN {y} >= 45 THEN 7 END END")


def eez(bal: str, flt: str, bonus: str) -> str:
    net = f"COALESCE({bal}, 0) + COALESCE({flt}, 0)"
    return (f"CAST(ROUND(CASE WHEN {net} <= 0 THEN 0 ELSE GREATEST({net} - COALESCE({bonus}, 0), 0) END, 2) "
            f"AS DECIMAL(18, 2))")


DERIVED: dict[str, str] = {
    "kpis": f"""
        SELECT t.owner AS agent_id, CAST(t.confirmed AS DATE) AS tx_date, CAST(a.qualified AS DATE) AS qual_date,
               COALESCE(SUM({NET}), 0) AS net_usd, SUM({DEP}) AS deposit_usd, SUM({WDR}) AS withdrawal_usd,
               SUM(CASE WHEN t.type = 'Deposit' AND t.ftd = 1 THEN 1 ELSE 0 END) AS ftd_count,
               COUNT(DISTINCT CASE WHEN t.type = 'Deposit' AND t.ftd = 1 THEN t.account_id END) AS ftc_count,
               SUM(CASE WHEN t.type = 'Deposit' AND t.ftd = 1 THEN t.usd ELSE 0 END) AS ftd_usd
        FROM money t JOIN accounts a ON a.account_id = t.account_id LEFT JOIN agents u ON u.agent_id = t.owner
        WHERE {VALID} AND a.is_test = 0 AND {LABEL} NOT ILIKE 'test%'
        GROUP BY 1, 2, 3""",
    "logins": """
        SELECT TRY_CAST(b.login AS BIGINT) AS login, b.account_id, b.deleted, b.equity
        FROM bridge b WHERE b.account_id IS NOT NULL AND TRY_CAST(b.login AS BIGINT) IS NOT NULL""",
    "resolved": """
        SELECT ex.login, en.open_time, ex.notional
        FROM deals ex JOIN deals en ON en.position_id = ex.position_id AND en.source = ex.source AND en.entry = 0
        WHERE ex.entry = 1 AND ex.close_time > TIMESTAMP '1971-01-01 00:00:00'""",
    "volume": f"""
        SELECT a.assigned_to AS agent_id, l.account_id, CAST(x.open_time AS DATE) AS open_date,
               SUM(x.notional) AS notional_usd, MAX(CASE WHEN x.notional > 0 THEN 1 ELSE 0 END) AS has_positive_notional
        FROM (SELECT login, open_time, notional FROM positions
              UNION ALL SELECT login, open_time, notional FROM resolved) x
        JOIN logins l ON l.login = x.login JOIN accounts a ON a.account_id = l.account_id
        LEFT JOIN agents u ON u.agent_id = a.assigned_to
        WHERE a.is_test = 0 AND {LABEL} NOT ILIKE 'test%'
        GROUP BY 1, 2, 3""",
    "traders": """
        SELECT DISTINCT open_date AS day, account_id, agent_id FROM volume WHERE has_positive_notional = 1""",
    "ordered_money": f"""
        SELECT t.account_id, t.confirmed, t.money_id, t.owner,
               SUM({NET}) OVER (PARTITION BY t.account_id ORDER BY t.confirmed, t.money_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
               ROW_NUMBER() OVER (PARTITION BY t.account_id ORDER BY t.confirmed DESC, t.money_id DESC) AS rn
        FROM money t JOIN accounts a ON a.account_id = t.account_id WHERE {VALID} AND a.is_test = 0""",
    "cutoffs": """
        SELECT a.account_id, a.account_status, a.qualified, a.assigned_to,
               CASE WHEN a.qualified IS NULL THEN NULL WHEN x.ftd IS NULL THEN a.qualified
                    ELSE GREATEST(a.qualified, x.ftd) END AS cutoff
        FROM accounts a JOIN (SELECT account_id, MIN(CASE WHEN running >= 95 THEN confirmed END) AS ftd
                              FROM ordered_money GROUP BY account_id) x ON x.account_id = a.account_id""",
    "clients": """
        SELECT c.account_id, c.account_status, c.qualified, c.assigned_to,
               CASE WHEN c.account_status = 'Sales' THEN l.confirmed ELSE k.confirmed END AS reached_at,
               CAST(CASE WHEN c.account_status = 'Sales' THEN l.running ELSE k.running END AS DECIMAL(18, 2)) AS reached_amount,
               CASE WHEN c.account_status = 'Sales' THEN l.owner ELSE k.owner END AS owner,
               CAST(l.running AS DECIMAL(18, 2)) AS net_now,
               CAST(CASE WHEN c.account_status = 'Sales' OR c.qualified IS NULL THEN l.running ELSE k.running END
                    AS DECIMAL(18, 2)) AS net_until_qualified
        FROM cutoffs c JOIN ordered_money l ON l.account_id = c.account_id AND l.rn = 1
        LEFT JOIN (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o.account_id ORDER BY o.confirmed DESC, o.money_id DESC) AS k
                   FROM ordered_money o JOIN cutoffs c ON c.account_id = o.account_id
                   WHERE o.confirmed <= c.cutoff) k ON k.account_id = c.account_id AND k.k = 1
        WHERE (c.account_status = 'Sales' AND l.running >= 95) OR (c.account_status <> 'Sales' AND k.running >= 95)""",
    "sales_bonus": """
        SELECT owner AS agent_id, reached_at, COUNT(DISTINCT account_id) AS ftd100_count,
               COUNT(DISTINCT CASE WHEN reached_amount >= 240 THEN account_id END) AS ftd100_full_count,
               COUNT(DISTINCT CASE WHEN reached_amount < 240 THEN account_id END) AS ftd100_half_count,
               COALESCE(SUM(net_until_qualified), 0) AS total_sales_net,
               SUM(CASE WHEN reached_amount < 500 THEN 0 WHEN reached_amount < 1000 THEN 10
                        WHEN reached_amount < 5000 THEN 20 ELSE 50 END) AS ftd_amount_bonus
        FROM clients WHERE owner IS NOT NULL GROUP BY 1, 2""",
    "run_rate": f"""
        SELECT CASE WHEN u.dept = 'Sales' AND u.team = 'Conversion' AND {LABEL} NOT ILIKE 'duplicated%'
                         AND {FULL} NOT ILIKE 'test%' THEN 'sales'
                    WHEN u.dept = 'Retention' AND {LABEL} NOT ILIKE 'duplicated%' AND {FULL} NOT ILIKE 'test%'
                         AND {NODEPT} THEN 'retention' ELSE 'other' END AS dept_group,
               k.tx_date, k.qual_date, SUM(k.net_usd) AS net_usd, SUM(k.deposit_usd) AS deposit_usd,
               SUM(k.ftd_count) AS ftd_count, SUM(k.ftc_count) AS ftc_count
        FROM kpis k JOIN agents u ON u.agent_id = k.agent_id GROUP BY 1, 2, 3
        UNION ALL
        SELECT 'all', tx_date, qual_date, SUM(net_usd), SUM(deposit_usd), SUM(ftd_count), SUM(ftc_count)
        FROM kpis GROUP BY 2, 3""",
    "std": f"""
        SELECT f.account_id, CASE WHEN s.at IS NOT NULL THEN 1 ELSE 0 END AS has_second_deposit,
               s.at AS second_deposit_at, a.assigned_to AS agent_id
        FROM (SELECT account_id, MIN(confirmed) AS at FROM (
                  SELECT t.account_id, t.confirmed,
                         SUM(t.usd) OVER (PARTITION BY t.account_id ORDER BY t.confirmed, t.money_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
                  FROM money t JOIN accounts a ON a.account_id = t.account_id
                  WHERE {OK} AND t.type IN {IN} AND a.is_test = 0) r
              WHERE running >= 240 GROUP BY 1) f
        JOIN accounts a ON a.account_id = f.account_id
        LEFT JOIN (SELECT f2.account_id, MIN(t.confirmed) AS at
                   FROM (SELECT account_id, MIN(confirmed) AS at FROM (
                             SELECT t.account_id, t.confirmed,
                                    SUM(t.usd) OVER (PARTITION BY t.account_id ORDER BY t.confirmed, t.money_id
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
                             FROM money t WHERE {OK} AND t.type IN {IN}) r
                         WHERE running >= 240 GROUP BY 1) f2
                   JOIN money t ON t.account_id = f2.account_id AND t.confirmed > f2.at AND {OK} AND t.type IN {IN}
                   GROUP BY 1) s ON s.account_id = f.account_id""",
    "test_logins": """
        SELECT l.login, MAX(a.is_test) AS is_test FROM logins l JOIN accounts a ON a.account_id = l.account_id
        WHERE l.deleted = 0 OR l.deleted IS NULL GROUP BY 1""",
    "equity_days": """
        SELECT * FROM (SELECT e.*, CAST(e.at AS DATE) AS day,
                              ROW_NUMBER() OVER (PARTITION BY login, CAST(e.at AS DATE) ORDER BY e.at DESC, e.source DESC) AS rn
                       FROM equity e) x WHERE rn = 1""",
    "eez_days": f"""
        SELECT d.login, d.day, {eez('d.balance', 'd.floating', 'b.bonus')} AS eez
        FROM equity_days d JOIN test_logins tl ON tl.login = d.login AND tl.is_test = 0
        LEFT JOIN (SELECT d2.login, d2.day, SUM(b.amount) AS bonus FROM equity_days d2
                   JOIN bonuses b ON b.login = d2.login AND CAST(b.confirmed AS DATE) <= d2.day GROUP BY 1, 2) b
               ON b.login = d.login AND b.day = d.day""",
    "snap": """
        SELECT e.login, e.day, e.eez AS end_eez, p.eez AS start_eez
        FROM eez_days e LEFT JOIN eez_days p ON p.login = e.login AND p.day = e.day - 1""",
    "holidays": """
        SELECT CAST(MAKE_DATE(CAST(y AS INTEGER), m, d) AS DATE) AS holiday
        FROM RANGE(1994, 2003) r(y), (VALUES (1, 1), (12, 24), (12, 25), (12, 26), (12, 31)) v(m, d)""",
}

_ALL = {**{n: view_sql(n) for n in VIEWS}, **DERIVED}
_ORDER = list(_ALL)
_NEEDS = {n: {k for k in _ORDER if k != n and re.search(rf"\b(?:FROM|JOIN)\s+{k}\b", t)} for n, t in _ALL.items()}


def with_ctes(body: str) -> str:
    """The statement with every table expression it reads, directly or indirectly, put in front."""
    wanted: set[str] = set()
    todo = [k for k in _ORDER if re.search(rf"\b{k}\b", body)]
    while todo:
        k = todo.pop()
        if k not in wanted:
            wanted.add(k)
            todo += list(_NEEDS[k])
    parts = [f"{k} AS ({_ALL[k]})" for k in _ORDER if k in wanted]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def out(body: str, text: str = "", num: str = "", whole: str = "") -> str:
    """Statement with comparable output types: dates as text, money as double, counts as bigint."""
    casts = ([f"CAST({c} AS STRING) AS {c}" for c in text.split()]
             + [f"CAST({c} AS DOUBLE) AS {c}" for c in num.split()]
             + [f"CAST({c} AS BIGINT) AS {c}" for c in whole.split()])
    replace = f" REPLACE ({', '.join(casts)})" if casts else ""
    return with_ctes(f"SELECT *{replace} FROM ({body}) q")
