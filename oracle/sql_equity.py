"""Comparison SQL of the equity and regulatory reports."""

from __future__ import annotations

from oracle.base import (IN, LIVE, NET, NOBONUS, OK, OUT, VALID, age, eez, out, rng)

SQL: dict[str, str] = {}

BOOK = ("Cashback CFDRollover CommEUR CommUSD CorrectiEUR CorrectiGBP CorrectiJPY Correction CredExp CredExpEUR CredExpGBP "
        "CredExpJPY Dividend DividendEUR DividendGBP DividendJPY Dormant EarnedCr EarnedCrEUR FEE INACT-FEE Inactivity Rollover "
        "SPREAD ZeroingEUR ZeroingGBP ZeroingJPY ZeroingKES ZeroingNGN ZeroingUSD ZeroingZAR").split()
TRADE = "symbol NOT IN (" + ", ".join(f"'{s}'" for s in BOOK) + ")"
NETEQ = "COALESCE(balance, 0) + COALESCE(floating, 0)"


def newest(where: str, src: str = "equity") -> str:
    return (f"(SELECT * FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY e.login ORDER BY e.at DESC, e.source DESC) AS rn "
            f"FROM {src} e WHERE {where}) r WHERE rn = 1)")


def bonus(where: str) -> str:
    return f"(SELECT login, SUM(amount) AS bonus FROM bonuses WHERE {where} GROUP BY 1)"


AFTER = f"DATE '{LIVE}' + INTERVAL '1' DAY"
MONTH = f"DATE_TRUNC('month', DATE '{LIVE}')"
LASTDAY = "(SELECT MAX(day) FROM snap)"

SQL["R19_eez_comparison"] = out(f"""
    SELECT e.login, COALESCE(e.end_eez, 0) AS end_equity_zeroed, COALESCE(s.s, 0) AS start_equity_zeroed, e.day AS snapshot_date
    FROM snap e JOIN test_logins tl ON tl.login = e.login AND tl.is_test = 0
    LEFT JOIN (SELECT q.login, {eez('q.balance', 'q.floating', 'b.bonus')} AS s
               FROM {newest(f"CAST(e.at AS DATE) < DATE_TRUNC('month', {LASTDAY})")} q
               LEFT JOIN {bonus(f"CAST(confirmed AS DATE) < DATE_TRUNC('month', {LASTDAY})")} b ON b.login = q.login) s ON s.login = e.login
    WHERE e.day = {LASTDAY}""", "snapshot_date", "end_equity_zeroed start_equity_zeroed")
SQL["R20_eez_month"] = out(f"""
    SELECT d.login, COALESCE(tf.is_test, 0) AS is_test,
           ROUND(GREATEST(GREATEST(0, COALESCE(d.balance, 0) + COALESCE(d.floating, 0)) - GREATEST(0, COALESCE(b.bonus, 0)), 0), 2) AS eez,
           ROUND(COALESCE(st.e, 0), 2) AS daily_start_equity, ROUND(COALESCE(st.n, 0), 2) AS daily_start_net_equity
    FROM {newest(f"e.at >= {MONTH} AND e.at < {MONTH} + INTERVAL '1' MONTH")} d
    LEFT JOIN {bonus(f"confirmed < {AFTER}")} b ON b.login = d.login
    LEFT JOIN (SELECT l.login, MAX(a.is_test) AS is_test FROM logins l JOIN accounts a ON a.account_id = l.account_id GROUP BY 1) tf ON tf.login = d.login
    LEFT JOIN (SELECT login, GREATEST(0, COALESCE(equity, 0)) AS e, GREATEST(0, {NETEQ}) AS n
               FROM {newest(f"CAST(e.at AS DATE) = (SELECT MAX(CAST(z.at AS DATE)) FROM equity z WHERE z.at < {MONTH})")} q) st ON st.login = d.login""",
    "", "eez daily_start_equity daily_start_net_equity")
GOOD = "(SELECT l.login FROM logins l JOIN accounts a ON a.account_id = l.account_id AND a.is_test = 0 WHERE l.deleted = 0 OR l.deleted IS NULL)"


def historical(logins: str) -> str:
    return f"""SELECT * FROM (
        SELECT COALESCE(SUM({eez('d.balance', 'd.floating', 'b.bonus')}), 0) AS total_eez
        FROM {logins} t JOIN {newest(f"e.at < {AFTER}")} d ON d.login = t.login LEFT JOIN {bonus(f"confirmed < {AFTER}")} b ON b.login = t.login) x,
        (SELECT COALESCE(SUM(end_eez), 0) AS start_eez FROM snap WHERE day = DATE '{LIVE}' - 1
           AND login IN (SELECT login FROM logins WHERE deleted = 0 OR deleted IS NULL)) y"""


SQL["R21_historical_total"] = out(historical(f"(SELECT DISTINCT login FROM {GOOD} g)"), "", "total_eez start_eez")
SQL["R21_historical_total_repeated_rows"] = out(historical(GOOD), "", "total_eez start_eez")
SQL["R23_month_end_total"] = out(f"""
    SELECT COALESCE(SUM({eez('d.balance', 'd.floating', 'b.bonus')}), 0) AS end_equity_zeroed
    FROM {newest(f"e.at >= {MONTH} AND e.at < {MONTH} + INTERVAL '1' MONTH")} d
    JOIN (SELECT DISTINCT l.login FROM logins l JOIN accounts a ON a.account_id = l.account_id JOIN agents u ON u.agent_id = a.assigned_to
          WHERE a.is_test = 0 AND (l.deleted = 0 OR l.deleted IS NULL)) t ON t.login = d.login
    LEFT JOIN {bonus(f"confirmed < {AFTER}")} b ON b.login = d.login""", "", "end_equity_zeroed")

RESULT = "SUM(COALESCE(commission, 0) + COALESCE(profit, 0) + COALESCE(swap, 0))"
EQL = "(SELECT DISTINCT l.login FROM logins l JOIN accounts a ON a.account_id = l.account_id WHERE l.equity > 0 AND (l.deleted = 0 OR l.deleted IS NULL) AND a.is_test = 0)"
FLOAT = f"(SELECT login, {RESULT} AS f FROM positions WHERE cmd < 2 AND {TRADE} GROUP BY 1)"
BAL = """(SELECT * FROM (SELECT login, COALESCE(balance, 0) AS bal, COALESCE(credit, 0) AS cr, ROW_NUMBER() OVER (PARTITION BY login ORDER BY updated DESC, source DESC) AS rn
          FROM platform_users) z WHERE rn = 1)"""
CLOSED = f"(SELECT login, {RESULT} AS c FROM deals WHERE entry = 1 AND cmd < 2 AND {TRADE} AND {rng('close_time', LIVE, LIVE)} GROUP BY 1)"
YDAY = newest(f"e.at >= DATE '{LIVE}' - INTERVAL '1' DAY AND e.at < DATE '{LIVE}'")
SQL["R22_live_equity"] = out(f"""
    SELECT *, current_floating - eod_floating_yesterday + closed_pnl_today AS daily_pnl, start_eez - total_eez - net_deposits AS pnl_cash,
           end_net_equity - start_net_equity - net_deposits - bonuses_today AS daily_pnl_cash
    FROM (SELECT * FROM
      (SELECT COALESCE(SUM(GREATEST(0, b.bal + COALESCE(f.f, 0) - GREATEST(0, COALESCE(o.bonus, 0)))), 0) AS total_eez,
              COALESCE(SUM(GREATEST(0, b.bal + COALESCE(f.f, 0))), 0) AS end_net_equity
       FROM {EQL} e JOIN {BAL} b ON b.login = e.login LEFT JOIN {FLOAT} f ON f.login = e.login LEFT JOIN {bonus(f"confirmed < {AFTER}")} o ON o.login = e.login) a,
      (SELECT COALESCE(SUM(f.f), 0) AS current_floating FROM {EQL} e JOIN {FLOAT} f ON f.login = e.login) b,
      (SELECT COALESCE(SUM(COALESCE(d.floating, 0)), 0) AS eod_floating_yesterday FROM {EQL} e JOIN {FLOAT} f ON f.login = e.login JOIN {YDAY} d ON d.login = e.login) c,
      (SELECT COALESCE(SUM(x.c), 0) AS closed_pnl_today FROM {EQL} e JOIN {CLOSED} x ON x.login = e.login) d,
      (SELECT COALESCE(SUM(GREATEST(0, COALESCE(d.balance, 0) + COALESCE(d.floating, 0))), 0) AS start_net_equity FROM {EQL} e JOIN {YDAY} d ON d.login = e.login) g,
      (SELECT COALESCE(SUM(end_eez), 0) AS start_eez FROM snap WHERE day = DATE '{LIVE}' - 1 AND login IN (SELECT login FROM {GOOD} w)) h,
      (SELECT COALESCE(SUM(net_usd), 0) AS net_deposits FROM kpis WHERE tx_date = DATE '{LIVE}') i,
      (SELECT COALESCE(SUM(amount), 0) AS bonuses_today FROM bonuses WHERE {rng('confirmed', LIVE, LIVE)}) j) q""", "",
    "total_eez end_net_equity current_floating eod_floating_yesterday closed_pnl_today start_net_equity start_eez net_deposits bonuses_today "
    "daily_pnl pnl_cash daily_pnl_cash")

BRIDGE = f"""
    SELECT login, start_eez, net_dep, daily_pnl, live_eez, start_eez + net_dep + daily_pnl AS formula, live_eez - (start_eez + net_dep + daily_pnl) AS gap,
           CASE WHEN start_eez > 0 AND live_eez > 0 THEN 'A' WHEN start_eez <= 0 AND live_eez > 0 THEN 'B' WHEN start_eez > 0 THEN 'C' ELSE 'D' END AS category
    FROM (SELECT login, COALESCE(s, 0) AS start_eez, COALESCE(n, 0) AS net_dep, COALESCE(f, 0) - COALESCE(y, 0) + COALESCE(c, 0) AS daily_pnl,
                 GREATEST(0, COALESCE(bal, 0) + COALESCE(f, 0) - COALESCE(cr, 0) - GREATEST(0, COALESCE(bn, 0))) AS live_eez
          FROM (SELECT l.login, s.end_eez AS s, x.f, y.floating AS y, c.c, b.bal, b.cr, o.bonus AS bn
                FROM (SELECT DISTINCT login FROM {GOOD} g) l
                LEFT JOIN (SELECT * FROM snap WHERE day = DATE '{LIVE}' - 1) s ON s.login = l.login LEFT JOIN {FLOAT} x ON x.login = l.login
                LEFT JOIN {YDAY} y ON y.login = l.login LEFT JOIN {CLOSED} c ON c.login = l.login LEFT JOIN {BAL} b ON b.login = l.login
                LEFT JOIN {bonus(f"confirmed < {AFTER}")} o ON o.login = l.login) p
          LEFT JOIN (SELECT l.login, SUM({NET}) AS n FROM money t JOIN accounts a ON a.account_id = t.account_id JOIN logins l ON l.account_id = t.account_id
                     WHERE {VALID} AND {NOBONUS} AND {rng('t.confirmed', LIVE, LIVE)} AND a.is_test = 0 AND (l.deleted = 0 OR l.deleted IS NULL) GROUP BY 1) m USING (login)) r"""
B_NUM = "start_eez net_dep daily_pnl live_eez formula gap"
SQL["R31_pnl_bridge"] = out(BRIDGE, "", B_NUM)
SQL["R31_bridge_summary"] = out(f"""
    SELECT category, COUNT(*) AS logins, {', '.join(f'SUM({c}) AS {c}' for c in B_NUM.split())} FROM ({BRIDGE}) z GROUP BY 1""", "", B_NUM)
SQL["R31_top_gaps"] = out(f"SELECT * FROM ({BRIDGE}) z WHERE ABS(gap) > 100 ORDER BY ABS(gap) DESC, login LIMIT 20", "", B_NUM)

SQL["R32_cash_pnl_series"] = out(f"""
    SELECT n.day, COALESCE(k.v, 0) AS net_dep, COALESCE(b.v, 0) AS bonus, n.eez - p.eez - COALESCE(k.v, 0) AS eez_formula,
           n.en - p.en - COALESCE(k.v, 0) AS f1, n.en - n.sc - COALESCE(k.v, 0) AS f2, n.en - p.en - COALESCE(k.v, 0) - COALESCE(b.v, 0) AS f3,
           n.en - n.sp - COALESCE(k.v, 0) AS f4, n.ee - n.sc - COALESCE(k.v, 0) AS f5, n.ef - p.ef - COALESCE(k.v, 0) AS floating_only,
           n.fc - p.fc - COALESCE(k.v, 0) AS floating_less_credit
    FROM (SELECT q.*, s.eez FROM (
            SELECT day, SUM(GREATEST(0, {NETEQ})) AS en, SUM(GREATEST(0, equity)) AS ee, SUM(GREATEST(0, COALESCE(floating, 0))) AS ef,
                   SUM(GREATEST(0, floating - GREATEST(0, equity - balance - floating))) AS fc, SUM(GREATEST(0, prev_equity)) AS sc, SUM(prev_equity) AS sp
            FROM equity_days WHERE login IN (SELECT login FROM {EQL} g) GROUP BY 1) q LEFT JOIN (SELECT day, SUM(end_eez) AS eez FROM snap GROUP BY 1) s USING (day)) n
    LEFT JOIN (SELECT q.*, s.eez FROM (
            SELECT day, SUM(GREATEST(0, {NETEQ})) AS en, SUM(GREATEST(0, COALESCE(floating, 0))) AS ef,
                   SUM(GREATEST(0, floating - GREATEST(0, equity - balance - floating))) AS fc FROM equity_days WHERE login IN (SELECT login FROM {EQL} g) GROUP BY 1) q
        LEFT JOIN (SELECT day, SUM(end_eez) AS eez FROM snap GROUP BY 1) s USING (day)) p ON p.day = n.day - 1
    LEFT JOIN (SELECT tx_date, SUM(net_usd) AS v FROM kpis GROUP BY 1) k ON k.tx_date = n.day
    LEFT JOIN (SELECT CAST(confirmed AS DATE) AS day, SUM(amount) AS v FROM bonuses GROUP BY 1) b ON b.day = n.day""", "day",
    "net_dep bonus eez_formula f1 f2 f3 f4 f5 floating_only floating_less_credit")
SQL["R32_signed_login_pnl"] = out(f"""
    SELECT day, COUNT(*) AS logins, SUM(GREATEST(0, COALESCE(e, 0)) - GREATEST(0, COALESCE(s, 0)) - COALESCE(n, 0)) AS pnl
    FROM (SELECT login, day, COALESCE(floating, 0) AS e FROM equity_days) a
    FULL JOIN (SELECT login, day + 1 AS day, COALESCE(floating, 0) AS s FROM equity_days) b USING (login, day)
    FULL JOIN (SELECT login, CAST(close_time AS DATE) AS day, SUM(profit) AS n FROM balance_ops WHERE cmd = 6 GROUP BY 1, 2) c USING (login, day)
    WHERE e IS NOT NULL OR s IS NOT NULL GROUP BY 1""", "day", "pnl")
SQL["R35_login_profile"] = out(f"""
    SELECT login, 'snapshot' AS item, CAST(day AS STRING) AS detail, end_eez AS value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY login ORDER BY day DESC) AS rn FROM snap) s WHERE rn = 1
    UNION ALL SELECT login, 'balance', NULL, bal FROM {BAL} b
    UNION ALL SELECT login, 'bonus', CAST(COUNT(*) AS STRING), SUM(amount) FROM bonuses GROUP BY 1
    UNION ALL SELECT login, 'deposit', CAST(money_id AS STRING), usd FROM (
        SELECT TRY_CAST(t.login AS BIGINT) AS login, t.money_id, t.usd, ROW_NUMBER() OVER (PARTITION BY t.login ORDER BY t.usd DESC, t.money_id) AS rn
        FROM money t WHERE {OK} AND t.type = 'Deposit') d WHERE rn <= 30 AND login IS NOT NULL""", "", "value")
SQL["R36_snapshot_replay"] = out(f"""
    SELECT day, SUM(s) AS stored, SUM(r) AS recomputed, COUNT(*) FILTER (WHERE s IS DISTINCT FROM r) AS logins_off, SUM(r) - SUM(s) AS diff
    FROM (SELECT d.day, {eez('d.balance', 'd.floating', 'b.bonus')} AS s,
                 {eez('d.balance', 'd.floating', 'GREATEST(COALESCE(b.bonus, 0), 0)')} AS r
          FROM equity_days d JOIN test_logins tl ON tl.login = d.login AND tl.is_test = 0
          LEFT JOIN (SELECT d2.login, d2.day, SUM(b.amount) AS bonus FROM equity_days d2
                     JOIN bonuses b ON b.login = d2.login AND CAST(b.confirmed AS DATE) <= d2.day GROUP BY 1, 2) b
                 ON b.login = d.login AND b.day = d.day) x GROUP BY 1""", "day", "stored recomputed diff")
SQL["A14_snapshot_statistics"] = out("""
    SELECT day, COUNT(*) AS logins, SUM(end_eez) AS total, MIN(end_eez) AS least, MAX(end_eez) AS greatest, ROUND(AVG(end_eez), 2) AS average
    FROM snap GROUP BY 1""", "day", "total least greatest average")
CLEAN = f"""(SELECT d.login, d.day, {eez('d.balance', 'd.floating', 'b.bonus')} AS eez
    FROM (SELECT * FROM (SELECT e.*, CAST(e.at AS DATE) AS day, ROW_NUMBER() OVER (PARTITION BY e.login, CAST(e.at AS DATE) ORDER BY e.at DESC, e.source DESC) AS rn
                         FROM equity e WHERE e.floating IS NULL OR ABS(e.floating) < 100000000) q WHERE rn = 1) d
    JOIN test_logins tl ON tl.login = d.login AND tl.is_test = 0
    LEFT JOIN (SELECT d2.login, d2.day, SUM(b.amount) AS bonus FROM (SELECT DISTINCT login, day FROM equity_days) d2
               JOIN bonuses b ON b.login = d2.login AND CAST(b.confirmed AS DATE) <= d2.day GROUP BY 1, 2) b ON b.login = d.login AND b.day = d.day)"""
SQL["D4_snapshot_repair"] = out(f"""
    SELECT e.login, e.day, e.eez AS end_eez, p.eez AS start_eez FROM {CLEAN} e LEFT JOIN {CLEAN} p ON p.login = e.login AND p.day = e.day - 1
    WHERE e.day > DATE '{LIVE}' - 28 AND e.day <= DATE '{LIVE}'""", "day", "end_eez start_eez")

# ---- regulatory ------------------------------------------------------------------------------------------------
Q0, Q1 = "DATE '1999-01-01'", "DATE '1999-04-01'"
LANDS = "('CM', 'KE', 'SE', 'ZM', 'DK', 'NL', 'ES', 'FI', 'NO', 'AW')"
SCOPE = f"a.is_test = 0 AND (a.sales_rep IS NULL OR a.sales_rep <> 7) AND a.country IN {LANDS}"
ACT, INACT = "a.compliance IN ('4', '9')", "a.compliance NOT IN ('4', '9')"
AGEQ = age("a.birth_date", "DATE '1999-03-31'")
BANDS = (("under_18", -999, 17), ("18_25", 18, 25), ("26_35", 26, 35), ("36_45", 36, 45), ("46_55", 46, 55), ("56_65", 56, 65), ("over_65", 66, 999))
SQL["R24_regulatory_clients"] = out(f"""
    SELECT * FROM (SELECT COUNT(*) FILTER (WHERE {ACT} AND a.created < {Q0}) AS active_bop, COUNT(*) FILTER (WHERE {INACT} AND a.created < {Q0}) AS inactive_bop,
                          COUNT(*) FILTER (WHERE {ACT} AND a.created < {Q1}) AS active_eop, COUNT(*) FILTER (WHERE {INACT} AND a.created < {Q1}) AS inactive_eop,
                          {', '.join(f"COUNT(*) FILTER (WHERE {ACT} AND a.created < {Q1} AND {AGEQ} BETWEEN {lo} AND {hi}) AS age_{n}" for n, lo, hi in BANDS)},
                          COUNT(*) FILTER (WHERE {ACT} AND a.created < {Q1}) AS total_active, COUNT(*) FILTER (WHERE {ACT} AND a.created < {Q1} AND a.pep = 1) AS pep
                   FROM accounts a WHERE a.funded = 1 AND {SCOPE}) x,
                  (SELECT COALESCE(SUM(GREATEST(s.end_eez, 0)), 0) AS clients_funds FROM snap s JOIN logins l ON l.login = s.login
                   JOIN accounts a ON a.account_id = l.account_id WHERE {SCOPE} AND s.day = (SELECT MAX(day) FROM snap WHERE day <= DATE '1999-03-31')) y""",
    "", "clients_funds")
ISO = "CASE WHEN a.country = 'AW' THEN 'NL' ELSE a.country END"
QVOL = f"""(SELECT {ISO} AS iso, SUM(x.notional) AS volume FROM (
        SELECT login, notional FROM positions WHERE open_time >= {Q0} AND open_time < {Q1}
        UNION ALL SELECT login, notional FROM resolved WHERE open_time >= {Q0} AND open_time < {Q1}
        UNION ALL SELECT login, notional FROM deals WHERE entry = 1 AND close_time >= {Q0} AND close_time < {Q1}) x
    JOIN logins l ON l.login = x.login JOIN accounts a ON a.account_id = l.account_id WHERE a.funded = 1 AND {SCOPE} GROUP BY 1)"""
NAMES = (("CM", "Cameroon"), ("KE", "Kenya"), ("SE", "Sweden"), ("ZM", "Zambia"), ("DK", "Denmark"), ("NL", "Netherlands"), ("ES", "Spain"),
         ("FI", "Finland"), ("NO", "Norway"))
SQL["R25_regulatory_countries"] = out(f"""
    SELECT n.iso, n.name, COALESCE(c.active, 0) AS active, COALESCE(c.inactive, 0) AS inactive, COALESCE(v.volume, 0) AS volume
    FROM (VALUES {', '.join(f"('{i}', '{n}')" for i, n in NAMES)}) n(iso, name)
    LEFT JOIN (SELECT {ISO} AS iso, COUNT(*) FILTER (WHERE {ACT}) AS active, COUNT(*) FILTER (WHERE {INACT}) AS inactive FROM accounts a
               WHERE a.funded = 1 AND {SCOPE} AND a.created < {Q1} GROUP BY 1) c ON c.iso = n.iso LEFT JOIN {QVOL} v ON v.iso = n.iso""", "", "volume")


def equity_at(rows: str) -> str:
    return f"""SELECT COALESCE(SUM(GREATEST(e.equity, 0)), 0) FROM {rows} e JOIN logins l ON l.login = e.login JOIN accounts a ON a.account_id = l.account_id
        WHERE a.funded = 1 AND {SCOPE}"""


MOMENT = "(SELECT * FROM equity m WHERE m.at = (SELECT MAX(z.at) FROM equity z WHERE z.at <= DATE '1999-03-31'))"


def last_day(bound: str) -> str:
    return newest(f"CAST(e.at AS DATE) = (SELECT MAX(CAST(z.at AS DATE)) FROM equity z WHERE CAST(z.at AS DATE) {bound})")


MOVED = f"""SELECT COALESCE(SUM(e.delta_floating), 0) FROM equity e JOIN logins l ON l.login = e.login JOIN accounts a ON a.account_id = l.account_id
        WHERE a.funded = 1 AND {SCOPE} AND e.at >= {Q0} AND e.at < {Q1}"""


def ratio(rows: str) -> str:
    return f"""SELECT actual_equity, floating_pnl, actual_equity + floating_pnl AS total_equity,
            CASE WHEN actual_equity + floating_pnl <> 0 THEN CAST(actual_equity AS DOUBLE) / CAST(actual_equity + floating_pnl AS DOUBLE) * 100 ELSE 0 END AS equity_ratio
        FROM (SELECT ({equity_at(rows)}) AS actual_equity, ({MOVED}) AS floating_pnl) x"""


SQL["R26_regulatory_equity"] = out(ratio(MOMENT), "", "actual_equity floating_pnl total_equity equity_ratio")
SQL["R26_regulatory_equity_by_day"] = out(ratio(last_day("<= DATE '1999-03-31'")), "", "actual_equity floating_pnl total_equity equity_ratio")
QTX = f"FROM money t WHERE {OK} AND t.confirmed >= {Q0} AND t.confirmed < {Q1} AND t.account_id IN (SELECT a.account_id FROM accounts a WHERE {SCOPE})"
SQL["R27_regulatory_income"] = out(f"""
    SELECT *, end_equity - start_equity - net_usd - (dep_adj - wd_adj) AS pnl_equity
    FROM (SELECT (SELECT COALESCE(SUM(volume), 0) FROM {QVOL} v) AS total_volume,
                 (SELECT COALESCE(SUM(volume), 0) FROM {QVOL} v WHERE iso IN ('SE', 'DK', 'NL', 'ES', 'FI', 'NO')) AS eu_volume,
                 (SELECT COALESCE(SUM(volume), 0) FROM {QVOL} v WHERE iso IN ('CM', 'KE', 'ZM')) AS other_foreign_volume,
                 (SELECT COALESCE(SUM(CASE WHEN t.raw_type = 'Deposit' AND t.type IN {IN} THEN t.usd
                                           WHEN t.raw_type = 'Withdrawal' AND t.type IN {OUT} THEN -t.usd ELSE 0 END), 0) {QTX}) AS net_usd,
                 (SELECT COALESCE(SUM(t.usd), 0) {QTX} AND ((t.type NOT IN {IN} AND t.raw_type = 'Deposit') OR t.type = 'Transfer To Account')) AS dep_adj,
                 (SELECT COALESCE(SUM(t.usd), 0) {QTX} AND ((t.type NOT IN {OUT} AND t.raw_type = 'Withdrawal') OR t.type = 'Transfer From Account')) AS wd_adj,
                 ({equity_at(last_day("<= DATE '1999-03-31'"))}) AS end_equity, ({equity_at(last_day(f"< {Q0}"))}) AS start_equity) x""", "",
    "total_volume eu_volume other_foreign_volume net_usd dep_adj wd_adj end_equity start_equity pnl_equity")
SQL["R33_volume_per_login"] = out(f"""
    SELECT l.login, a.country, SUM(COALESCE(o.v, 0)) AS open_vol, SUM(COALESCE(c.v, 0)) AS close_vol, SUM(COALESCE(o.v, 0) + COALESCE(c.v, 0)) AS total_vol
    FROM logins l JOIN accounts a ON a.account_id = l.account_id
    LEFT JOIN (SELECT login, SUM(notional) AS v FROM deals WHERE cmd IN (0, 1) AND {TRADE} AND entry = 0 AND {rng('open_time')} GROUP BY 1) o ON o.login = l.login
    LEFT JOIN (SELECT login, SUM(notional) AS v FROM deals WHERE cmd IN (0, 1) AND {TRADE} AND entry = 1
               AND close_time > TIMESTAMP '1971-01-01 00:00:00' AND {rng('close_time')} GROUP BY 1) c ON c.login = l.login
    WHERE a.funded = 1 AND {SCOPE} AND (o.login IS NOT NULL OR c.login IS NOT NULL) GROUP BY 1, 2""", "", "open_vol close_vol total_vol")
