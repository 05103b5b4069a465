"""Comparison SQL of the bonus, campaign, aging, trader, equity and regulatory reports."""

from __future__ import annotations

from oracle.base import (COUNTABLE, DEP, FIRST, LABEL, LAST, LIVE, LIVEACC, NET, NOBONUS, NODEPT, NOTEST, OK, VALID, WDR, age, out,
                         rng, rng as in_days, score)

SQL: dict[str, str] = {}

TARGETS = f"""(SELECT TRY_CAST(agent_id AS BIGINT) AS agent_id, CAST(ftc AS INTEGER) AS target_ftc, net AS target_net
               FROM targets WHERE month = DATE_TRUNC('month', DATE '{FIRST}'))"""

# ---- R14 -----------------------------------------------------------------------------------------------------
SQL["R14_retention_bonus"] = out(f"""
    SELECT agent_id, office_name, dept_name, agent_name, office, target_net, net_usd, open_volume_usd, status, target_vol,
           ROUND_EVEN(np, 6) AS target_net_pct, ROUND_EVEN(vp, 6) AS target_vol_pct, a AS pct_on_net, b AS pct_on_target_net,
           c AS pct_on_target_vol, ROUND_EVEN(a + b + c, 6) AS total_bonus_pct, ROUND_EVEN((a + b + c) * net_usd, 2) AS basic_bonus_usd
    FROM (SELECT *,
            CAST(CASE g WHEN 'A' THEN CASE WHEN net_usd >= 200000 THEN 0.04 WHEN net_usd >= 150000 THEN 0.0375
                 WHEN net_usd >= 100000 THEN 0.035 WHEN net_usd >= 75000 THEN 0.03 WHEN net_usd >= 50000 THEN 0.02
                 WHEN net_usd >= 20000 THEN 0.015 ELSE 0 END
              WHEN 'B' THEN CASE WHEN net_usd >= 100000 THEN 0.035 WHEN net_usd >= 80000 THEN 0.03 WHEN net_usd >= 60000 THEN 0.028
                 WHEN net_usd >= 50000 THEN 0.025 WHEN net_usd >= 40000 THEN 0.02 WHEN net_usd >= 30000 THEN 0.018
                 WHEN net_usd >= 20000 THEN 0.015 WHEN net_usd >= 10000 THEN 0.01 ELSE 0 END ELSE 0 END AS DOUBLE) AS a,
            CAST(CASE WHEN g = 'A' AND np >= 1 THEN 0.005 ELSE 0 END AS DOUBLE) AS b,
            CAST(CASE WHEN g <> 'A' OR vp IS NULL THEN 0 WHEN vp >= 2 THEN 0.015 WHEN vp >= 1.5 THEN 0.0125 WHEN vp >= 1 THEN 0.01
                 WHEN vp >= 0.75 THEN 0.005 WHEN vp >= 0.5 THEN 0.002 ELSE 0 END AS DOUBLE) AS c
      FROM (SELECT *, CASE WHEN target_net > 0 THEN net_usd / target_net END AS np,
                   CASE WHEN target_vol > 0 THEN open_volume_usd / target_vol END AS vp
        FROM (SELECT u.agent_id, COALESCE(u.office_name, 'N/A') AS office_name, COALESCE(u.department, 'N/A') AS dept_name,
                     COALESCE(u.agent_name, u.full_name, 'N/A') AS agent_name, COALESCE(u.office, '') AS office,
                     ROUND_EVEN(CAST(COALESCE(tg.target_net, 0) AS DOUBLE), 2) AS target_net,
                     ROUND_EVEN(CAST(COALESCE(k.net, 0) AS DOUBLE), 2) AS net_usd,
                     ROUND_EVEN(CAST(COALESCE(v.v, 0) AS DOUBLE), 2) AS open_volume_usd, COALESCE(u.status, '') AS status,
                     ROUND_EVEN(CAST(COALESCE(tg.target_net, 0) AS DOUBLE), 2) * 1650 AS target_vol,
                     CASE WHEN u.office IN ('GMT', 'CY', 'BU') THEN 'A' WHEN u.office IN ('ABJ-NG', 'SA', 'LAG-NG') THEN 'B' ELSE 'other' END AS g
              FROM agents u LEFT JOIN {TARGETS} tg ON tg.agent_id = u.agent_id
              LEFT JOIN (SELECT agent_id, SUM(net_usd) AS net FROM kpis WHERE {rng('tx_date')} GROUP BY 1) k ON k.agent_id = u.agent_id
              LEFT JOIN (SELECT agent_id, SUM(notional_usd) AS v FROM volume WHERE {rng('open_date')} GROUP BY 1) v ON v.agent_id = u.agent_id
              WHERE u.dept = 'Retention' AND {COUNTABLE} AND {NODEPT}) w) x) y""")


def mult(c: str) -> str:
    steps = ((48, 65), (44, 60), (40, 55), (36, 50), (32, 45), (28, 40), (24, 35), (20, 30), (15, 25), (10, 20), (5, 15))
    return "CASE " + " ".join(f"WHEN {c} >= {n} THEN {v}" for n, v in steps) + " ELSE 0 END"


FTC_NET = f"""SELECT t.account_id, t.owner AS agent_id, SUM({NET}) AS net_usd
    FROM money t JOIN accounts a ON a.account_id = t.account_id
    WHERE {VALID} AND {NOBONUS} AND a.qualified IS NOT NULL AND {rng('a.qualified')} AND a.is_test = 0
      AND (a.qualified >= CAST(t.confirmed AS DATE) OR t.ftd = 1) GROUP BY 1, 2"""
BON = f"""(SELECT agent_id, SUM(ftd100_count) AS n, SUM(ftd100_full_count) AS f, SUM(ftd100_half_count) AS h,
                  SUM(total_sales_net) AS net, SUM(ftd_amount_bonus) AS amt
           FROM sales_bonus WHERE {rng('reached_at')} GROUP BY 1)"""
SQL["R15_sales_bonus"] = out(f"""
    SELECT agent_id, office_name, agent_name, target_ftc, ftc_count, n AS ftd100_count, f AS ftd100_full_count,
           h AS ftd100_half_count, ftc_net_usd, total_sales_net, ROUND_EVEN(basic, 2) AS basic_bonus, hit AS sales_target_bonus,
           amt AS ftd_amount_bonus, ROUND_EVEN(basic + hit + amt, 2) AS total_sales_bonus,
           ROUND_EVEN(n / target_ftc, 6) AS target_pct, m AS multiplier, status
    FROM (SELECT agent_id, office_name, agent_name, target_ftc, ftc_count, n, f, h, ftc_net_usd, total_sales_net, m, status,
            CASE WHEN n >= 0.5 * target_ftc THEN CAST(f * m AS DOUBLE) + CAST(h * m AS DOUBLE) / 2 ELSE 0 END AS basic,
            CASE WHEN n >= 0.5 * target_ftc AND n >= target_ftc THEN CASE WHEN n >= 60 THEN 1500 WHEN n >= 50 THEN 1000 WHEN n >= 35 THEN 500
                 WHEN n >= 30 THEN 300 WHEN n >= 25 THEN 200 WHEN n >= 20 THEN 150 WHEN n >= 5 THEN 100 ELSE 0 END ELSE 0 END AS hit,
            CASE WHEN n >= 0.5 * target_ftc THEN amt0 ELSE 0 END AS amt
      FROM (SELECT u.agent_id, COALESCE(u.office_name, 'N/A') AS office_name, COALESCE(u.agent_name, u.full_name, 'N/A') AS agent_name,
                   GREATEST(COALESCE(tg.target_ftc, 0), 1) AS target_ftc, COALESCE(k.ftc, 0) AS ftc_count, CAST(COALESCE(b.n, 0) AS BIGINT) AS n,
                   COALESCE(b.f, 0) AS f, COALESCE(b.h, 0) AS h, COALESCE(b.amt, 0) AS amt0, COALESCE(x.net, 0) AS ftc_net_usd,
                   COALESCE(b.net, 0) AS total_sales_net, {mult('COALESCE(b.n, 0)')} AS m, COALESCE(u.status, '') AS status
            FROM agents u LEFT JOIN {TARGETS} tg ON tg.agent_id = u.agent_id
            LEFT JOIN (SELECT agent_id, SUM(ftc_count) AS ftc FROM kpis WHERE {rng('qual_date')} GROUP BY 1) k ON k.agent_id = u.agent_id
            LEFT JOIN {BON} b ON b.agent_id = u.agent_id
            LEFT JOIN (SELECT agent_id, SUM(net_usd) AS net FROM ({FTC_NET}) q GROUP BY 1) x ON x.agent_id = u.agent_id
            WHERE u.dept = 'Sales' AND u.team = 'Conversion' AND {COUNTABLE}
              AND (COALESCE(b.n, 0) > 0 OR COALESCE(tg.target_ftc, 0) > 1)) y) z""", "", "ftc_net_usd total_sales_net basic_bonus total_sales_bonus",
    "ftc_count ftd100_count ftd100_full_count ftd100_half_count sales_target_bonus ftd_amount_bonus multiplier target_ftc")

FIRST_FTD = f"""(SELECT account_id, owner, CAST(confirmed AS DATE) AS day FROM (
        SELECT t.*, ROW_NUMBER() OVER (PARTITION BY t.account_id ORDER BY t.confirmed, t.money_id) AS rn
        FROM money t WHERE t.ftd = 1 AND {OK}) r WHERE rn = 1)"""
FTD100 = f"""(SELECT account_id, owner AS agent_id, CASE WHEN reached_amount >= 240 THEN 'full' ELSE 'half' END AS ty,
        CASE WHEN reached_amount < 500 THEN 0 WHEN reached_amount < 1000 THEN 10 WHEN reached_amount < 5000 THEN 20 ELSE 50 END AS amt
    FROM clients WHERE {rng('reached_at')} AND owner IS NOT NULL)"""
COUNTS = f"(SELECT b.agent_id, b.n, COALESCE(tg.target_ftc, 0) AS target_ftc FROM {BON} b LEFT JOIN {TARGETS} tg ON tg.agent_id = b.agent_id)"
SQL["R16_sales_bonus_accounts"] = out(f"""
    SELECT u.office_name, COALESCE(u.agent_name, u.full_name, 'N/A') AS agent_name, c.account_id, c.is_ftc, c.is_ftd100,
           COALESCE(fn.net_usd, 0) AS ftc_net_usd,
           CASE WHEN c.is_ftd100 = 1 AND COALESCE(t.n, 0) >= 0.5 * GREATEST(COALESCE(t.target_ftc, 0), 1)
                THEN CASE WHEN c.ty = 'full' THEN CAST({mult('COALESCE(t.n, 0)')} AS DOUBLE)
                          ELSE ROUND_EVEN(CAST({mult('COALESCE(t.n, 0)')} AS DOUBLE) / 2, 2) END ELSE 0 END AS basic_bonus,
           CASE WHEN c.is_ftd100 = 1 AND COALESCE(t.n, 0) >= 0.5 * GREATEST(COALESCE(t.target_ftc, 0), 1) THEN c.amt ELSE 0 END AS ftd_amount_bonus,
           COALESCE(u.status, '') AS status
    FROM (SELECT COALESCE(f.account_id, x.account_id) AS account_id, COALESCE(f.agent_id, x.agent_id) AS agent_id,
                 CASE WHEN x.account_id IS NULL THEN 0 ELSE 1 END AS is_ftc, CASE WHEN f.account_id IS NULL THEN 0 ELSE 1 END AS is_ftd100,
                 f.ty, COALESCE(f.amt, 0) AS amt
          FROM {FTD100} f FULL OUTER JOIN (
              SELECT a.account_id, COALESCE(td.owner, a.assigned_to) AS agent_id FROM accounts a
              LEFT JOIN {FIRST_FTD} td ON td.account_id = a.account_id WHERE {rng('a.qualified')} AND a.is_test = 0) x
            ON x.account_id = f.account_id) c
    JOIN agents u ON u.agent_id = c.agent_id LEFT JOIN ({FTC_NET}) fn ON fn.account_id = c.account_id AND fn.agent_id = c.agent_id
    LEFT JOIN {COUNTS} t ON t.agent_id = c.agent_id
    WHERE u.dept = 'Sales' AND u.team = 'Conversion' AND {COUNTABLE} AND (COALESCE(t.n, 0) > 0 OR COALESCE(t.target_ftc, 0) > 1)""",
    "", "ftc_net_usd basic_bonus", "is_ftc is_ftd100 ftd_amount_bonus")
FTCS = f"""
    WITH fa AS (SELECT a.account_id, a.assigned_to, a.qualified, td.day AS ftd_day, COALESCE(td.owner, a.assigned_to) AS ftd_agent
                FROM accounts a LEFT JOIN {FIRST_FTD} td ON td.account_id = a.account_id WHERE {rng('a.qualified')} AND a.is_test = 0),
    deps AS (SELECT t.account_id, t.owner AS agent_id, SUM({DEP}) AS ftc_deposit, SUM({WDR}) AS ftc_wd
             FROM money t JOIN fa ON fa.account_id = t.account_id
             WHERE {VALID} AND {NOBONUS} AND t.owner IS NOT NULL
               AND (fa.ftd_day IS NULL OR t.confirmed >= fa.ftd_day OR t.ftd = 1)
               AND (t.confirmed < fa.qualified + INTERVAL '1' DAY OR t.ftd = 1) GROUP BY 1, 2),
    pairs AS (SELECT * FROM deps UNION ALL
              SELECT fa.account_id, fa.assigned_to, 0, 0 FROM fa LEFT JOIN deps ON deps.account_id = fa.account_id AND deps.agent_id = fa.assigned_to
              WHERE fa.assigned_to IS NOT NULL AND deps.agent_id IS NULL)
    SELECT COALESCE(u.agent_name, u.full_name, 'N/A') AS agent_name, COALESCE(u.desk, '') AS desk, COALESCE(u.office_name, '') AS office_name,
           COALESCE(u.position, '') AS position, p.account_id, CASE WHEN p.agent_id = fa.ftd_agent THEN 1 ELSE 0 END AS ftc,
           p.ftc_deposit, p.ftc_wd,
           CASE WHEN p.agent_id = fa.ftd_agent AND f.ty IS NOT NULL AND c.target_ftc > 0 AND c.n >= 0.5 * c.target_ftc
                THEN CASE WHEN f.ty = 'full' THEN CAST({mult('c.n')} AS DOUBLE) ELSE ROUND_EVEN(CAST({mult('c.n')} AS DOUBLE) / 2, 2) END
                ELSE 0 END AS basic_bonus,
           CASE WHEN p.agent_id = fa.ftd_agent AND f.ty IS NOT NULL AND c.target_ftc > 0 AND c.n >= 0.5 * c.target_ftc
                THEN f.amt ELSE 0 END AS ftd_amount_bonus
    FROM pairs p JOIN fa ON fa.account_id = p.account_id LEFT JOIN {FTD100} f ON f.account_id = p.account_id
    LEFT JOIN agents u ON u.agent_id = p.agent_id LEFT JOIN {COUNTS} c ON c.agent_id = p.agent_id
    WHERE u.agent_id IS NULL OR ({COUNTABLE})"""
SQL["R17_all_ftcs"] = out(FTCS, "", "ftc_deposit ftc_wd basic_bonus", "ftc ftd_amount_bonus")
SQL["F17_search_totals"] = out(f"""
    SELECT COUNT(*) AS rows, SUM(ftc) AS ftc, SUM(ftc_deposit) AS ftc_deposit, SUM(ftc_wd) AS ftc_wd, SUM(basic_bonus) AS basic_bonus,
           SUM(ftd_amount_bonus) AS ftd_amount_bonus FROM ({FTCS}) r
    WHERE LOWER(CAST(account_id AS STRING) || '|' || agent_name || '|' || desk || '|' || office_name) LIKE '%nation!_1%' ESCAPE '!'""",
    "", "ftc_deposit ftc_wd basic_bonus", "ftc ftd_amount_bonus")

# ---- R6 ------------------------------------------------------------------------------------------------------
CAMP = "LEFT JOIN campaigns c ON c.campaign_id = SPLIT_PART(a.campaign, '.', 1)"
G6 = "COALESCE(c.channel, '(Unassigned)') AS g1, COALESCE(a.country, '(Unassigned)') AS g2"
HIDDEN = f"(SELECT u.agent_id FROM agents u WHERE {LABEL} ILIKE 'test%' OR {LABEL} ILIKE 'duplicated%')"
SHOWN = f"(a.assigned_to IS NULL OR a.assigned_to NOT IN {HIDDEN})"


def back(n: int) -> str:
    return f"DATE '{LIVE}' - INTERVAL '{n - 1}' DAY"


R6 = f"""
    WITH l AS (SELECT {G6}, COUNT(*) AS daily_leads, COUNT(*) FILTER (WHERE a.birth_date IS NOT NULL) AS daily_live,
                      ROUND(AVG(CASE WHEN a.birth_date IS NOT NULL THEN a.score END), 1) AS live_avg_score
               FROM accounts a {CAMP} WHERE {LIVEACC} AND {rng('a.created', LIVE, LIVE)} AND a.created >= DATE '1995-01-01' AND {SHOWN} GROUP BY 1, 2),
    f AS (SELECT {G6}, COUNT(DISTINCT t.account_id) AS daily_ftd, SUM(t.usd) AS daily_ftd_amount, ROUND(AVG(a.score), 1) AS ftd_avg_score
          FROM money t JOIN accounts a ON a.account_id = t.account_id {CAMP}
          WHERE {VALID} AND t.type = 'Deposit' AND t.ftd = 1 AND {rng('t.confirmed', LIVE, LIVE)} AND {LIVEACC} GROUP BY 1, 2),
    q AS (SELECT {G6}, COUNT(*) AS daily_ftc FROM accounts a {CAMP} WHERE {LIVEACC} AND {rng('a.qualified', LIVE, LIVE)} GROUP BY 1, 2),
    n AS (SELECT {G6}, {', '.join(f"SUM(CASE WHEN t.confirmed >= {back(w)} THEN {NET} END) AS net{w}" for w in (30, 60, 90, 120))}
          FROM money t JOIN accounts a ON a.account_id = t.account_id {CAMP}
          WHERE {VALID} AND t.confirmed >= {back(120)} AND t.confirmed < DATE '{LIVE}' + INTERVAL '1' DAY AND {LIVEACC} GROUP BY 1, 2),
    m AS (SELECT {G6}, {', '.join(f"COUNT(*) FILTER (WHERE a.qualified >= {back(w)}) AS ftc{w}" for w in (30, 60, 90, 120))}
          FROM accounts a {CAMP} WHERE {LIVEACC} AND a.qualified >= {back(120)} AND a.qualified < DATE '{LIVE}' + INTERVAL '1' DAY GROUP BY 1, 2),
    g AS (SELECT g1, g2 FROM l UNION SELECT g1, g2 FROM f UNION SELECT g1, g2 FROM q)
    SELECT g.g1, g.g2, COALESCE(l.daily_leads, 0) AS daily_leads, COALESCE(l.daily_live, 0) AS daily_live, l.live_avg_score,
           COALESCE(f.daily_ftd, 0) AS daily_ftd, COALESCE(f.daily_ftd_amount, 0) AS daily_ftd_amount, f.ftd_avg_score,
           COALESCE(q.daily_ftc, 0) AS daily_ftc,
           {', '.join(f"COALESCE(n.net{w}, 0) AS net{w}, COALESCE(m.ftc{w}, 0) AS ftc{w}" for w in (30, 60, 90, 120))},
           CASE WHEN l.daily_leads > 0 THEN ROUND_EVEN(CAST(l.daily_live AS DOUBLE) / l.daily_leads * 100, 1) END AS cr_lead_live,
           CASE WHEN l.daily_live > 0 THEN ROUND_EVEN(CAST(COALESCE(f.daily_ftd, 0) AS DOUBLE) / l.daily_live * 100, 1) END AS cr_live_ftd,
           {', '.join(f"CASE WHEN m.ftc{w} > 0 THEN ROUND_EVEN(CAST(COALESCE(n.net{w}, 0) AS DOUBLE) / m.ftc{w}, 2) END AS ltv{w}" for w in (30, 60, 90, 120))}
    FROM g LEFT JOIN l ON l.g1 = g.g1 AND l.g2 = g.g2 LEFT JOIN f ON f.g1 = g.g1 AND f.g2 = g.g2
    LEFT JOIN q ON q.g1 = g.g1 AND q.g2 = g.g2 LEFT JOIN n ON n.g1 = g.g1 AND n.g2 = g.g2 LEFT JOIN m ON m.g1 = g.g1 AND m.g2 = g.g2"""
SQL["R6_marketing_day"] = out(R6, "", "daily_ftd_amount net30 net60 net90 net120")

# ---- R7 ------------------------------------------------------------------------------------------------------


def cards(flt: str, filtered: bool, q: tuple[str, str] = (FIRST, LAST)) -> str:
    base = f"(SELECT a.*, c.marketing_group FROM accounts a {CAMP} WHERE TRUE {flt})"
    known = f"(SELECT a.*, {score(f'DATE {chr(39)}{LIVE}{chr(39)}')} AS s FROM {base} a WHERE {LIVEACC} AND a.created >= DATE '1995-01-01' AND {SHOWN})"
    agent = f"AND {NOTEST} AND {NOBONUS}" if filtered else f"AND {LABEL} NOT ILIKE 'test%' AND {LABEL} NOT ILIKE 'duplicated%'"
    day = f"{{}} >= DATE '{LAST}' AND {{}} < DATE '{LAST}' + INTERVAL '1' DAY"

    def on(c: str) -> str:
        return day.replace("{}", c)
    return f"""
    SELECT * FROM
      (SELECT COUNT(*) FILTER (WHERE {on('created')}) AS leads_daily, COUNT(*) FILTER (WHERE {rng('created')}) AS leads_range,
              COUNT(*) FILTER (WHERE {on('created')} AND birth_date IS NOT NULL) AS live_daily,
              COUNT(*) FILTER (WHERE {rng('created')} AND birth_date IS NOT NULL) AS live_range,
              COUNT(*) FILTER (WHERE {rng('qualified', q[1], q[1])}) AS ftc_daily, COUNT(*) FILTER (WHERE {rng('qualified', *q)}) AS ftc_range,
              ROUND(AVG(s) FILTER (WHERE {rng('created')} AND birth_date IS NOT NULL), 1) AS live_avg_score FROM {known} k) a,
      (SELECT COALESCE(SUM({DEP}), 0) AS deposits, COALESCE(SUM({WDR}), 0) AS withdrawals, COALESCE(SUM({NET}), 0) AS net_deposits,
              COALESCE(SUM(CASE WHEN t.type = 'Deposit' AND t.ftd = 1 THEN 1 ELSE 0 END), 0) AS ftd_range,
              COALESCE(SUM(CASE WHEN t.type = 'Deposit' AND t.ftd = 1 AND {on('t.confirmed')} THEN 1 ELSE 0 END), 0) AS ftd_daily
       FROM money t JOIN {base} a ON a.account_id = t.account_id LEFT JOIN agents u ON u.agent_id = t.owner
       WHERE {VALID} AND a.is_test = 0 AND {rng('t.confirmed')} {agent}) b,
      (SELECT ROUND(AVG(s), 1) AS ftd_avg_score FROM (SELECT DISTINCT a.account_id, {score(f'DATE {chr(39)}{LIVE}{chr(39)}')} AS s
          FROM money t JOIN {base} a ON a.account_id = t.account_id
          WHERE {VALID} AND t.type = 'Deposit' AND t.ftd = 1 AND {rng('t.confirmed')} AND {LIVEACC}) x WHERE s IS NOT NULL) c,
      (SELECT COUNT(DISTINCT rt.account_id) AS traders FROM traders rt JOIN agents u ON u.agent_id = rt.agent_id
       WHERE {rng('rt.day')} AND {NOTEST} AND u.dept = 'Retention') d"""


SQL["R7_campaign_cards"] = out(cards("", False), "", "deposits withdrawals net_deposits", "ftd_range ftd_daily")
SQL["R7_campaign_cards_filtered"] = out(cards(
    f"""AND c.marketing_group IN ('PPC', 'Organic', 'IB') AND a.score BETWEEN 6 AND 10 AND {rng('a.qualified', '1995-06-01', '2001-05-31')}
        AND a.affiliate IN ('MACHINERY', 'FURNITURE', 'BUILDING')""", True, ("1995-06-01", "2001-05-31")), "",
    "deposits withdrawals net_deposits", "ftd_range ftd_daily")

# ---- R8 ------------------------------------------------------------------------------------------------------


def segment(on: str) -> str:
    y = age("a.birth_date", on)
    return (f"CASE WHEN a.segment IN ('1', '2', '3', '4') THEN CASE a.segment WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' ELSE 'A+' END "
            f"WHEN (a.segment IS NULL OR a.segment IN ('0', '17')) AND (a.score IS NULL OR a.score NOT BETWEEN 1 AND 10) AND a.birth_date IS NOT NULL "
            f"THEN CASE WHEN {y} < 25 THEN 'C' WHEN {y} BETWEEN 25 AND 34 THEN 'B' WHEN {y} BETWEEN 35 AND 49 THEN 'A' WHEN {y} >= 50 THEN 'A+' END "
            f"WHEN a.segment = '17' THEN 'Unverified' ELSE '(Unassigned)' END")


def table(g1: str, g2: str | None, period: str | None, flt: str = "", first: str = FIRST, last: str = LAST,
          qualified: tuple | None = None) -> str:
    def rng(col: str, first: str = first, last: str = last) -> str:
        return in_days(col, first, last)

    joins = f"{CAMP} LEFT JOIN agents cu ON cu.agent_id = a.assigned_to"
    groups = [(g1, "g1")] + ([(g2, "g2")] if g2 else [])
    keys = (["period"] if period else []) + [n for _, n in groups]

    def sel(at: str) -> str:
        p = [f"CAST(DATE_TRUNC('{period}', {at}) AS DATE) AS period"] if period else []
        return ", ".join(p + [f"{e} AS {n}" for e, n in groups])

    by = "GROUP BY " + ", ".join(str(i + 1) for i in range(len(keys)))
    acc = f"accounts a {joins}"
    s = score(f"DATE '{LIVE}'")
    known = f"{LIVEACC} AND a.created >= DATE '1995-01-01' AND {SHOWN} {flt}"
    txn = f"money t JOIN {acc.replace('accounts a', 'accounts a ON a.account_id = t.account_id', 1)} LEFT JOIN agents u ON u.agent_id = t.owner"
    vol = f"JOIN logins l ON l.login = x.login JOIN {acc.replace('accounts a', 'accounts a ON a.account_id = l.account_id', 1)}"
    parts = {
        "p": f"SELECT {sel('a.created')}, COUNT(*) AS leads, COUNT(*) FILTER (WHERE a.birth_date IS NOT NULL) AS live_accounts, "
             f"ROUND(AVG({s}) FILTER (WHERE a.birth_date IS NOT NULL), 1) AS live_avg_score FROM {acc} WHERE {known} AND {rng('a.created')} {by}",
        "q": f"SELECT {sel('a.qualified')}, COUNT(*) AS ftc FROM {acc} WHERE {known} AND {rng('a.qualified', *(qualified or (first, last)))} {by}",
        "t": f"SELECT {sel('t.confirmed')}, SUM(CASE WHEN t.ftd = 1 AND t.type = 'Deposit' THEN 1 ELSE 0 END) AS ftd, SUM({DEP}) AS deposits, "
             f"SUM({WDR}) AS withdrawals, ROUND(AVG({s}) FILTER (WHERE t.ftd = 1 AND t.type = 'Deposit'), 1) AS ftd_avg_score "
             f"FROM {txn} WHERE {VALID} AND {NOBONUS} AND a.is_test = 0 AND {COUNTABLE} AND {rng('t.confirmed')} {flt} {by}",
        "d": f"SELECT {sel('rt.day')}, COUNT(DISTINCT rt.account_id) AS traders FROM traders rt JOIN {acc.replace('accounts a', 'accounts a ON a.account_id = rt.account_id', 1)} "
             f"JOIN agents u ON u.agent_id = rt.agent_id WHERE {NOTEST} AND u.dept = 'Retention' AND {rng('rt.day')} {flt} {by}",
        "r": f"SELECT {sel('t.confirmed')}, COUNT(DISTINCT a.account_id) AS rdp_count, SUM({NET}) AS rdp_net FROM {txn} "
             f"WHERE {VALID} AND {NOBONUS} AND a.is_test = 0 AND a.qualified IS NOT NULL AND {COUNTABLE} AND {rng('t.confirmed')} AND t.confirmed > a.qualified {flt} {by}",
        "v": f"SELECT {sel('x.at')}, SUM(x.notional) AS volume_usd FROM (SELECT login, open_time AS at, notional FROM positions UNION ALL "
             f"SELECT login, open_time, notional FROM resolved UNION ALL SELECT login, close_time, notional FROM deals WHERE entry = 1 "
             f"AND close_time > TIMESTAMP '1971-01-01 00:00:00') x {vol} WHERE a.is_test = 0 AND {rng('x.at')} {flt} {by}",
    }
    using = ", ".join(keys)
    joined = "p" + "".join(f" FULL JOIN {n} USING ({using})" for n in parts if n != "p")
    ints = ("leads", "live_accounts", "ftc", "ftd", "traders", "rdp_count")
    nums = ("deposits", "withdrawals", "rdp_net", "volume_usd")
    return (f"WITH {', '.join(f'{n} AS ({q})' for n, q in parts.items())} SELECT {using}, "
            + ", ".join([f"CAST(COALESCE({c}, 0) AS BIGINT) AS {c}" for c in ints] + [f"COALESCE({c}, 0) AS {c}" for c in nums])
            + f", live_avg_score, ftd_avg_score FROM {joined}")


def rates(body: str) -> str:
    def div(a: str, b: str, times: int = 1) -> str:
        return f"CASE WHEN {b} <> 0 THEN ROUND_EVEN(CAST({a} AS DOUBLE) / {b} * {times}, 2) ELSE 0 END"
    return f"""SELECT *, deposits - withdrawals AS net_deposits, {div('live_accounts', 'leads', 100)} AS cr_lead_to_live,
        {div('ftd', 'live_accounts', 100)} AS cr_live_to_ftd, {div('(deposits - withdrawals)', 'ftc')} AS ltv,
        {div('(deposits - withdrawals)', 'traders')} AS ltv_traders FROM ({body}) z"""


T_NUM = "deposits withdrawals rdp_net volume_usd net_deposits"
SEG = f"COALESCE({segment(f'DATE {chr(39)}{LIVE}{chr(39)}')}, '(Unassigned)')"
SQL["R8_campaign_table"] = out(rates(table("COALESCE(c.marketing_group, '(Unassigned)')", SEG, None)), "", T_NUM)
QUALIFIED = ("1995-06-01", "2001-05-31")
SQL["R8_campaign_table_qualified"] = out(rates(table(
    "COALESCE(c.marketing_group, '(Unassigned)')", None, None, f"AND {in_days('a.qualified', *QUALIFIED)}", "1998-01-01", "1998-06-30", QUALIFIED)), "", T_NUM)
SQL["R8_campaign_table_by_month"] = out(rates(table("COALESCE(cu.office_name, '(Unassigned)')", None, "month")), "period", T_NUM)
DQ = f"(DATE '{LIVE}' - CAST(a.qualified AS DATE))"
FILTER8 = f"""AND cu.desk_name IN ('Desk 1', 'Desk 2', 'Desk 3') AND a.qualified IS NOT NULL
    AND ({DQ} BETWEEN 31 AND 60 OR {DQ} BETWEEN 91 AND 120 OR {DQ} > 120)"""
SQL["R8_campaign_totals"] = out(rates(f"""
    SELECT SUM(leads) AS leads, SUM(live_accounts) AS live_accounts, SUM(ftc) AS ftc, SUM(ftd) AS ftd, SUM(deposits) AS deposits,
           SUM(withdrawals) AS withdrawals, SUM(traders) AS traders, SUM(rdp_count) AS rdp_count, SUM(rdp_net) AS rdp_net, SUM(volume_usd) AS volume_usd,
           ROUND_EVEN(SUM(CASE WHEN live_accounts > 0 THEN live_avg_score * live_accounts END)
                      / SUM(CASE WHEN live_accounts > 0 AND live_avg_score IS NOT NULL THEN live_accounts END), 1) AS live_avg_score,
           ROUND_EVEN(SUM(CASE WHEN ftd > 0 THEN ftd_avg_score * ftd END)
                      / SUM(CASE WHEN ftd > 0 AND ftd_avg_score IS NOT NULL THEN ftd END), 1) AS ftd_avg_score
    FROM ({table("COALESCE(c.sub_channel, '(Unassigned)')", "COALESCE(CAST(a.score AS STRING), '(Unassigned)')", "year", FILTER8)}) w"""), "", T_NUM,
    "leads live_accounts ftc ftd traders rdp_count")


def options(name: str, src: str, col: str) -> str:
    return (f"SELECT * FROM (SELECT DISTINCT '{name}' AS list, CAST({col} AS STRING) AS value FROM {src} WHERE {col} IS NOT NULL "
            f"AND TRIM(CAST({col} AS STRING)) <> '') {name}_q")


USED = "(SELECT * FROM agents WHERE agent_id IN (SELECT assigned_to FROM accounts WHERE assigned_to IS NOT NULL)) used"
SQL["R9_filter_lists"] = out(" UNION ALL ".join(options(*x) for x in (
    ("marketing_group", "campaigns", "marketing_group"), ("channel", "campaigns", "channel"), ("sub_channel", "campaigns", "sub_channel"),
    ("legacy_id", "campaigns", "legacy_id"), ("campaign_name", "campaigns", "name"), ("affiliate", "accounts", "affiliate"),
    ("country", "accounts", "country"), ("office", USED, "office_name"), ("agent", USED, "agent_name"), ("team", USED, "desk_name"))))

# ---- R10 -----------------------------------------------------------------------------------------------------
DAYS = f"(DATE '{LAST}' - CAST(a.qualified AS DATE))"
BUCKETS = (("0 - 7 days", 0, 7), ("8 - 14 days", 8, 14), ("15 - 30 days", 15, 30), ("31 - 60 days", 31, 60), ("61 - 90 days", 61, 90),
           ("91 - 120 days", 91, 120), ("120+ days", 121, 10 ** 6))
AGES = (("18-24", 18, 24), ("25-29", 25, 29), ("30-34", 30, 34), ("35-39", 35, 39), ("40-44", 40, 44), ("45-49", 45, 49), ("50+", 50, 999))


def bucket(v: str, rows, other: str, by_name: bool = True) -> str:
    return "CASE " + " ".join(f"WHEN {v} BETWEEN {lo} AND {hi} THEN " + (f"'{n}'" if by_name else str(i + 1))
                              for i, (n, lo, hi) in enumerate(rows)) + f" ELSE {other} END"


def aging(groups: list[tuple[str, str]], where: str = "", extra: str = "") -> str:
    names = [x for i in range(1, len(groups) + 1) for x in (f"g{i}", f"sort{i}")]
    sel = ", ".join(f"{g} AS g{i}, {s} AS sort{i}" for i, (g, s) in enumerate(groups, 1))
    labels = ", ".join(n for n in names if n.startswith("g"))
    sorts = ", ".join(f"MIN({n}) AS {n}" for n in names if n.startswith("sort"))
    return f"""
        SELECT {labels}, {sorts}, COUNT(*) AS ftc, COUNT(r.account_id) AS rdp, COALESCE(SUM(x.dep), 0) AS deposit, COALESCE(SUM(x.wd), 0) AS withdrawal,
               CAST(COALESCE(SUM(x.w), 0) AS BIGINT) AS wd_count, COUNT(tr.account_id) AS traders
        FROM (SELECT a.account_id, {sel} FROM accounts a LEFT JOIN agents u ON u.agent_id = a.assigned_to {extra}
              WHERE a.qualified >= DATE '1995-01-01' AND a.qualified < DATE '{LAST}' + INTERVAL '1' DAY AND a.is_test = 0 {where}) b
        LEFT JOIN (SELECT t.account_id, SUM({DEP}) AS dep, SUM({WDR}) AS wd, MAX(CASE WHEN t.type = 'Withdrawal' THEN 1 ELSE 0 END) AS w
                   FROM money t WHERE {OK} AND {NOBONUS} AND {rng('t.confirmed')} GROUP BY 1) x ON x.account_id = b.account_id
        LEFT JOIN (SELECT account_id FROM std WHERE has_second_deposit = 1 AND second_deposit_at < DATE '{LAST}' + INTERVAL '1' DAY) r
               ON r.account_id = b.account_id
        LEFT JOIN (SELECT DISTINCT l.account_id FROM (SELECT login, open_time, notional FROM positions UNION ALL SELECT login, open_time, notional FROM resolved) d
                   JOIN logins l ON l.login = d.login WHERE d.notional > 0 AND d.open_time < DATE '{LAST}' + INTERVAL '1' DAY) tr
               ON tr.account_id = b.account_id
        GROUP BY {labels}"""


def aging_rates(body: str) -> str:
    def pct(a: str) -> str:
        return f"CASE WHEN ftc > 0 THEN ROUND_EVEN(CAST({a} AS DOUBLE) / ftc * 100, 0) ELSE 0 END"
    return f"""SELECT * REPLACE (ROUND_EVEN(CAST(deposit AS DOUBLE), 0) AS deposit, ROUND_EVEN(CAST(withdrawal AS DOUBLE), 0) AS withdrawal),
        ROUND_EVEN(CAST(deposit - withdrawal AS DOUBLE), 0) AS net_deposit,
        CASE WHEN ftc > 0 THEN ROUND_EVEN(CAST(deposit - withdrawal AS DOUBLE) / ftc, 2) ELSE 0 END AS ltv, {pct('rdp')} AS pct_std,
        {pct('wd_count')} AS pct_wd_clients, CASE WHEN deposit > 0 THEN ROUND_EVEN(CAST(withdrawal AS DOUBLE) / CAST(deposit AS DOUBLE) * 100, 0) ELSE 0 END AS pct_wd_usd,
        {pct('traders')} AS traders_pct FROM ({body}) z"""


A1 = aging([(bucket(DAYS, BUCKETS, "'(Unknown)'"), bucket(DAYS, BUCKETS, "99", False))])
SQL["R10_aging"] = out(aging_rates(f"""
    SELECT * FROM ({A1}) q1 UNION ALL BY NAME
    SELECT 'Grand Total' AS g1, NULL AS sort1, SUM(ftc) AS ftc, SUM(rdp) AS rdp, SUM(deposit) AS deposit, SUM(withdrawal) AS withdrawal,
           SUM(wd_count) AS wd_count, SUM(traders) AS traders FROM ({A1}) q2"""), "", "", "sort1 ftc rdp wd_count traders")
AGE = age("a.birth_date", f"DATE '{LAST}'")
SQL["R10_aging_two_groups"] = out(aging_rates(aging(
    [(bucket(AGE, AGES, "'(Unknown)'"), bucket(AGE, AGES, "99", False)),
     (segment(f"DATE '{LAST}'"), "COALESCE(TRY_CAST(a.segment AS INTEGER), 99)")],
    "AND a.birth_date IS NOT NULL AND (a.score BETWEEN 6 AND 10 OR a.score IS NULL OR a.score NOT BETWEEN 1 AND 10)")), "", "", "sort1 sort2")
POT = "CAST(ROUND(TRY_CAST(a.potential AS DECIMAL(20, 6))) AS INTEGER)"
SQL["R10_aging_by_region"] = out(aging_rates(aging(
    [("CASE WHEN a.country IS NULL THEN '(Unassigned)' WHEN a.country = 'X23' THEN 'X23' WHEN a.country LIKE 'X1%' THEN 'Region one' ELSE 'Region two' END",
      "CAST(NULL AS INTEGER)"), (f"COALESCE(CAST({POT} AS STRING), '(Unassigned)')", POT)])), "", "", "sort1 sort2")

# ---- R11, R30 ------------------------------------------------------------------------------------------------
TRADED = f"""(SELECT rt.day, rt.account_id, rt.agent_id, {score('rt.day')} AS s_day, {score(f"DATE '{LAST}'")} AS s_ref, a.score, a.birth_date
    FROM traders rt JOIN accounts a ON a.account_id = rt.account_id JOIN agents u ON u.agent_id = rt.agent_id
    WHERE {NOTEST} AND u.dept = 'Retention' AND {rng('rt.day')})"""
PAID = f"""(SELECT t.*, CAST(t.confirmed AS DATE) AS day, {NET} AS net, a.score, a.birth_date
    FROM money t JOIN accounts a ON a.account_id = t.account_id JOIN agents u ON u.agent_id = t.owner
    WHERE {VALID} AND {LIVEACC} AND {NOTEST} AND u.dept = 'Retention' AND {rng('t.confirmed')})"""
DEPS = "COUNT(DISTINCT CASE WHEN type = 'Deposit' THEN account_id END) AS depositors, SUM(net) AS net"
SQL["R11_trader_series"] = out(f"""
    SELECT CAST(g.x AS DATE) AS day, COALESCE(t.traders, 0) AS traders, COALESCE(t.high, 0) AS high_traders, COALESCE(t.s, 0) AS avg_score,
           COALESCE(p.depositors, 0) AS depositors, COALESCE(p.net, 0) AS net
    FROM GENERATE_SERIES(TIMESTAMP '{FIRST} 00:00:00', TIMESTAMP '{LAST} 00:00:00', INTERVAL '1' DAY) g(x)
    LEFT JOIN (SELECT day, COUNT(DISTINCT account_id) AS traders, COUNT(DISTINCT CASE WHEN score BETWEEN 6 AND 10 THEN account_id END) AS high,
                      ROUND(AVG(s_day), 2) AS s FROM {TRADED} x GROUP BY 1) t ON t.day = CAST(g.x AS DATE)
    LEFT JOIN (SELECT day, {DEPS} FROM {PAID} y GROUP BY 1) p ON p.day = CAST(g.x AS DATE) WHERE ISODOW(g.x) < 6""", "day", "net")
SQL["R11_trader_totals"] = out(f"""
    SELECT t.traders, t.avg_score, p.depositors, p.net,
           CASE WHEN t.traders <> 0 THEN ROUND_EVEN(CAST(p.depositors AS DOUBLE) / t.traders * 100, 2) ELSE 0 END AS depositor_pct,
           CASE WHEN t.traders <> 0 THEN ROUND_EVEN(CAST(p.net AS DOUBLE) / t.traders, 2) ELSE 0 END AS ltv_traders,
           CASE WHEN p.depositors <> 0 THEN ROUND_EVEN(CAST(p.net AS DOUBLE) / p.depositors, 2) ELSE 0 END AS ltv_depositors
    FROM (SELECT COUNT(DISTINCT account_id) AS traders, ROUND(AVG(s_ref), 2) AS avg_score FROM {TRADED} x) t,
         (SELECT COUNT(DISTINCT CASE WHEN type = 'Deposit' THEN account_id END) AS depositors, COALESCE(SUM(net), 0) AS net FROM {PAID} y) p""", "", "net")


def matrix(day: str, s: str) -> str:
    d = "day" if day == "day" else "CAST(NULL AS DATE)"
    return f"""SELECT COALESCE(t.agent_id, p.agent_id) AS agent_id, COALESCE(t.day, p.day) AS day, COALESCE(t.traders, 0) AS traders, t.avg_score,
            COALESCE(p.depositors, 0) AS depositors, COALESCE(p.net, 0) AS net
        FROM (SELECT agent_id, {d} AS day, COUNT(DISTINCT account_id) AS traders, ROUND(AVG({s}), 2) AS avg_score FROM {TRADED} x GROUP BY 1, 2) t
        FULL JOIN (SELECT owner AS agent_id, {d} AS day, {DEPS} FROM {PAID} y GROUP BY 1, 2) p
          ON p.agent_id = t.agent_id AND p.day IS NOT DISTINCT FROM t.day"""


SQL["R11_agent_matrix"] = out(f"""
    SELECT m.*, COALESCE(u.office_name, 'N/A') AS office_name, COALESCE(u.department, 'N/A') AS dept_name,
           COALESCE(u.agent_name, u.full_name, 'N/A') AS agent_name
    FROM ({matrix('day', 's_day')} UNION ALL {matrix('all', 's_ref')}) m JOIN agents u ON u.agent_id = m.agent_id""", "day", "net")
QUAL = (f"CASE WHEN COALESCE(score, 0) BETWEEN 6 AND 10 THEN 'High' WHEN COALESCE(score, 0) BETWEEN 1 AND 5 THEN 'Low' "
        f"WHEN birth_date IS NOT NULL AND {age('birth_date', 'day')} >= 30 THEN 'High' WHEN birth_date IS NOT NULL THEN 'Low' ELSE 'N/A' END")
SQL["R30_quality_by_month"] = out(f"""
    SELECT month, quality, COALESCE(traders, 0) AS traders, COALESCE(depositors, 0) AS depositors, COALESCE(net, 0) AS net,
           CASE WHEN COALESCE(traders, 0) <> 0 THEN ROUND_EVEN(CAST(COALESCE(net, 0) AS DOUBLE) / traders, 2) ELSE 0 END AS net_per_trader
    FROM (SELECT CAST(DATE_TRUNC('month', day) AS DATE) AS month, {QUAL} AS quality, COUNT(DISTINCT account_id) AS traders FROM {TRADED} x GROUP BY 1, 2) t
    FULL JOIN (SELECT CAST(DATE_TRUNC('month', day) AS DATE) AS month, {QUAL} AS quality, {DEPS} FROM {PAID} y GROUP BY 1, 2) p USING (month, quality)""",
    "month", "net")
