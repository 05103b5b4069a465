"""Adapter views: the domain tables as projections of the driver's star-schema tables.

Each view is one SELECT that Spark and DuckDB read alike; only the name of the zone-free timestamp type
differs, filled in for {TS}. The arithmetic on keys spreads the categories, flags and missing values the
reports handle over all rows; no view drops rows to make a query smaller.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_AGENTS_N = "(SELECT COUNT(*) FROM supplier)"
_LOGINS_N = "(SELECT COUNT(*) * 2 FROM customer)"
# equity, bonus and balance rows are moved from January 2024 into the time range of the orders
_AT = "ts - INTERVAL '9146' DAY"

VIEWS: dict[str, str] = {
    "agents": """
        SELECT s.s_suppkey AS agent_id,
               ' ' || LOWER(s.s_name) || '@desk.example ' AS email,
               CASE WHEN s.s_suppkey % 19 = 17 THEN 'Test ' || s.s_name ELSE s.s_name END AS full_name,
               CASE WHEN s.s_suppkey % 19 = 17 THEN ' TEST ' || s.s_name
                    WHEN s.s_suppkey % 23 = 21 THEN 'Duplicated ' || s.s_name
                    WHEN s.s_suppkey % 29 = 5 THEN NULL ELSE s.s_name END AS agent_name,
               CASE WHEN s.s_suppkey % 7 = 6 THEN 'Inactive' ELSE 'Active' END AS status,
               CASE WHEN s.s_suppkey % 2 = 0 AND s.s_suppkey % 5 <> 3 THEN 'Conversion' ELSE 'Loyalty' END AS team,
               CASE WHEN s.s_suppkey % 13 = 3 THEN 'General Desk' WHEN s.s_suppkey % 17 = 9 THEN 'Support 2'
                    WHEN s.s_suppkey % 31 = 7 THEN NULL
                    ELSE 'Team ' || CAST(s.s_suppkey % 4 AS STRING) END AS department,
               CASE WHEN s.s_suppkey % 2 = 0 THEN 'Sales' ELSE 'Retention' END AS dept,
               'Desk ' || n.n_name AS desk, 'Desk ' || CAST(s.s_suppkey % 6 AS STRING) AS desk_name,
               CASE r.r_name WHEN 'EUROPE' THEN 'GMT' WHEN 'AFRICA' THEN 'SA' WHEN 'ASIA' THEN 'CY'
                    WHEN 'AMERICA' THEN 'LAG-NG' ELSE 'DU' END AS office,
               n.n_name AS office_name,
               CASE WHEN s.s_suppkey % 11 = 0 THEN 'Team Leader' ELSE 'Agent' END AS position
        FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
             JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "accounts": f"""
        SELECT c_custkey AS account_id,
               CASE WHEN c_custkey % 97 = 13 THEN 1 ELSE 0 END AS is_test,
               CASE WHEN c_custkey % 11 = 3 THEN NULL WHEN c_custkey % 89 = 1 THEN 1 ELSE 0 END AS is_demo,
               CASE c_nationkey WHEN 0 THEN 'CM' WHEN 1 THEN 'KE' WHEN 2 THEN 'SE' WHEN 3 THEN 'ZM'
                    WHEN 4 THEN 'DK' WHEN 5 THEN 'NL' WHEN 6 THEN 'ES' WHEN 7 THEN 'FI' WHEN 8 THEN 'NO'
                    WHEN 9 THEN 'AW' WHEN 24 THEN NULL ELSE 'X' || CAST(c_nationkey AS STRING) END AS country,
               CASE WHEN c_custkey % 17 = 4 THEN NULL
                    ELSE CAST(c_custkey % (SELECT COUNT(*) FROM part) AS STRING) || '.0' END AS campaign,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS affiliate,
               CASE WHEN c_custkey % 10 = 7 THEN NULL ELSE CAST(c_custkey % 10 AS STRING) END AS compliance,
               CASE WHEN c_custkey % 3 = 0 THEN 'Sales' ELSE 'Retention' END AS account_status,
               CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 8 AS STRING) END AS sales_status,
               CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 9 AS STRING) END AS retention_status,
               CASE WHEN c_custkey % 37 = 5 THEN NULL ELSE c_custkey % {_AGENTS_N} END AS assigned_to,
               CASE WHEN c_custkey % 12 = 5 THEN NULL ELSE c_custkey % 40 END AS sales_rep,
               CASE WHEN c_custkey % 4 = 1 THEN 0 ELSE 1 END AS funded,
               CASE WHEN c_custkey % 59 = 6 THEN NULL
                    ELSE CAST(DATE '1994-06-01' + CAST(c_custkey * 7 % 2500 AS INT) AS {{TS}})
                         + INTERVAL '15' HOUR END AS created,
               CASE WHEN c_custkey % 5 = 4 THEN NULL
                    ELSE CAST(DATE '1995-03-01' + CAST(c_custkey * 13 % 2300 AS INT) AS {{TS}})
                         + INTERVAL '9' HOUR END AS qualified,
               CASE c_custkey % 8 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4'
                    WHEN 4 THEN '17' WHEN 5 THEN '0' WHEN 6 THEN NULL ELSE '9' END AS segment,
               CASE WHEN c_custkey % 7 = 2 THEN NULL
                    ELSE DATE '1935-02-28' + CAST(c_custkey * 37 % 17500 AS INT) END AS birth_date,
               CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN CAST(c_custkey % 13 AS STRING) || '.7'
                    ELSE CAST(c_custkey % 13 AS STRING) END AS potential,
               CASE WHEN c_custkey % 6 < 2 THEN NULL ELSE CAST(c_custkey % 13 AS INT) END AS score,
               CASE WHEN c_custkey % 53 = 4 THEN 1 ELSE 0 END AS pep
        FROM customer""",
    "money": f"""
        SELECT o_orderkey AS money_id, o_custkey AS account_id,
               CAST(o_custkey * 2 + o_orderkey % 2 AS STRING) AS login,
               CASE WHEN o_orderkey % 12 = 7 THEN 'Pending' ELSE 'Approved' END AS approval,
               CASE WHEN o_orderkey % 23 = 9 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Deposit' ELSE 'Withdrawal' END
                    WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'Withdrawal'
                    WHEN o_orderstatus = 'P' THEN 'Withdrawal' ELSE 'Deposit' END AS raw_type,
               CASE WHEN o_orderkey % 23 = 9 THEN 'Bonus'
                    WHEN o_orderstatus = 'F' THEN 'Deposit'
                    WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'Withdrawal Cancelled'
                    WHEN o_orderstatus = 'O' THEN 'Deposit'
                    WHEN o_orderkey % 3 = 0 THEN 'Deposit Cancelled' ELSE 'Withdrawal' END AS type,
               CASE WHEN o_orderkey % 13 = 5 THEN 'Loyalty BONUS credit' WHEN o_orderkey % 13 = 6 THEN NULL
                    ELSE o_orderpriority END AS comment,
               CASE WHEN o_orderkey % 43 = 8 THEN NULL ELSE o_orderkey % {_AGENTS_N} END AS owner,
               CASE o_orderkey % 9 WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE 0 END AS ftd,
               CAST(CAST(CAST(FLOOR(o_totalprice / 40) AS BIGINT)
                         * (CASE WHEN o_orderkey % 20 = 6 THEN 50 ELSE 1 END) AS DECIMAL(16, 0))
                    * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(20, 4)) AS usd,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 5 AS INT) AS confirmed,
               o_orderdate AS created,
               o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 3 AS INT) AS modified,
               CASE WHEN o_orderkey % 17 = 0 THEN 1 WHEN o_orderkey % 5 = 1 THEN NULL ELSE 0 END AS deleted
        FROM orders""",
    "raw_money": """
        SELECT o_orderkey AS money_id,
               CASE o_orderkey % 9 WHEN 0 THEN 'Deposit' WHEN 1 THEN 'Withdrawal' WHEN 2 THEN 'Withdraw'
                    WHEN 3 THEN 'Credit In' WHEN 4 THEN 'Credit Out' WHEN 5 THEN 'Fee' WHEN 6 THEN 'TransferIn'
                    WHEN 7 THEN 'TransferOut' ELSE 'Deposit' END AS raw_type,
               CASE CAST(FLOOR(o_orderkey / 9.0) AS BIGINT) % 14 WHEN 0 THEN 'Adjustment' WHEN 1 THEN 'Commission'
                    WHEN 2 THEN 'IB commission' WHEN 3 THEN 'FRF commission' WHEN 4 THEN 'Bonus'
                    WHEN 5 THEN 'Credit card' WHEN 6 THEN 'Wire transfer' WHEN 7 THEN 'Chargeback'
                    WHEN 8 THEN 'Processing fees' WHEN 9 THEN 'ProcessingFee' WHEN 10 THEN 'Transfer'
                    WHEN 11 THEN 'None' WHEN 12 THEN NULL ELSE 'Adjustment' END AS method,
               CASE CAST(FLOOR(o_orderkey / 126.0) AS BIGINT) % 6 WHEN 0 THEN 'IB Commission'
                    WHEN 1 THEN 'FRF Commission' WHEN 2 THEN 'Deposit Void' WHEN 3 THEN 'Withdrawal Void'
                    WHEN 4 THEN 'Gift' ELSE NULL END AS subtype,
               CAST(DATE '2022-10-20' + CAST(o_orderkey % 90 AS INT) AS {TS}) AS created,
               CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN CAST(o_orderkey AS STRING) || '.'
                    WHEN 2 THEN CAST(o_orderkey AS STRING) || '.7' WHEN 3 THEN 'ref-' || CAST(o_orderkey AS STRING)
                    ELSE CAST(o_orderkey * 7 % 1009 AS STRING) END AS order_ref
        FROM orders""",
    "balance_ops": """
        SELECT o_orderkey AS ticket, CASE WHEN o_orderkey % 6 = 5 THEN 1 ELSE 6 END AS cmd,
               o_custkey * 2 AS login,
               CASE o_orderkey % 22 WHEN 0 THEN 'Affiliate Payment To Trading Pl' WHEN 1 THEN 'IB Commission PayOut Void'
                    WHEN 2 THEN 'IB Commission' WHEN 3 THEN 'IB Commission Void' WHEN 4 THEN 'IB Commission PayOut'
                    WHEN 5 THEN 'FRF PayOut Void' WHEN 6 THEN 'FRF - Transfer to Balance'
                    WHEN 7 THEN 'FRF - Transfer to Balance Void' WHEN 8 THEN 'FRF PayOut'
                    WHEN 9 THEN 'old frf commission paid' WHEN 10 THEN 'FRF' WHEN 11 THEN 'FRF Void'
                    WHEN 12 THEN 'Cash ADVANCE' WHEN 13 THEN 'CashBack Bonus' WHEN 14 THEN 'x Transfer to Balance y'
                    WHEN 15 THEN 'Bonus Transfer to Balance Cancelled' WHEN 16 THEN 'Bonus PayOut Void'
                    WHEN 17 THEN 'Bonus PayOut' WHEN 18 THEN 'Deposit Void' WHEN 19 THEN 'Withdrawal Void'
                    WHEN 20 THEN 'wire TRANSFER in' ELSE NULL END AS comment,
               o_orderdate AS close_time,
               CAST(CAST(FLOOR(o_totalprice / 40) AS BIGINT) AS DECIMAL(16, 0))
                    * CAST(0.01 AS DECIMAL(3, 2)) AS profit
        FROM orders""",
    "bridge": """
        SELECT c_custkey * 2 AS bridge_id, c_custkey AS account_id,
               CASE WHEN c_custkey % 211 = 5 THEN 'n/a' ELSE CAST(c_custkey * 2 AS STRING) END AS login,
               CAST(c_acctbal AS DECIMAL(20, 4)) AS equity, CAST(c_acctbal AS DECIMAL(20, 4)) AS balance,
               CASE WHEN c_custkey % 61 = 9 THEN 1 WHEN c_custkey % 3 = 0 THEN NULL ELSE 0 END AS deleted
        FROM customer
        UNION ALL
        SELECT c_custkey * 2 + 1, c_custkey, CAST(c_custkey * 2 + 1 AS STRING),
               CAST(c_acctbal AS DECIMAL(20, 4)), CAST(c_acctbal AS DECIMAL(20, 4)), 0
        FROM customer
        UNION ALL
        SELECT -1 - c_custkey, (c_custkey + 7) % (SELECT COUNT(*) FROM customer), CAST(c_custkey * 2 AS STRING),
               CAST(c_acctbal AS DECIMAL(20, 4)), CAST(c_acctbal AS DECIMAL(20, 4)), 0
        FROM customer WHERE c_acctbal < 0""",
    "deals": f"""
        SELECT l_orderkey * 8 + l_linenumber AS ticket, 'S' || CAST(l_orderkey % 2 AS STRING) AS source,
               l_orderkey % {_LOGINS_N} AS login,
               CASE l_partkey % 9 WHEN 0 THEN 'Dividend' WHEN 1 THEN 'Rollover' WHEN 2 THEN 'XAUUSD'
                    WHEN 3 THEN 'GBPUSD' ELSE 'EURUSD' END AS symbol,
               CAST(l_suppkey % 3 AS INT) AS cmd,
               l_shipdate + INTERVAL '1' HOUR * l_linenumber AS open_time,
               CASE WHEN l_linenumber = 7 THEN CAST('1970-01-01 00:00:00' AS {{TS}})
                    ELSE l_shipdate + INTERVAL '3' HOUR * l_linenumber END AS close_time,
               CAST(CAST(l_extendedprice AS DECIMAL(16, 2))
                    * (CAST(l_discount AS DECIMAL(4, 2)) - CAST(0.05 AS DECIMAL(4, 2))) AS DECIMAL(20, 4)) AS profit,
               CAST(l_tax AS DECIMAL(20, 4)) AS swap, CAST(-l_quantity AS DECIMAL(20, 4)) AS commission,
               CAST(l_extendedprice AS DECIMAL(20, 4)) AS notional, l_orderkey AS position_id,
               CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS entry, l_shipdate AS sync_time
        FROM lineitem""",
    "positions": f"""
        SELECT l_orderkey * 8 + l_linenumber AS position_id, l_orderkey % {_LOGINS_N} AS login,
               CAST(l_suppkey % 3 AS INT) AS cmd,
               CASE l_partkey % 9 WHEN 0 THEN 'Dividend' WHEN 1 THEN 'Rollover' WHEN 2 THEN 'XAUUSD'
                    WHEN 3 THEN 'GBPUSD' ELSE 'EURUSD' END AS symbol,
               l_shipdate + INTERVAL '1' HOUR * l_linenumber AS open_time,
               CASE WHEN l_partkey % 10 = 3 THEN CAST(0 AS DECIMAL(20, 4))
                    ELSE CAST(l_extendedprice AS DECIMAL(20, 4)) END AS notional,
               CAST(CAST(l_extendedprice AS DECIMAL(16, 2))
                    * (CAST(l_discount AS DECIMAL(4, 2)) - CAST(0.05 AS DECIMAL(4, 2))) AS DECIMAL(20, 4)) AS profit,
               CAST(l_tax AS DECIMAL(20, 4)) AS swap, CAST(-l_quantity AS DECIMAL(20, 4)) AS commission,
               l_shipdate AS last_update
        FROM lineitem WHERE l_returnflag = 'N'""",
    "equity": f"""
        SELECT {_AT} AS at, user_id AS login, 'S' || CAST(event_id % 2 AS STRING) AS source,
               CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(value AS DECIMAL(20, 4)) * 10 END AS balance,
               CASE WHEN event_id % 499 = 7 THEN CAST(150000000 AS DECIMAL(20, 4))
                    WHEN event_type = 'error' THEN CAST(value AS DECIMAL(20, 4)) * -12
                    WHEN event_type = 'view' THEN CAST(value AS DECIMAL(20, 4)) * -1
                    ELSE CAST(value AS DECIMAL(20, 4)) END AS floating,
               CAST(value AS DECIMAL(20, 4)) * 9 - 20 AS equity,
               CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(20, 4)) ELSE NULL END AS closed_pnl,
               CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(20, 4)) * -1
                    ELSE CAST(value AS DECIMAL(20, 4)) END AS delta_floating,
               CASE WHEN event_type = 'signup' THEN CAST(value AS DECIMAL(20, 4)) ELSE NULL END AS net_deposit,
               CAST(value AS DECIMAL(20, 4)) * 8 - 15 AS prev_equity
        FROM events""",
    "bonuses": f"""
        SELECT event_id AS money_id, user_id AS login,
               CASE WHEN event_id % 3 = 0 THEN CAST(value AS DECIMAL(18, 2)) * -2
                    ELSE CAST(value AS DECIMAL(18, 2)) END AS amount,
               {_AT} AS confirmed, event_id % 10 = 0 AS locked
        FROM events WHERE event_type = 'signup'""",
    "platform_users": f"""
        SELECT user_id AS login, 'S' || CAST(event_id % 2 AS STRING) AS source,
               MAX_BY(CAST(value AS DECIMAL(20, 4)) * 10 - 60, ts) AS balance,
               MAX_BY(CAST(event_id % 50 AS DECIMAL(20, 4)), ts) AS credit, MAX({_AT}) AS updated
        FROM events GROUP BY user_id, 'S' || CAST(event_id % 2 AS STRING)""",
    "campaigns": """
        SELECT CAST(p_partkey AS STRING) AS campaign_id, 'L' || CAST(p_size AS STRING) AS legacy_id,
               p_name AS name,
               p_type || CASE p_partkey % 8 WHEN 0 THEN ' IB' WHEN 1 THEN ' PPC' WHEN 2 THEN ' Media'
                    WHEN 3 THEN ' Affiliate' WHEN 4 THEN ' Direct' WHEN 5 THEN ' Refer a friend'
                    WHEN 6 THEN ' White label' ELSE ' Organic search' END AS channel,
               CASE WHEN p_partkey % 10 = 4 THEN NULL ELSE p_brand END AS sub_channel,
               CASE p_partkey % 8 WHEN 0 THEN 'IB' WHEN 1 THEN 'PPC' WHEN 2 THEN 'Media' WHEN 3 THEN 'Affiliates'
                    WHEN 4 THEN 'Organic' WHEN 5 THEN 'FRF' WHEN 6 THEN 'White Label'
                    ELSE 'Organic' END AS marketing_group
        FROM part""",
    "targets": """
        SELECT DATE '1995-01-01' AS month, CAST(s_suppkey AS STRING) AS agent_id,
               CAST(s_suppkey % 13 AS DECIMAL(20, 4)) AS ftc,
               CASE WHEN s_suppkey % 10 = 7 THEN CAST(0 AS DECIMAL(20, 4))
                    ELSE CAST(ABS(s_acctbal) AS DECIMAL(20, 4)) END AS net
        FROM supplier""",
    "company_targets": """
        SELECT DATE '1995-01-01' AS month, CAST(COUNT(*) * 9 AS DECIMAL(20, 4)) AS sales_ftc,
               CAST(COUNT(*) * 5000 AS DECIMAL(20, 4)) AS retention_net
        FROM supplier""",
    "sync_log": f"""
        SELECT event_type AS table_name, {_AT} - INTERVAL '1' HOUR AS cutoff, event_id % 1000 AS rows,
               event_id % 5000 AS duration_ms, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status,
               CASE WHEN event_id % 7 = 0 THEN 'timeout' ELSE NULL END AS error, event_id AS run_id, {_AT} AS ran_at
        FROM events""",
    "dept_history": """
        SELECT s_suppkey AS agent_id, CASE WHEN s_suppkey % 4 = 2 THEN 'Retention' ELSE 'Sales' END AS report_dept,
               DATE '1993-01-01' + CAST(s_suppkey * 97 % 3600 AS INT) AS valid_from,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL
                    ELSE DATE '1993-01-01' + CAST(s_suppkey * 97 % 3600 + 400 AS INT) END AS valid_to
        FROM supplier""",
    # ---- source-system tables the pulls read -------------------------------------------------------------
    "raw_users": f"""
        SELECT c_custkey AS user_id, CASE WHEN c_custkey % 97 = 13 THEN 1 ELSE 0 END AS is_test,
               CASE WHEN c_custkey % 89 = 1 THEN 1 ELSE 0 END AS is_demo, 'N' || CAST(c_nationkey AS STRING) AS country,
               CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(c_custkey % 4 AS INT) END AS gender,
               CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS acquisition,
               CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % {_AGENTS_N} END AS sales_rep, 900 + c_custkey % 5 AS sales_desk,
               CASE WHEN c_custkey % 6 = 1 THEN 0 ELSE (c_custkey + 1) % {_AGENTS_N} END AS retention_rep,
               950 + c_custkey % 5 AS retention_desk,
               CAST(DATE '1994-06-01' + CAST(c_custkey * 7 % 2500 AS INT) AS {{TS}}) + INTERVAL '22' HOUR AS creation_time,
               CAST(DATE '1994-08-01' + CAST(c_custkey * 11 % 2500 AS INT) AS {{TS}}) AS updated,
               DATE '1898-06-01' + CAST(c_custkey * 37 % 30000 AS INT) AS date_of_birth, CAST(c_custkey % 6 AS INT) AS app_id
        FROM customer""",
    "raw_user_info": """
        SELECT c_custkey AS user_id, CAST(DATE '1995-01-01' + CAST(c_custkey * 19 % 2400 AS INT) AS {TS}) AS last_contact,
               CASE WHEN c_custkey % 5 = 4 THEN NULL
                    ELSE CAST(DATE '1995-03-01' + CAST(c_custkey * 13 % 2300 AS INT) AS {TS}) + INTERVAL '23' HOUR END AS qualification_time,
               CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN CAST(c_custkey % 13 AS STRING) || '.7'
                    ELSE CAST(c_custkey % 13 AS STRING) END AS potential,
               CAST(c_custkey % 200 AS STRING) || '.0' AS tracking_campaign,
               CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1000000 ELSE NULL END AS customer_ref,
               CAST(DATE '1995-01-01' AS {TS}) AS updated
        FROM customer WHERE c_acctbal >= 0""",
    "raw_user_totals": """
        SELECT c_custkey AS user_id, CAST(c_acctbal AS DECIMAL(20, 4)) AS balance, CAST(c_acctbal AS DECIMAL(20, 4)) * 2 AS net_deposit,
               1 AS latest FROM customer
        UNION ALL SELECT c_custkey, CAST(0 AS DECIMAL(20, 4)), CAST(0 AS DECIMAL(22, 4)), 0 FROM customer""",
    "raw_apps": "SELECT r_regionkey AS app_id, LOWER(r_name) AS app_name FROM region",
    "raw_payments": f"""
        SELECT o_orderkey AS payment_id, o_custkey AS user_id, o_custkey * 2 + o_orderkey % 2 AS platform_account_id,
               CASE WHEN o_orderkey % 101 = 50 THEN CAST(2000000000 AS BIGINT) ELSE CAST(FLOOR(o_totalprice) AS BIGINT) END AS amount_cents,
               CAST(o_orderkey % 5 AS INT) AS method_key, CAST(o_orderkey % 4 AS INT) AS status_key, CAST(o_orderkey % 3 AS INT) AS type_key,
               CAST(o_orderkey % 2 AS INT) AS acquisition, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % {_AGENTS_N} END AS sales_rep,
               (o_orderkey + 3) % {_AGENTS_N} AS retention_rep, CASE WHEN o_orderkey % 9 = 2 THEN 1 ELSE 0 END AS is_ftd,
               o_orderdate + INTERVAL '23' HOUR AS decision_time, o_orderdate AS creation_time,
               o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 3 AS INT) AS updated
        FROM orders""",
    "raw_platform_accounts": " UNION ALL ".join(f"""
        SELECT c_custkey * 2 + {k} AS platform_account_id, c_custkey AS user_id, CAST(c_custkey * 2 + {k} AS STRING) AS external_id,
               CASE WHEN c_custkey % 20 = 7 THEN 1 ELSE 0 END AS is_demo, CAST(ROUND(c_acctbal * 100) AS BIGINT) AS equity_cents,
               CAST(ROUND(c_acctbal * 50) AS BIGINT) AS balance_cents, CASE WHEN c_custkey % 61 = 9 THEN 1 ELSE 0 END AS is_deleted,
               CAST(DATE '1995-01-01' + CAST(c_custkey * 5 % 2400 AS INT) AS {{TS}}) AS updated
        FROM customer""" for k in (0, 1)),
    "raw_lookups": """
        SELECT 'status' AS kind, 0 AS key, 'Success' AS value UNION ALL SELECT 'status', 1, 'Pending'
        UNION ALL SELECT 'status', 2, 'Declined' UNION ALL SELECT 'type', 0, 'Deposit' UNION ALL SELECT 'type', 1, 'Withdrawal'
        UNION ALL SELECT 'method', 0, 'Credit card' UNION ALL SELECT 'method', 1, 'Wire' UNION ALL SELECT 'method', 2, 'Cash'
        UNION ALL SELECT 'channel', 0, 'Google PPC' UNION ALL SELECT 'channel', 1, 'IB network' UNION ALL SELECT 'channel', 2, 'Direct'
        UNION ALL SELECT 'sub_channel', 0, 'brand' UNION ALL SELECT 'sub_channel', 1, 'generic'""",
    "raw_operators": """
        SELECT s_suppkey AS operator_id, 'Op' || CAST(s_suppkey AS STRING) || '.van.' || SUBSTRING(s_name, 10, 10) AS full_name,
               CASE WHEN s_suppkey % 7 = 6 THEN 0 ELSE 1 END AS is_active, CAST(s_suppkey % 7 AS INT) AS role_id,
               CAST(DATE '1998-01-01' + CAST(s_suppkey * 11 % 700 AS INT) AS {TS}) AS updated
        FROM supplier""",
    "raw_operator_desks": """
        SELECT s_suppkey AS operator_id, 900 + s_nationkey AS desk_id FROM supplier
        UNION ALL SELECT s_suppkey, 900 + (s_nationkey + 9) % 25 FROM supplier""",
    "raw_desks": """
        SELECT 900 + n_nationkey AS desk_id, CASE WHEN n_nationkey % 3 = 0 THEN 'Conversion ' ELSE 'Retention ' END
               || '- ' || n_name || ' - Team ' || CAST(n_nationkey % 4 AS STRING) AS desk_name, n_regionkey AS office_id
        FROM nation""",
    "raw_offices": """
        SELECT r_regionkey AS office_id, CASE r_name WHEN 'EUROPE' THEN 'GMT' WHEN 'AFRICA' THEN 'SA' WHEN 'ASIA' THEN 'CY'
               WHEN 'AMERICA' THEN 'LAG-NG' ELSE '' END AS office FROM region""",
    "raw_roles": """
        SELECT 0 AS role_id, 'Sales Agent' AS role_name UNION ALL SELECT 1, 'Retention Agent' UNION ALL SELECT 2, 'Super Admin'
        UNION ALL SELECT 3, 'Dialer' UNION ALL SELECT 4, 'BDM' UNION ALL SELECT 5, 'Team Leader'""",
    "raw_campaigns": """
        SELECT CAST(p_partkey AS STRING) AS campaign_id, CASE WHEN p_size = 1 THEN NULL ELSE p_size END AS external_id, p_name AS name,
               CAST(p_partkey % 4 AS INT) AS channel_key, CAST(p_partkey % 3 AS INT) AS sub_channel_key,
               CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS is_deleted FROM part""",
    "agents_master": """
        SELECT s_name AS agent_name, CASE WHEN s_suppkey % 5 = 2 THEN ' General' ELSE n_name END AS office_name,
               UPPER(s_name) || '@DESK.example' AS email,
               CASE WHEN s_suppkey % 11 = 4 THEN NULL
                    ELSE DATE '1998-01-31' + CAST(s_suppkey * 17 % 900 AS INT) END AS start_date,
               'G' || CAST(s_suppkey % 2 AS STRING) AS target_group,
               CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_suppkey END AS agent_id, s_suppkey % 7 <> 6 AS is_active
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
}


_schemas: dict[tuple[str, str], StructType] = {}   # (folder, table) -> schema, read from the files once


class Tables:
    """Domain tables of one driver folder, built on demand as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._cache: dict[str, DataFrame] = {}
        self._registered: set[str] = set()

    def base(self, name: str) -> DataFrame:
        path, key = f"{self.folder}/{name}.parquet", (self.folder, name)
        if key not in _schemas:
            _schemas[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[key]).parquet(path)

    def register(self, view: str) -> None:
        """Make the base tables a view reads known to SQL."""
        for name in set(BASE) & set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", VIEWS[view])) - self._registered:
            self.base(name).createOrReplaceTempView(name)
            self._registered.add(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._cache:
            self.register(name)
            self._cache[name] = self.spark.sql(VIEWS[name].format(TS="TIMESTAMP_NTZ"))
        return self._cache[name]


def view_sql(name: str) -> str:
    """The same view for DuckDB."""
    return VIEWS[name].format(TS="TIMESTAMP")
