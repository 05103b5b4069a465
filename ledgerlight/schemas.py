"""Explicit schemas of the stored tables and their keys."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = {
    "int": T.IntegerType(), "short": T.ShortType(), "long": T.LongType(), "str": T.StringType(),
    "date": T.DateType(), "ts": T.TimestampNTZType(), "bool": T.BooleanType(), "dbl": T.DoubleType(),
    "usd": T.DecimalType(20, 4), "cents": T.DecimalType(18, 2),
}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _NAMES[t]) for n, t in (f.split(":") for f in text.split())])


SCHEMAS: dict[str, T.StructType] = {
    "accounts": _schema(
        "account_id:long is_test:int is_demo:int country:str campaign:str affiliate:str compliance:str "
        "account_status:str sales_status:str retention_status:str assigned_to:long sales_rep:long funded:int "
        "created:ts qualified:ts segment:str birth_date:date potential:str score:int pep:int"),
    "money": _schema(
        "money_id:long account_id:long login:str approval:str raw_type:str type:str method:str subtype:str "
        "comment:str order_ref:str owner:long ftd:int usd:usd confirmed:ts created:ts modified:ts deleted:int"),
    "agents": _schema(
        "agent_id:long email:str full_name:str agent_name:str status:str team:str department:str dept:str "
        "desk:str desk_name:str office:str office_name:str position:str"),
    "bridge": _schema(
        "bridge_id:long account_id:long login:str equity:usd balance:usd deleted:int last_update:ts"),
    "deals": _schema(
        "ticket:long source:str login:long symbol:str cmd:int open_time:ts close_time:ts profit:usd swap:usd "
        "commission:usd notional:usd position_id:long entry:int sync_time:ts"),
    "balance_ops": _schema("ticket:long source:str login:long cmd:int comment:str close_time:ts profit:usd"),
    "positions": _schema(
        "position_id:long login:long cmd:int symbol:str open_time:ts notional:usd profit:usd swap:usd "
        "commission:usd last_update:ts"),
    "equity": _schema(
        "at:ts login:long source:str balance:usd floating:usd equity:usd closed_pnl:usd delta_floating:usd "
        "net_deposit:usd prev_equity:usd"),
    "platform_users": _schema("login:long source:str balance:usd credit:usd updated:ts"),
    "bonuses": _schema("money_id:long login:long amount:cents confirmed:ts locked:bool"),
    "snapshots": _schema("login:long day:date end_eez:cents start_eez:cents"),
    "threshold_clients": _schema(
        "account_id:long account_status:str qualified:ts assigned_to:long reached_at:ts reached_amount:cents "
        "owner:long net_now:cents net_until_qualified:cents"),
    "campaigns": _schema(
        "campaign_id:str legacy_id:str name:str channel:str sub_channel:str marketing_group:str"),
    "targets": _schema("month:date agent_id:str ftc:usd net:usd"),
    "company_targets": _schema("month:date sales_ftc:usd retention_net:usd"),
    "agents_master": _schema(
        "agent_name:str office_name:str email:str start_date:date target_group:str agent_id:long is_active:bool"),
    "agent_targets_history": _schema(
        "agent_name:str office_name:str email:str start_date:date target_group:str agent_id:long "
        "report_month:date tenure_months:int net_target:int ftd100_target:int"),
    "dept_history": _schema("agent_id:long report_dept:str valid_from:date valid_to:date"),
    "holidays": _schema("holiday:date description:str"),
    "retention_traders": _schema("day:date account_id:long agent_id:long"),
    "sync_log": _schema(
        "table_name:str cutoff:ts rows:long duration_ms:long status:str error:str ran_at:ts"),
    "qa_results": _schema(
        "report:str section:str check_name:str context:str expected:str actual:str diff:dbl pct_diff:dbl "
        "status:str message:str"),
}

KEYS: dict[str, list[str]] = {
    "accounts": ["account_id"], "money": ["money_id"], "agents": ["agent_id"], "bridge": ["bridge_id"],
    "deals": ["source", "ticket"], "balance_ops": ["source", "ticket"], "positions": ["position_id"],
    "equity": ["at", "login", "source"], "platform_users": ["login", "source"], "bonuses": ["money_id"],
    "snapshots": ["login", "day"], "threshold_clients": ["account_id"], "campaigns": ["campaign_id"],
    "targets": ["month", "agent_id"], "company_targets": ["month"], "agents_master": ["email"],
    "agent_targets_history": ["email", "report_month"], "dept_history": ["agent_id", "report_dept", "valid_from"],
    "holidays": ["holiday"], "retention_traders": ["day", "account_id"],
}
