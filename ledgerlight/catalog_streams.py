"""Registered queries of the incremental feeds: streams over the driver's files, run until all files are read.

Results are written under the session's shared checkpoint folder and read back from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ledgerlight.catalog import FIRST, Domain, query
from ledgerlight.functions import money as m
from ledgerlight.plans import jobs, scoreboards as sb, views
from ledgerlight.schemas import _schema
from ledgerlight.sources import feeds, tables
from ledgerlight.sources.driver_tables import VIEWS
from ledgerlight.streaming import feeds as streams


def _folder(d: Domain) -> str:
    return f"{tables.workspace(d.spark)}/run-{uuid.uuid4().hex}"


def _money_stream(d: Domain) -> DataFrame:
    """The money view over a stream of the order files."""
    d.register("money")
    orders = streams.read_files(d.spark, d.folder, d.base("orders").schema, name_filter="orders.parquet*")
    name = f"orders_stream_{uuid.uuid4().hex}"
    orders.createOrReplaceTempView(name)
    return d.spark.sql(VIEWS["money"].format(TS="TIMESTAMP_NTZ").replace("FROM orders", f"FROM {name}"))


@query
def I1_stream_merge(d: Domain):
    """Payments merged by key from a stream into a stored table; each row is delivered twice."""
    root = _folder(d)
    stream = _money_stream(d).select("money_id", "account_id", "type", "usd", "confirmed", "created")
    schema = _schema("money_id:long account_id:long type:str usd:usd confirmed:ts created:ts")
    table = tables.PartitionedTable(d.spark, f"{root}/money", ["money_id"], schema, "created_year", F.year("created"))
    streams.merge_stream(stream.unionByName(stream), table, ["confirmed"], f"{root}/checkpoint").awaitTermination()
    return table.read().drop("created", "created_year")


@query
def I3_resume_after_max(d: Domain):
    """Payments with an id above the greatest stored one; the ids of the account table stand for the stored copy."""
    stored = d.raw_platform_accounts.select(F.col("platform_account_id").alias("payment_id"))
    return feeds.resume_after_max(d.raw_payments, stored, "payment_id").select("payment_id", "user_id")


@query
def I4_stream_deduplicated(d: Domain):
    """Payments delivered twice, kept once, however late the second delivery is."""
    root = _folder(d)
    stream = _money_stream(d).select("money_id", "type", "usd", "confirmed")
    table = tables.PartitionedTable(d.spark, f"{root}/rows", ["money_id"], _schema("money_id:long type:str usd:usd confirmed:ts"),
                                    "confirmed_year", F.year("confirmed"))
    streams.merge_stream(stream.unionByName(stream), table, ["confirmed"], f"{root}/checkpoint").awaitTermination()
    return table.read().drop("confirmed_year")


@query
def I5_M16_reprocessed_days(d: Domain):
    """Daily snapshots stored by day, then a range of days recomputed and replaced."""
    path = f"{_folder(d)}/snapshots"
    tables.write_days(jobs.equity_snapshots(d.equity, d.bonuses, d.bridge, d.accounts, clamp_bonus=True), path)
    streams.reprocess(d.snapshots, path, "1998-12-25", "1999-01-20", "day")
    return d.spark.read.parquet(path).select("login", F.col("day").cast("date").alias("day"), "end_eez", "start_eez")


@query
def I6_stream_daily_totals(d: Domain):
    """Additive day totals by owner, of the days that each batch of the stream touches."""
    root = _folder(d)
    rows = _money_stream(d).where(F.col("owner").isNotNull() & m.valid_money())
    ledger = tables.PartitionedTable(d.spark, f"{root}/ledger", ["money_id"], rows.schema, "confirmed_year", F.year("confirmed"))
    streams.write_daily_totals(rows, ledger, f"{root}/totals", ["confirmed"], f"{root}/checkpoint").awaitTermination()
    return d.spark.read.parquet(f"{root}/totals").select("agent_id", F.col("tx_date").cast("date").alias("tx_date"), *streams.MEASURES)


def _refreshed(d: Domain) -> tuple[dict[str, tables.VersionedTable], tables.Audit]:
    """Two views, one on top of the other, rebuilt into stored tables in dependency order."""
    root = _folder(d)
    targets = {n: tables.VersionedTable(d.spark, f"{root}/{n}", ["agent_id"]) for n in ("daily_kpis", "run_rate_base")}
    build = {"daily_kpis": lambda: d.kpis, "run_rate_base": lambda: views.run_rate_base(targets["daily_kpis"].read(), d.agents)}
    log = tables.Audit(d.spark, f"{root}/log")
    tables.refresh(build, targets, [n for n in views.build_order() if n in targets], log)
    return targets, log


@query
def V9_stored_views(d: Domain):
    """The run rate, read from the table that a refresh stored."""
    return _refreshed(d)[0]["run_rate_base"].read()


@query
def M15_audit_rows(d: Domain):
    """What the refresh logged: a row for each view with its number of rows and how it ended."""
    return _refreshed(d)[1].read().select("table_name", "rows", "status", "error")


@query
def R13_targets_by_source(d: Domain):
    """Targets of one month from either side of the switch between the two target tables."""
    history = d.targets.select(F.col("month").alias("report_month"), F.expr("try_cast(agent_id AS bigint)").alias("agent_id"),
                               F.col("ftc").cast("int").alias("ftd100_target"), F.col("net").alias("net_target"))
    sides = {"plan": "2099-01-01", "history": "1990-01-01"}
    parts = [sb.targets_for(FIRST, d.targets, history, switch).select(F.lit(side).alias("side"), "agent_id", "target_ftc", "target_net")
             for side, switch in sides.items()]
    return parts[0].unionByName(parts[1])
