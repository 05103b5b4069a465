"""Registered queries over stored tables that change in batches: views kept by signed changes, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlight.catalog import Domain, query
from ledgerlight.catalog_queries import _ftcs
from ledgerlight.catalog_streams import _folder
from ledgerlight.functions import money as m
from ledgerlight.operators import changes as ch, distinct
from ledgerlight.plans import bonuses, equity, views
from ledgerlight.plans.incremental import KeptViews
from ledgerlight.schemas import _schema
from ledgerlight.sources import search, tables
from ledgerlight.streaming import feeds as streams, state


def batches(money: DataFrame, accounts: DataFrame) -> list[dict[str, DataFrame]]:
    """The ledgers as three batches of changes that end in the tables themselves.

    First the older payments as first seen (some pending, with another owner and a later confirmation, some booked twice)
    and all accounts before they were qualified. Then the next payments, the payments' final form and half of the accounts.
    Last the newest payments with a fifth of the older ones that come late, the deletion of the double bookings, and the
    other accounts.
    """
    first, second = "1996-07-01", "1998-07-01"
    late = F.pmod("money_id", F.lit(5)) == 4
    old, middle = F.col("created") < F.lit(first).cast("timestamp_ntz"), F.col("created") < F.lit(second).cast("timestamp_ntz")
    older = money.where(old & ~late)
    open_yet = F.col("money_id") % 3 > 0
    seen = (older.withColumn("approval", F.when(open_yet, "Pending").otherwise(F.col("approval"))).withColumn("owner", F.when(open_yet, F.col("owner") + 1).otherwise(F.col("owner")))
            .withColumn("confirmed", F.when(open_yet, F.col("confirmed") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("confirmed"))))
    twice = older.where("type = 'Withdrawal'").withColumn("money_id", -F.col("money_id") - 1)
    sales = F.coalesce(F.col("account_status") == "Sales", F.lit(False))
    return [
        {"money": seen.unionByName(twice), "accounts": accounts.withColumn("qualified", F.col("created")).withColumn("is_test", F.lit(0)).withColumn("assigned_to", F.lit(None).cast("long"))},
        {"money": older.where(open_yet).unionByName(money.where(~old & middle & ~late)), "accounts": accounts.where(sales)},
        {"money": money.where(~middle | late | F.col("created").isNull()), "accounts": accounts.where(~sales), "gone": twice.select("money_id")},
    ]


def _kept(d: Domain, view: str) -> KeptViews:
    """A view after three batches of changes, its tables in a partition for each year."""
    kept = KeptViews(d.spark, f"{_folder(d)}/kept", d.agents, (view,), "yyyy")
    money, accounts = d.money.select(*kept.money.columns), d.accounts.select(*kept.accounts.columns)
    for number, batch in enumerate(batches(money, accounts), 1):
        kept.batch(number, **batch)
    return kept


@query
def V1_kept_by_changes(d: Domain):
    """V1 after three batches, each adding signed changes to the stored view."""
    return _kept(d, "kpis").kpis.read().select("agent_id", "tx_date", "qual_date", "net_usd", "deposit_usd", "withdrawal_usd", "ftd_count", "ftc_count", "ftd_usd")


@query
def V4_kept_by_changes(d: Domain):
    """V4 on the change sets of V1."""
    return _kept(d, "run_rate").run_rate.read().drop("row_count")


@query
def V6_kept_by_changes(d: Domain):
    """V6, which doesn't add up: accounts touched by a batch are done again."""
    return _kept(d, "second").second.read()


@query
def I6_kept_by_changes(d: Domain):
    """Day totals by owner after three batches."""
    return _kept(d, "totals").totals.read().select("agent_id", "tx_date", *streams.MEASURES)


def _open_positions(positions: DataFrame, day: str) -> DataFrame:
    """Positions open on a day: opened by then and at most 90 days before; a longer holding than 60 days doubles the swap."""
    held = F.datediff(F.lit(day).cast("date"), F.to_date("open_time"))
    rows = positions.where(held.between(0, 90)).withColumn("swap", F.when(held > 60, F.col("swap") * 2).otherwise(F.col("swap")).cast("decimal(20,4)"))
    return rows.select("position_id", "login", "symbol", "open_time", "notional", "swap", "last_update")


@query
def M10_snapshot_changes(d: Domain):
    """Two snapshots synced into a stored table: what the second inserted, updated and deleted against the stored side."""
    table = tables.VersionedTable(d.spark, f"{_folder(d)}/positions", ["position_id"],
                                  _schema("position_id:long login:long symbol:str open_time:ts notional:usd swap:usd last_update:ts"))
    order = ["last_update", "notional", "login"]
    for day in ("1996-02-15", "1996-04-01"):
        changes = table.sync_changes(_open_positions(d.positions, day), order)
    old, new = F.col("before"), F.col("after")
    return changes.select("position_id", ch.operation().alias("operation"), old["swap"].alias("old_swap"), new["swap"].alias("new_swap"),
                          F.coalesce(new["notional"], old["notional"]).alias("notional"))


@query
def J20_changed_balances(d: Domain):
    """The two copies of the platform users compared by key and row hash: rows on one side only, and rows that differ."""
    side = lambda s: d.platform_users.where(F.col("source") == s).groupBy("login").agg(F.max("balance").alias("balance"), F.max("credit").alias("credit"))
    changes = ch.change_set(side("S0"), side("S1"), ["login"])
    return changes.select("login", ch.operation().alias("operation"), F.col("before.balance").alias("old_balance"), F.col("after.balance").alias("new_balance"))


def _client_sets(d: Domain) -> DataFrame:
    """Stored sets of first-time clients by agent and day."""
    real = d.accounts.where(m.real_account()).select("account_id")
    firsts = views.money_by_account_day(d.money).where("ftd_count > 0").join(real, "account_id", "left_semi")
    path = f"{_folder(d)}/client_sets"
    distinct.id_sets(firsts.withColumnRenamed("owner", "agent_id"), ["agent_id", "tx_date"], "account_id").write.parquet(path)
    return d.spark.read.parquet(path)


@query
def A2_A3_distinct_by_range(d: Domain):
    """Distinct first-time clients of each agent in each month, over each agent's whole time, of all agents in each month
    and of all together, from one stored table of sets."""
    sets = _client_sets(d)
    month = sets.withColumn("month", F.trunc("tx_date", "month"))
    none = {"agent_id": F.lit(None).cast("long"), "month": F.lit(None).cast("date")}
    parts = []
    for level, keys in (("agent month", ["agent_id", "month"]), ("agent", ["agent_id"]), ("month", ["month"]), ("all", [])):
        counts = distinct.counted(month, keys)
        parts.append(counts.select(F.lit(level).alias("level"), *[F.col(k) if k in keys else none[k].alias(k) for k in none], "clients"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


NEEDLES = (" NATION_1 ", "nation_2", "10", "Agent", "no such text")


@query
def F17_indexed_totals(d: Domain):
    """Totals of the rows that each of several texts finds by the search index, which was built before a change of agents'
    names and the last clients came in."""
    folder, columns = _folder(d), ["account_id", "agent_name", "desk", "office_name"]
    _ftcs(d).write.parquet(f"{folder}/ftcs")
    rows = d.spark.read.parquet(f"{folder}/ftcs")
    index = search.SearchIndex(d.spark, f"{folder}/index", "account_id", columns, rows.schema, width=256)
    late = F.col("account_id") % 7 == 3
    older = rows.where(~late).withColumn("agent_name", F.when(F.col("account_id") % 5 == 2, "NATION_1").otherwise(F.col("agent_name")))
    index.build(older)
    index.update(rows, rows.where(late | (F.col("account_id") % 5 == 2)))
    parts = [bonuses.kept_totals(index.search(n)).select(F.lit(n.strip()).alias("needle"), "*") for n in NEEDLES]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query
def I1_state_upserts(d: Domain):
    """I4, M5: payments upserted by keyed state over three runs of one stream: as first seen; their final form for two thirds
    with some delivered again; and older versions that come late, of which only a greater peak counts."""
    folder, third = _folder(d), F.pmod("money_id", F.lit(3))
    final = d.money.select("money_id", F.lit(2).alias("version"), "approval", "usd", F.col("usd").alias("peak"))
    seen = final.withColumn("version", F.lit(1)).withColumn("approval", F.lit("Pending"))
    late = final.withColumn("version", F.lit(0)).withColumn("approval", F.lit("Draft")).withColumn("peak", (F.col("usd") + 10).cast("decimal(20,4)"))
    table = tables.PartitionedTable(d.spark, f"{folder}/money", ["money_id"], _schema("money_id:long version:int approval:str usd:usd peak:usd"),
                                    "part", F.pmod("money_id", F.lit(8)))
    before = d.spark.conf.get(state.PROVIDER)
    d.spark.conf.set(state.PROVIDER, state.ROCKSDB)
    try:
        for batch in (seen, final.where(third > 0).unionByName(seen.where(third == 1)), late.where(third < 2).unionByName(final.where(third == 2))):
            batch.write.mode("append").parquet(f"{folder}/in")
            rows = streams.read_files(d.spark, f"{folder}/in", table.schema)
            state.upsert_stream(rows, table, ["version"], f"{folder}/checkpoint", ("peak",)).awaitTermination()
    finally:
        d.spark.conf.set(state.PROVIDER, before)
    return table.read().drop("part")


@query
def I7_last_good_copy(d: Domain):
    """Balances where the remote copy is stale and the local one empty: those of the last version that was stored."""
    remote, local = d.platform_users.where("source = 'S0'"), d.platform_users.where("updated > TIMESTAMP_NTZ '2099-01-01 00:00:00'")
    good = tables.VersionedTable(d.spark, f"{_folder(d)}/good", ["login"])
    good.write(d.platform_users.where("source = 'S1'"))
    return equity.pick_fresher(remote, local, "updated", "2098-01-01 00:00:00", good.read()).select("login", "balance", "data_source")
