"""Registered queries that split what one key or one range holds: pieces of hours, cells of intervals, ranges of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlight.catalog import FIRST, LAST, LIVE, Domain, query
from ledgerlight.catalog_streams import _folder
from ledgerlight.functions import money as m
from ledgerlight.operators import changes as ch, hashtree, intervals, keyed
from ledgerlight.plans import campaigns, jobs, quality, views
from ledgerlight.schemas import _schema
from ledgerlight.sources import feeds, rewrite, tables

PIECE = 500     # rows; a cluster takes about a million, here hours shall be cut in small tables too


def _ledger(d: Domain) -> DataFrame:
    return d.money.where(m.valid_money()).select("account_id", "confirmed", "money_id", m.signed_usd().alias("amount"))


@query
def W1_book_running_total(d: Domain):
    """The running total of the whole book: one key owns every row."""
    book = _ledger(d).withColumn("book", F.lit("all"))
    return keyed.running_total(book, ["book"], "confirmed", "money_id", "amount", piece_rows=PIECE).select("money_id", "running")


@query
def A12_book_crossing(d: Domain):
    """When the whole book first stood at each of three totals."""
    marks = [1_000, 20_000, 100_000]
    hits = [keyed.first_crossing(_ledger(d).withColumn("mark", F.lit(k)), ["mark"], "confirmed", "money_id", "amount", k, piece_rows=PIECE) for k in marks]
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


@query
def D1_threshold_clients_by_pieces(d: Domain):
    return jobs.threshold_clients(d.money, d.accounts, piece_rows=PIECE)


@query
def V6_second_deposits_by_pieces(d: Domain):
    return views.second_deposit_clients(d.money, d.accounts, piece_rows=PIECE)


@query
def W6_row_numbers(d: Domain):
    """All payments numbered by confirmation, those without one last."""
    return keyed.row_numbers(d.money.select("money_id", "confirmed"), "confirmed", "money_id", "place", PIECE).select("money_id", "place")


def _active(d: Domain) -> DataFrame:
    """Periods in which an agent's clients moved money, at most 20 days apart."""
    days = (d.money.where(m.valid_money() & F.col("owner").isNotNull()).groupBy(F.col("owner").alias("agent_id"), F.to_date("confirmed").alias("day"))
            .agg(F.sum(m.signed_usd()).alias("net")))
    return intervals.periods(days.where("day IS NOT NULL"), ["agent_id"], "day", 20, [F.sum("net").cast("decimal(28,4)").alias("net_usd")])


@query
def J10_activity_in_departments(d: Domain):
    """R2: each agent's periods of activity with the departments held meanwhile."""
    return intervals.overlaps(d.dept_history, _active(d), ["agent_id"], ("valid_from", "valid_to"), ("first_day", "last_day"))


@query
def J10_net_by_department(d: Domain):
    """Money by the department its owner belonged to on the day; a day is a range of its own."""
    paid = (d.money.where(m.valid_money() & F.col("confirmed").isNotNull()).groupBy(F.col("owner").alias("agent_id"), F.to_date("confirmed").alias("day"))
            .agg(F.sum(m.signed_usd()).alias("net")).withColumn("day_end", F.col("day")))
    met = intervals.overlaps(d.dept_history, paid, ["agent_id"], ("valid_from", "valid_to"), ("day", "day_end"), 365)
    return met.groupBy("report_dept").agg(F.count(F.lit(1)).alias("agent_days"), F.sum("net").cast("decimal(28,4)").alias("net_usd"))


@query
def M19_ranged_retyping(d: Domain):
    """Every payment typed again by ranges of its id; the job stops after three ranges, and another one ends it."""
    path = f"{_folder(d)}/retyped"
    source = d.raw_money.withColumn("type", F.lit(None).cast("string"))
    change = lambda rows: jobs.typed_money(rows, d.balance_ops).select("money_id", "type")
    rewrite.RangeRewrite(d.spark, path, "money_id").run(source, change, 6, at_most=3)
    again = rewrite.RangeRewrite(d.spark, path, "money_id")
    again.run(source, change, 6)
    return again.read()


@query
def D4_snapshots_by_ranges(d: Domain):
    """Daily equity snapshots made anew by ranges of logins."""
    done = rewrite.RangeRewrite(d.spark, f"{_folder(d)}/snapshots", "login")
    rows = d.snapshots
    done.run(rows, lambda part: part, 4, at_most=2)
    done.run(rows, lambda part: part, 4)
    return done.read().select(*rows.columns)


@query
def R8_all_groupings(d: Domain):
    """The campaign table by each one and two of its 13 dimensions, 92 groupings from one read of each table."""
    folder = _folder(d)

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return d.spark.read.parquet(f"{folder}/{name}")

    return campaigns.all_groupings(d.money, d.accounts, d.campaigns, d.agents, d.deals, d.positions, d.bridge, FIRST, LAST, LIVE, store, floor_day=FIRST)


# ---- difference search ---------------------------------------------------------------------------------------

SHAPE = hashtree.Shape("money_id", width=64, fanout=16, levels=4)     # small leaves, so that small tables have many


def _copies(d: Domain) -> tuple[DataFrame, DataFrame]:
    """The payments, and a copy that lost a page of them, holds those of one day as they stood before and some that are
    gone from the source; both stored in order of their ids."""
    source = d.money.select("money_id", "account_id", "approval", "type", "usd", "confirmed")
    stale = F.to_date("confirmed") == F.lit("1998-03-10").cast("date")
    copy = source.where(~F.col("money_id").between(700, 749)).withColumn("approval", F.when(stale, "Stale").otherwise(F.col("approval")))
    gone = source.where("money_id < 300 AND type = 'Withdrawal'").withColumn("money_id", -F.col("money_id") - 1)
    folder, out = _folder(d), []
    for name, rows in (("copy", copy.unionByName(gone)), ("source", source)):
        rows.repartitionByRange("money_id").sortWithinPartitions("money_id").write.parquet(f"{folder}/{name}")
        out.append(d.spark.read.parquet(f"{folder}/{name}"))
    return out[0], out[1]


def _found(changes: DataFrame) -> DataFrame:
    return changes.select("money_id", ch.operation().alias("operation"), F.col("before.approval").alias("old_approval"),
                          F.col("after.approval").alias("new_approval"), F.coalesce("after.usd", "before.usd").alias("usd"))


@query
def J20_tree_differences(d: Domain):
    """Q12: where a copy of the payments differs from its source, searched by hash trees."""
    copy, source = _copies(d)
    return _found(hashtree.differences(copy, source, hashtree.tree(copy, SHAPE), hashtree.tree(source, SHAPE), ["money_id"], SHAPE, 64))


@query
def D10_tree_resync(d: Domain):
    """What still differs once rows the copy lacked were put in; its tree follows by the change set alone."""
    copy, source = _copies(d)
    held, wanted = hashtree.tree(copy, SHAPE), hashtree.tree(source, SHAPE)
    lost = hashtree.differences(copy, source, held, wanted, ["money_id"], SHAPE, 64).where("before IS NULL")
    mended = ch.applied(copy, lost, ["money_id"])
    return _found(hashtree.differences(mended, source, hashtree.folded(held, lost, SHAPE), wanted, ["money_id"], SHAPE, 64))


# ---- further forms of pulls, history and exports -----------------------------------------------------------


@query
def S16_bonus_ledger_lookback(d: Domain):
    return feeds.bonus_ledger(d.money, cutoff="1998-06-01")


@query
def S16_bonus_ledger_after_id(d: Domain):
    return feeds.bonus_ledger(d.money, after_id=5000)


@query
def S20_trades_missing(d: Domain):
    """Trades whose ticket is not stored; the older half of the deals stands for the stored copy."""
    stored = d.deals.where("open_time < TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    return feeds.missing(feeds.trades(d.deals), stored, ["ticket", "source"]).select("ticket", "source", "login", "symbol", "notional")


@query
def S20_trades_full(d: Domain):
    return feeds.trades(d.deals).select("ticket", "source", "login", "symbol", "notional")


@query
def S20_trades_open(d: Domain):
    """Trades still open: their close time is the sentinel."""
    return feeds.open_deals(feeds.trades(d.deals)).select("ticket", "source", "login", "symbol", "notional")


@query
def S22_deals_utc_full(d: Domain):
    return feeds.deals_utc(d.deals).select("ticket", "source", "open_time", "close_time")


@query
def S22_deals_utc_missing(d: Domain):
    stored = d.deals.where("sync_time < TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    return feeds.missing(feeds.deals_utc(d.deals), stored, ["ticket", "source"]).select("ticket", "source", "open_time", "close_time")


@query
def S26_ids_from_text(d: Domain):
    """Logins exported as text; the list is read back and picks the daily rows."""
    path = f"{_folder(d)}/logins"
    tables.export_csv(d.bridge.where(m.not_deleted()).select(F.col("login").cast("string").alias("login")), path)
    return feeds.by_ids(d.equity, feeds.read_ids(d.spark, path), "login").select("login", "source", F.to_date("at").alias("day"), "balance")


@query
def S26_sheet_totals(d: Domain):
    """Net by agent exported with a header and read back as a sheet of external values."""
    path = f"{_folder(d)}/net"
    net = d.kpis.groupBy("agent_id").agg(F.sum("net_usd").cast("decimal(28,4)").alias("net_usd"))
    tables.export_csv(net, path)
    return feeds.read_sheet(d.spark, path, "agent_id long, net_usd decimal(28,4)")


@query
def Q15_score_trend(d: Domain):
    """Scores of the payment checks kept by day over three runs, the second of a day replacing the first."""
    history = d.spark.createDataFrame([], _schema("day:date total:long pass:long warn:long fail:long error:long score:dbl"))
    paid, plain = d.money.where(m.valid_money()), d.money.where(m.valid_money() & m.not_bonus_comment())
    for day, tolerance in (("1999-01-08", 0.0), ("1999-01-09", 0.0), ("1999-01-09", 1.0)):
        history = quality.keep_history(history, quality.cross_source(paid, plain, "payments", "usd", tolerance), day)
    return quality.trend(history)
