"""Views kept by signed changes of the ledgers (V1, V4, V6, I6): a batch costs what it changes.

The day sums of (account, owner), V1 and V4 add up, so old rows go in with a minus and new ones with a plus, each view's
change set feeding the next. V1 counts clients of a cell: a client's day row adds one while it has a first deposit. V1
joins the accounts, so its change is that of the day sums with the accounts as they were, plus the new day sums of
accounts that changed. V6 doesn't add up: the accounts whose money or own row changed are found and done again.
Agents are given; when they change, the views are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.functions import money as m
from ledgerlight.operators import changes as ch
from ledgerlight.plans import views
from ledgerlight.schemas import _schema
from ledgerlight.sources.kept import AdditiveView, KeptTable
from pyspark.sql import types as T

USD = "decimal(28,4)"


def _money_schema(text: str) -> T.StructType:
    """A schema whose `sum` columns are totals of money."""
    return T.StructType([T.StructField(f.name, T.DecimalType(28, 4)) if f.dataType == T.DecimalType(20, 4) else f for f in _schema(text).fields])


VIEWS = ("days", "kpis", "run_rate", "totals", "second")
NEEDS = {"kpis": {"days"}, "run_rate": {"days", "kpis"}, "totals": {"days"}}


class KeptViews:
    """The ledgers of payments and accounts under one folder, and the views kept from their changes.

    `keep` names the views wanted; those they are made from are kept too. `period` is the part of a date that names a
    partition, by month unless the tables are small.
    """

    MONEY = "money_id:long account_id:long approval:str type:str comment:str owner:long ftd:int usd:usd confirmed:ts created:ts deleted:int"
    ACCOUNTS = "account_id:long is_test:int is_demo:int account_status:str assigned_to:long created:ts qualified:ts"

    def __init__(self, spark: SparkSession, root: str, agents: DataFrame, keep: tuple[str, ...] = VIEWS, period: str = "yyyy-MM"):
        self.agents, self.keep = agents, {*keep}.union(*(NEEDS.get(k, ()) for k in keep))
        period_of = lambda column: lambda c: F.date_format(c(column), period)
        ledger = lambda name, keys, text: KeptTable(spark, f"{root}/{name}", keys, _schema(text), "created_in", period_of("created"))
        self.money, self.accounts = ledger("money", ["money_id"], self.MONEY), ledger("accounts", ["account_id"], self.ACCOUNTS)

        def view(name: str, text: str, measures: str) -> AdditiveView:
            return AdditiveView(spark, f"{root}/{name}", _money_schema(text), measures.split(), "tx_in", period_of("tx_date"))

        sums = "deposit_usd:usd withdrawal_usd:usd ftd_count:long ftd_usd:usd"
        self.days = view("days", f"account_id:long owner:long tx_date:date {sums}", "deposit_usd withdrawal_usd ftd_count ftd_usd")
        self.kpis = view("kpis", f"agent_id:long tx_date:date qual_date:date net_usd:usd {sums} ftc_count:long",
                         "net_usd deposit_usd withdrawal_usd ftd_count ftd_usd ftc_count")
        self.run_rate = view("run_rate", "dept_group:str tx_date:date qual_date:date net_usd:usd deposit_usd:usd ftd_count:long ftc_count:long",
                             "net_usd deposit_usd ftd_count ftc_count")
        self.totals = view("totals", "agent_id:long tx_date:date net_usd:usd deposit_usd:usd withdrawal_usd:usd ftd_count:long",
                           "net_usd deposit_usd withdrawal_usd ftd_count")
        self.second = KeptTable(spark, f"{root}/second", ["account_id"], _schema("account_id:long has_second_deposit:int second_deposit_at:ts agent_id:long"),
                                "second_in", period_of("second_deposit_at"))
        self.tables = [self.money, self.accounts, *(getattr(self, v) for v in VIEWS if v in self.keep)]

    def batch(self, number: int, money: DataFrame, accounts: DataFrame, gone: DataFrame | None = None, order: list | None = None) -> dict[str, list[str]]:
        """Take in changed payments and accounts and the ids of deleted payments; returns the partitions rewritten, by table."""
        self.money.merged(number, money, order or ["confirmed"], gone=gone)
        self.accounts.merged(number, accounts, ["created"])
        paid, held = self.money.log.read(number), self.accounts.log.read(number)
        redo = lambda: self._touched(paid, held)
        propose = {
            "days": lambda: self.days.folded(number, lambda: self._day_rows(paid)),
            "kpis": lambda: self.kpis.folded(number, lambda: self._kpi_rows(self.days.log.read(number), held, number)),
            "run_rate": lambda: self.run_rate.folded(number, lambda: self._run_rate_rows(self.kpis.log.read(number))),
            "totals": lambda: self.totals.folded(number, lambda: self._total_rows(self.days.log.read(number))),
            "second": lambda: self.second.replaced(number, lambda: self._second_rows(number, redo()), redo),
        }
        for name in VIEWS:
            if name in self.keep:
                propose[name]()
        return {t.path.split("/")[-2]: t.apply(number) for t in self.tables}

    @staticmethod
    def _times(sign: Column, value: Column) -> Column:
        return (sign * value).cast(USD)

    def _day_rows(self, paid: DataFrame) -> DataFrame:
        rows, sign = ch.signed(paid).where(m.valid_money()), F.col("sign")
        return rows.select("account_id", "owner", F.to_date("confirmed").alias("tx_date"), self._times(sign, m.money_in()).alias("deposit_usd"),
                           self._times(sign, m.money_out()).alias("withdrawal_usd"), F.when(m.is_ftd(), sign).otherwise(0).alias("ftd_count"),
                           self._times(sign, F.when(m.is_ftd(), F.col("usd")).otherwise(0)).alias("ftd_usd"), sign.alias(AdditiveView.ROWS))

    def _kpi_rows(self, days: DataFrame, accounts: DataFrame, number: int) -> DataFrame:
        real = lambda rows, *more: rows.where(m.real_account()).select("account_id", F.to_date("qualified").alias("qual_date"), *more)
        # day sums that changed, under the accounts as they were
        by_days = ch.signed(days).join(real(self.accounts.read()), "account_id")
        # accounts that changed, with the day sums as they will be
        moved = ch.signed(accounts)
        own = ch.with_keys(self.days.after(number), moved.select("account_id").distinct(), ["account_id"])
        by_accounts = own.join(real(moved, "sign"), "account_id")
        rows = by_days.unionByName(by_accounts.select(by_days.columns))
        sign = F.col("sign")
        named = self.agents.select(F.col("agent_id").alias("owner"), "agent_name", "full_name")
        return rows.join(named, "owner", "left").where(~m.named_like("test")).select(
            F.col("owner").alias("agent_id"), "tx_date", "qual_date", self._times(sign, F.col("deposit_usd") - F.col("withdrawal_usd")).alias("net_usd"),
            *[self._times(sign, F.col(c)).alias(c) for c in ("deposit_usd", "withdrawal_usd", "ftd_usd")], (sign * F.col("ftd_count")).alias("ftd_count"),
            F.when(F.col("ftd_count") > 0, sign).otherwise(0).alias("ftc_count"), sign.alias(AdditiveView.ROWS))

    def _run_rate_rows(self, kpis: DataFrame) -> DataFrame:
        tagged = self.agents.select("agent_id", views.department_group().alias("_tag"))
        groups = F.when(F.col("_tag").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.col("_tag")))
        sign = F.col("sign")
        return ch.signed(kpis).join(tagged, "agent_id", "left").select(
            F.explode(groups).alias("dept_group"), "tx_date", "qual_date", *[self._times(sign, F.col(c)).alias(c) for c in ("net_usd", "deposit_usd")],
            *[(sign * F.col(c)).alias(c) for c in ("ftd_count", "ftc_count")], sign.alias(AdditiveView.ROWS), "sign").drop("sign")

    def _total_rows(self, days: DataFrame) -> DataFrame:
        sign = F.col("sign")
        return ch.signed(days).where("owner IS NOT NULL").select(
            F.col("owner").alias("agent_id"), "tx_date", self._times(sign, F.col("deposit_usd") - F.col("withdrawal_usd")).alias("net_usd"),
            *[self._times(sign, F.col(c)).alias(c) for c in ("deposit_usd", "withdrawal_usd")], (sign * F.col("ftd_count")).alias("ftd_count"), sign.alias(AdditiveView.ROWS))

    @staticmethod
    def _touched(paid: DataFrame, accounts: DataFrame) -> DataFrame:
        """Accounts with changed payments, under the old and the new owner of each, and changed accounts."""
        return ch.signed(paid).select("account_id").unionByName(ch.signed(accounts).select("account_id")).where("account_id IS NOT NULL").distinct()

    def _second_rows(self, number: int, touched: DataFrame) -> DataFrame:
        of = lambda table: ch.with_keys(table.after(number), touched, ["account_id"])
        return views.second_deposit_clients(of(self.money), of(self.accounts))
