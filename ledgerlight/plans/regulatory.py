"""Quarterly regulatory figures (R24-R27) and volume per login by country."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import buckets as b, calendar as cal, money as m
from ledgerlight.operators.grouping import stack_measures
from ledgerlight.plans import campaigns, equity as eq, scoreboards as sb, views

USD = "decimal(28,4)"

# Countries of the return, their display names, and the one shown under another.
COUNTRIES = {"CM": "Cameroon", "KE": "Kenya", "SE": "Sweden", "ZM": "Zambia", "DK": "Denmark", "NL": "Netherlands",
             "ES": "Spain", "FI": "Finland", "NO": "Norway"}
SHOWN_UNDER = {"AW": "NL"}
EU = ("SE", "DK", "NL", "ES", "FI", "NO")
OTHER_FOREIGN = ("CM", "KE", "ZM")
ACTIVE = ("4", "9")                 # compliance status codes of active clients


def country() -> Column:
    out = F.col("country")
    for code, shown in SHOWN_UNDER.items():
        out = F.when(F.col("country") == code, shown).otherwise(out)
    return out


def in_scope(excluded_rep: int | None, funded: bool = True) -> Column:
    """Non-test accounts of the countries, without one internal sales rep; funded ones where asked."""
    test = m.real_account() & F.col("country").isin(*COUNTRIES, *SHOWN_UNDER)
    if excluded_rep is not None:
        test = test & (F.col("sales_rep").isNull() | (F.col("sales_rep") != excluded_rep))
    return test & (F.col("funded") == 1) if funded else test


def _before(col: str, day: date) -> Column:
    return F.col(col) < F.lit(day).cast("timestamp_ntz")


def _last_snapshot_day(df: DataFrame, at: Column, until: Column) -> Column:
    """Newest day present up to a bound, as a scalar."""
    return df.where(at <= until).agg(F.max(at)).scalar()


def clients(accounts: DataFrame, snapshots: DataFrame, bridge: DataFrame, year: int, quarter: int,
            excluded_rep: int | None = None) -> DataFrame:
    """Active and inactive clients at both ends of the quarter, client funds, age bands, flagged clients."""
    first, last, after = cal.quarter_bounds(year, quarter)
    active = F.col("compliance").isin(*ACTIVE)
    begin, end = _before("created", first), _before("created", after)
    age = b.age_years(F.col("birth_date"), F.lit(last))
    band = b.pick(age, b.REGULATORY_AGES)
    scope = accounts.where(in_scope(excluded_rep))
    counts = scope.agg(
        F.count_if(active & begin).alias("active_bop"), F.count_if(~active & begin).alias("inactive_bop"),
        F.count_if(active & end).alias("active_eop"), F.count_if(~active & end).alias("inactive_eop"),
        *[F.count_if(active & end & (band == label)).alias(f"age_{label}") for _, _, label in b.REGULATORY_AGES],
        F.count_if(active & end).alias("total_active"), F.count_if(active & end & (F.col("pep") == 1)).alias("pep"))
    day = _last_snapshot_day(snapshots, F.col("day"), F.lit(last))
    logins = _logins(bridge, accounts.where(in_scope(excluded_rep, funded=False)))
    funds = (snapshots.where(F.col("day") == day).join(logins, "login")
             .agg(m.usd_sum(F.greatest(F.col("end_eez"), m.zero()) * F.col("n")).alias("clients_funds")))
    return sb.one_row(accounts.sparkSession, counts, funds)


def _logins(bridge: DataFrame, scope: DataFrame) -> DataFrame:
    """Logins of the accounts in scope with the number of bridge rows they appear on."""
    return (bridge.where("account_id IS NOT NULL")
            .select(F.expr("try_cast(login AS bigint)").alias("login"), "account_id").where("login IS NOT NULL")
            .join(scope.select("account_id"), "account_id", "left_semi")
            .groupBy("login").agg(F.count(F.lit(1)).alias("n")))


def country_volume(deals: DataFrame, positions: DataFrame, bridge: DataFrame, accounts: DataFrame, year: int,
                   quarter: int, excluded_rep: int | None = None) -> DataFrame:
    """Volume opened plus volume closed in the quarter by shown country."""
    first, last, _ = cal.quarter_bounds(year, quarter)
    owners = views.login_accounts(bridge, accounts.where(in_scope(excluded_rep)))
    moved = (campaigns.open_close_volume(deals, positions, first.isoformat(), last.isoformat())
             .groupBy("login").agg(F.sum("volume").alias("v")))
    return (moved.join(owners.select("login", country().alias("iso")), "login")
            .groupBy("iso").agg(F.sum("v").cast(USD).alias("volume")))


def by_country(accounts: DataFrame, deals: DataFrame, positions: DataFrame, bridge: DataFrame, year: int,
               quarter: int, excluded_rep: int | None = None) -> DataFrame:
    """Clients and volume for each shown country, zeros included."""
    _, _, after = cal.quarter_bounds(year, quarter)
    active = F.col("compliance").isin(*ACTIVE)
    counts = (accounts.where(in_scope(excluded_rep) & _before("created", after)).groupBy(country().alias("iso"))
              .agg(F.count_if(active).alias("active"), F.count_if(~active).alias("inactive")))
    volume = country_volume(deals, positions, bridge, accounts, year, quarter, excluded_rep)
    names = F.explode(F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])).alias("iso", "name")
    spine = accounts.sparkSession.range(1).select(names)
    return (spine.join(counts, "iso", "left").join(volume, "iso", "left")
            .select("iso", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("active", "inactive")],
                    F.coalesce("volume", m.zero()).cast(USD).alias("volume")).orderBy("iso"))


def equity_on(equity: DataFrame, logins: DataFrame, until: Column, name: str, by_day: bool = False) -> DataFrame:
    """Floored equity of the last snapshot up to the start of a day.

    Snapshots of a platform share one moment, so the rows of the newest moment count. With `by_day` the last
    calendar day with rows counts, newest row per login: for feeds whose rows carry times of their own.
    """
    if by_day:
        day = _last_snapshot_day(equity, F.to_date("at"), until)
        # bounds on the column itself, which reach the scan
        inside = (F.col("at") >= day.cast("timestamp_ntz")) & (F.col("at") < F.date_add(day, 1).cast("timestamp_ntz"))
        rows = eq.keyed.newest(equity.where(inside), ["login"], ["at", "source"])
    else:
        moment = _last_snapshot_day(equity, F.col("at"), until.cast("timestamp_ntz"))
        rows = equity.where(F.col("at") == moment)
    return rows.join(logins, "login").agg(m.usd_sum(F.greatest(F.col("equity"), m.zero()) * F.col("n")).alias(name))


def equity_ratio(equity: DataFrame, bridge: DataFrame, accounts: DataFrame, year: int, quarter: int,
                 excluded_rep: int | None = None, by_day: bool = False) -> DataFrame:
    """Client equity at the end of the quarter, floating change over it, and their ratio."""
    first, last, after = cal.quarter_bounds(year, quarter)
    logins = _logins(bridge, accounts.where(in_scope(excluded_rep)))
    actual = equity_on(equity, logins, F.lit(last), "actual_equity", by_day)
    moved = (equity.where(~_before("at", first) & _before("at", after)).groupBy("login")
             .agg(F.sum("delta_floating").alias("d")).join(logins, "login")
             .agg(m.usd_sum(F.col("d") * F.col("n")).alias("floating_pnl")))
    row = sb.one_row(equity.sparkSession, actual, moved)
    total = F.col("actual_equity") + F.col("floating_pnl")
    return row.withColumn("total_equity", total).withColumn(
        "equity_ratio", F.when(total != 0, F.col("actual_equity").cast("double") / total.cast("double") * 100).otherwise(0.0))


def income(money: DataFrame, deals: DataFrame, positions: DataFrame, equity: DataFrame, bridge: DataFrame,
           accounts: DataFrame, year: int, quarter: int, excluded_rep: int | None = None, by_day: bool = False) -> DataFrame:
    """Total volume, PnL equity (end - start - net money - adjustments) and volume by investor type."""
    first, last, _ = cal.quarter_bounds(year, quarter)
    funded = _logins(bridge, accounts.where(in_scope(excluded_rep)))
    scope = accounts.where(in_scope(excluded_rep, funded=False)).select("account_id")
    rows = (money.where(m.approved() & m.between_days("confirmed", first.isoformat(), last.isoformat()))
            .groupBy("account_id", "raw_type", "type").agg(F.sum("usd").alias("usd"))
            .join(scope, "account_id", "left_semi"))
    dep, wd = F.col("raw_type") == "Deposit", F.col("raw_type") == "Withdrawal"
    std_in, std_out = F.col("type").isin(*m.MONEY_IN), F.col("type").isin(*m.MONEY_OUT)
    sums = rows.agg(
        m.usd_sum(F.when(dep & std_in, F.col("usd")).when(wd & std_out, -F.col("usd"))).alias("net_usd"),
        m.usd_sum(F.when((dep & ~std_in) | (F.col("type") == "Transfer To Account"), F.col("usd"))).alias("dep_adj"),
        m.usd_sum(F.when((wd & ~std_out) | (F.col("type") == "Transfer From Account"), F.col("usd"))).alias("wd_adj"))
    volume = country_volume(deals, positions, bridge, accounts, year, quarter, excluded_rep)
    by_type = volume.agg(
        m.usd_sum(F.col("volume")).alias("total_volume"),
        m.usd_sum(F.when(F.col("iso").isin(*EU), F.col("volume"))).alias("eu_volume"),
        m.usd_sum(F.when(F.col("iso").isin(*OTHER_FOREIGN), F.col("volume"))).alias("other_foreign_volume"))
    row = sb.one_row(money.sparkSession, by_type, sums, equity_on(equity, funded, F.lit(last), "end_equity", by_day),
                     equity_on(equity.where(_before("at", first)), funded, F.lit(first), "start_equity", by_day))
    c = F.col
    return row.withColumn("pnl_equity", c("end_equity") - c("start_equity") - c("net_usd") - (c("dep_adj") - c("wd_adj")))


def volume_per_login(deals: DataFrame, bridge: DataFrame, accounts: DataFrame, first: str, last: str,
                     excluded_rep: int | None = None) -> DataFrame:
    """Volume opened (entry deals) and closed (exit deals) per login with its country."""
    trades = deals.where(F.col("cmd").isin(0, 1) & m.trade_symbol())
    opened = (trades.where((F.col("entry") == 0) & m.between_days("open_time", first, last))
              .groupBy("login").agg(F.sum("notional").cast(USD).alias("open_vol")))
    closed = (trades.where((F.col("entry") == 1) & m.closed() & m.between_days("close_time", first, last))
              .groupBy("login").agg(F.sum("notional").cast(USD).alias("close_vol")))
    owners = views.login_accounts(bridge, accounts.where(in_scope(excluded_rep)))
    both = stack_measures([opened, closed], ["login"], {"open_vol": USD, "close_vol": USD})
    return (both.join(owners.select("login", "country"), "login").groupBy("login", "country")
            .agg(F.sum("open_vol").cast(USD).alias("open_vol"), F.sum("close_vol").cast(USD).alias("close_vol"))
            .withColumn("total_vol", (F.col("open_vol") + F.col("close_vol")).cast(USD)).orderBy("login"))
