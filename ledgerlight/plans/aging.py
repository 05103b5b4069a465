"""Client aging report over dynamic dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import buckets as b, money as m
from ledgerlight.functions.numeric import round_even
from ledgerlight.operators.grouping import ratio
from ledgerlight.plans import views

USD = "decimal(28,4)"
MEASURES = ["ftc", "rdp", "deposit", "withdrawal", "wd_count", "traders"]


def dimensions(end: str) -> dict[str, tuple[str | None, Column, Column]]:
    """Group name -> (dimension table it needs, label, sort key)."""
    none = F.lit(None).cast("int")

    def label(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(b.UNASSIGNED))

    def code(c: str, missing: int) -> Column:
        return F.coalesce(F.col(c).try_cast("int"), F.lit(missing))

    potential = F.round(F.col("potential").try_cast("decimal(20,6)")).cast("int")
    qualified, birth = F.col("qualified"), F.col("birth_date")
    return {
        "days_from_ftc": (None, b.aging_bucket(qualified, end), b.aging_sort(qualified, end)),
        "marketing_group": ("campaign", label("marketing_group"), none),
        "campaign_legacy": ("campaign", label("legacy_id"), none),
        "office_name": ("agent", label("office_name"), none), "team": ("agent", label("department"), none),
        "agent": ("agent", label("agent_name"), none),
        "age_group": (None, b.age_group(birth, end), b.age_sort(birth, end)),
        "client_potential": (None, F.coalesce(potential.cast("string"), F.lit(b.UNASSIGNED)), potential),
        "country": ("country", F.coalesce("country_label", label("country")), none),
        "region": ("region", F.coalesce("region_label", label("country")), none),
        "segmentation": (None, b.segment_label(F.col("segment"), F.col("score"), birth, end), code("segment", 99)),
        "retention_status": ("retention_status", F.coalesce("retention_status_label", label("retention_status")),
                             code("retention_status", 999)),
        "sales_status": ("sales_status", F.coalesce("sales_status_label", label("sales_status")), code("sales_status", 999)),
    }


# dimension name -> account column its code -> label table is keyed by
LABELS = {"country": "country", "region": "country", "retention_status": "retention_status", "sales_status": "sales_status"}


def aging_report(money: DataFrame, accounts: DataFrame, agents: DataFrame, campaigns: DataFrame, std: DataFrame,
                 volume: DataFrame, end: str, groups: tuple = ("days_from_ftc",), labels: dict[str, DataFrame] | None = None,
                 chosen: Column | None = None, *, floor_day: str) -> DataFrame:
    """Qualified clients up to a day by one or two groups, with money, second deposits and traders.

    `labels` holds code -> label tables (code, label). They are joined before grouping, so codes that share a
    label fall into one row and every figure is rounded once. `volume` is (login-free) V2-like trading by
    account and opening day without agent rules.
    """
    dims = dimensions(end)
    if bad := [g for g in groups if g not in dims]:
        raise KeyError(f"unknown group {bad}")
    needs = {dims[g][0] for g in groups}
    rows = accounts.where(m.real_account() & m.on_or_before("qualified", end)
                          & (F.col("qualified") >= F.lit(floor_day).cast("timestamp_ntz")))
    if "age_group" in groups:
        rows = rows.where("birth_date IS NOT NULL")
    if "campaign" in needs:
        rows = (rows.withColumn("_campaign", F.split_part("campaign", F.lit("."), F.lit(1)))
                .join(campaigns.select(F.col("campaign_id").alias("_campaign"), "marketing_group", "legacy_id"), "_campaign", "left"))
    if "agent" in needs or chosen is not None:
        rows = rows.join(agents.select(F.col("agent_id").alias("assigned_to"), "office_name", "department", "agent_name"),
                         "assigned_to", "left")
    for need in needs & set(LABELS):
        table = (labels or {}).get(need)
        name = f"{need}_label"
        if table is None:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
        else:
            key = F.upper(F.trim(F.col(LABELS[need]).cast("string")))
            rows = (rows.withColumn("_code", key)
                    .join(table.select(F.col("code").alias("_code"), F.col("label").alias(name)), "_code", "left"))
    if chosen is not None:
        rows = rows.where(chosen)
    keys = []
    for i, g in enumerate(groups, 1):
        rows = rows.withColumn(f"_g{i}", dims[g][1]).withColumn(f"_s{i}", dims[g][2])
        keys += [f"_g{i}", f"_s{i}"]
    base = rows.select("account_id", *keys)
    ledger = (money.where(m.approved() & m.not_bonus_comment() & m.on_or_before("confirmed", end)
                          & (F.col("confirmed") >= F.lit(floor_day).cast("timestamp_ntz")))
              .groupBy("account_id").agg(
                  m.usd_sum(m.money_in()).alias("dep"), m.usd_sum(m.money_out()).alias("wd"),
                  F.max((F.col("type") == "Withdrawal").cast("int")).alias("withdrew")))
    second = std.where((F.col("has_second_deposit") == 1) & m.on_or_before("second_deposit_at", end)).select(
        "account_id", F.lit(1).alias("second"))
    traded = volume.where((F.col("has_notional") == 1) & (F.col("open_date") <= F.lit(end).cast("date"))).select(
        "account_id").distinct().withColumn("trader", F.lit(1))
    joined = (base.join(ledger, "account_id", "left").join(second, "account_id", "left")
              .join(traded, "account_id", "left"))
    out = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ftc"), F.count("second").alias("rdp"), m.usd_sum(F.col("dep")).alias("deposit"),
        m.usd_sum(F.col("wd")).alias("withdrawal"), F.count_if(F.col("withdrew") == 1).alias("wd_count"),
        F.count("trader").alias("traders"))
    # several codes may share a label: their rows fall together, ordered by the smallest code
    labels_only = [f"_g{i}" for i in range(1, len(groups) + 1)]
    out = out.groupBy(*labels_only).agg(
        *[F.min(f"_s{i}").alias(f"_s{i}") for i in range(1, len(groups) + 1)],
        *[F.sum(c).cast(USD if c in ("deposit", "withdrawal") else "bigint").alias(c) for c in MEASURES])
    for i in range(1, len(groups) + 1):
        out = out.withColumnRenamed(f"_g{i}", f"g{i}").withColumnRenamed(f"_s{i}", f"sort{i}")
    return out


def with_rates(rows: DataFrame) -> DataFrame:
    """Ratios of a row, from its measures; money in whole dollars."""
    net = F.col("deposit") - F.col("withdrawal")

    def whole(c: Column) -> Column:
        return round_even(c.cast("double"), 0)

    n = F.col("ftc")
    return rows.withColumns({
        "ltv": ratio(net, n), "pct_std": ratio(F.col("rdp"), n, 0, 100), "pct_wd_clients": ratio(F.col("wd_count"), n, 0, 100),
        "pct_wd_usd": F.when(F.col("deposit") > 0, round_even(
            F.col("withdrawal").cast("double") / F.col("deposit").cast("double") * 100, 0)).otherwise(0.0),
        "traders_pct": ratio(F.col("traders"), n, 0, 100), "net_deposit": whole(net),
        "deposit": whole(F.col("deposit")), "withdrawal": whole(F.col("withdrawal"))})


def with_grand_total(rows: DataFrame) -> DataFrame:
    """Rows plus the grand total, by grouping sets over the measures; ratios follow from the sums."""
    keys = [c for c in rows.columns if c not in MEASURES]
    both = rows.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_all"),
        *[F.sum(c).cast(USD if c in ("deposit", "withdrawal") else "bigint").alias(c) for c in MEASURES])
    return with_rates(both.withColumn("g1", F.when(F.col("_all") > 0, "Grand Total").otherwise(F.col("g1"))).drop("_all"))


def traded_accounts(traded: DataFrame, bridge: DataFrame) -> DataFrame:
    """Trading by account and opening day, without agent or test rules (the aging report applies its own)."""
    logins = (bridge.where("account_id IS NOT NULL")
              .select(F.expr("try_cast(login AS bigint)").alias("login"), "account_id").where("login IS NOT NULL"))
    return traded.join(logins, "login").select("account_id", "open_date", "has_notional")


def ordered(rows: DataFrame) -> DataFrame:
    cols = [c for i in (1, 2) if f"g{i}" in rows.columns
            for c in (F.coalesce(F.col(f"sort{i}"), F.lit(0)), F.col(f"g{i}"))]
    return rows.orderBy(*cols)
