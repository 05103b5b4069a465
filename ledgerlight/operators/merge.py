"""Keyed merges with per-column rules.

Plain tables have no MERGE INTO, so a merge is a full outer join on unique keys that yields the next version
of the table. The delta is reduced to one row per key first, which keeps the join one-to-one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlight.operators import keyed

NEW, GREATEST, KEEP_IF_NULL = "new", "greatest", "keep_if_null"


def guarded(flag: str) -> tuple[str, str]:
    """Rule: the stored value stays while the stored row's flag is set."""
    return ("guarded", flag)


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return keyed.newest(drop_null_keys(df, keys), keys, order)


def merge_by_key(base: DataFrame, delta: DataFrame, keys: list[str], order: list,
                 rules: dict | None = None) -> DataFrame:
    """Base with the delta applied: new keys inserted, known keys updated by the column's rule.

    Default rule: the delta's value wins, NULL included. `order` decides between rows of one delta that share
    a key. Columns the delta lacks keep the stored value; columns the base lacks are added.
    """
    rules = rules or {}
    new = last_per_key(delta, keys, order)
    b, d = base.alias("b"), new.alias("d")
    on = [F.col(f"b.{k}") == F.col(f"d.{k}") for k in keys]
    in_base = F.col(f"b.{keys[0]}").isNotNull()
    in_delta = F.col(f"d.{keys[0]}").isNotNull()
    columns = list(dict.fromkeys(base.columns + delta.columns))
    out = []
    for c in columns:
        if c in keys:
            out.append(F.coalesce(f"d.{c}", f"b.{c}").alias(c))
            continue
        if c not in delta.columns or c not in base.columns:
            out.append(F.col(f"b.{c}" if c in base.columns else f"d.{c}").alias(c))
            continue
        old, fresh = F.col(f"b.{c}"), F.col(f"d.{c}")
        rule = rules.get(c, NEW)
        if rule == GREATEST:
            value = F.greatest(fresh, old)
        elif rule == KEEP_IF_NULL:
            value = F.coalesce(fresh, old)
        elif isinstance(rule, tuple) and rule[0] == "guarded":
            value = F.when(F.coalesce(F.col(f"b.{rule[1]}"), F.lit(False)), old).otherwise(fresh)
        else:
            value = fresh
        out.append(F.when(in_base & in_delta, value).when(in_delta, fresh).otherwise(old).alias(c))
    return b.join(d, on, "full").select(*out)


def insert_missing(base: DataFrame, delta: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Base plus the delta rows whose key it does not hold yet."""
    new = last_per_key(delta, keys, order) if order else drop_null_keys(delta, keys).dropDuplicates(keys)
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def sync_snapshot(snapshot: DataFrame, keys: list[str], order: list) -> DataFrame:
    """State after 'insert or update what is there, delete what is not': the snapshot itself.

    An empty snapshot would clear the table; VersionedTable.sync_snapshot refuses that unless told otherwise.
    """
    return last_per_key(snapshot, keys, order)


def override_flag(df: DataFrame, ids: DataFrame, key: str, flag: str, value: int = 1) -> DataFrame:
    """Set `flag` for the ids another source lists, whatever the row says."""
    marked = ids.select(key).distinct().withColumn("_marked", F.lit(True))
    return (df.join(marked, key, "left")
            .withColumn(flag, F.when(F.col("_marked"), F.lit(value)).otherwise(F.col(flag)))
            .drop("_marked").select(*df.columns))


def override_values(df: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Per-id configuration wins over merged values where it states one."""
    cols = [c for c in overrides.columns if c not in keys]
    renamed = overrides.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols])
    return df.join(renamed, keys, "left").select(
        *[F.coalesce(f"_o_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def deactivate(members: DataFrame, source: DataFrame, key: str, flag: str = "is_active",
               active: str = "Active") -> DataFrame:
    """Clear the flag of members whose source row is known and not active."""
    gone = (source.where(F.col("status") != active).select(key).distinct()
            .withColumn("_gone", F.lit(True)))
    return (members.join(gone, key, "left")
            .withColumn(flag, F.when(F.col("_gone"), F.lit(False)).otherwise(F.col(flag)))
            .drop("_gone").select(*members.columns))
