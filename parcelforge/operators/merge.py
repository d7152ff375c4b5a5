"""Idempotent merges of snapshots by key, and appends of rows that are absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that a new run leaves alone.
KEPT_STATES = ("ACKNOWLEDGED", "RESOLVED", "DISMISSED")


def merge(store: DataFrame, found: DataFrame, key: str, state: str = "status", reset: str = "OPEN", kept: tuple[str, ...] = KEPT_STATES) -> DataFrame:
    """``found`` written over ``store`` by ``key``, with ``change`` (created, updated, stale).

    A kept state survives an update, any other becomes ``reset``; rows of the store that are not found again stay.
    Both sides have the same columns.
    """
    rest = [c for c in store.columns if c not in (key, state)]
    old = store.select(F.col(key), F.struct(F.lit(True).alias("there"), *store.columns).alias("old"))
    new = found.select(F.col(key), F.struct(F.lit(True).alias("there"), *store.columns).alias("new"))
    both = old.join(new, key, "full_outer")
    was, now = F.col("old.there").isNotNull(), F.col("new.there").isNotNull()
    settled = F.col(f"old.{state}").isin(*kept)
    return both.select(
        key,
        *(F.when(now, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest),
        F.when(was & (settled | ~now), F.col(f"old.{state}")).otherwise(F.when(now & ~was, F.coalesce(f"new.{state}", F.lit(reset))).otherwise(F.lit(reset))).alias(state),
        F.when(~was, "created").when(now, "updated").otherwise("stale").alias("change"),
    )


def upsert(store: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Found rows replace those of the same key; the others stay."""
    return store.join(found.select(key).hint("merge"), key, "left_anti").unionByName(found)


def append_absent(store: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The store and those found rows whose keys it doesn't have; equal found rows count once."""
    new = found.dropDuplicates(list(keys)).join(store.select(*keys), list(keys), "left_anti")
    return store.unionByName(new)


def changes(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count("*").alias("n"))


def with_history(rows: DataFrame, status: str, at: str, by: str) -> DataFrame:
    """A status update that appends to ``history``, an array of structs (status, at, by)."""
    entry = F.struct(F.lit(status).alias("status"), F.lit(at).alias("at"), F.lit(by).alias("by"))
    return rows.withColumn("history", F.array_append("history", entry)).withColumn("status", F.lit(status))
