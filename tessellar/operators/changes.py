"""Differences between snapshots, and tables brought up to date by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refresh_plan(current: DataFrame, known: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, action): rows that are new or differ are 'changed', rows that are gone are 'removed'. One shuffle of both sides."""
    new = current.select(key, F.struct(*compared).alias("__new"))
    old = known.select(key, F.struct(*compared).alias("__old"))
    action = F.when(F.col("__new").isNull(), "removed").when(~F.col("__new").eqNullSafe(F.col("__old")), "changed")
    return new.join(old, key, "full_outer").select(key, action.alias("action")).where(F.col("action").isNotNull())


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows put in place of those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def replaced(table: DataFrame, rows: DataFrame, changed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """table without the rows of changed keys and of keys that are no longer current, plus rows."""
    kept = table.join(current.select(key).distinct(), key, "left_semi").join(changed.select(key).distinct(), key, "left_anti")
    return kept.unionByName(rows)


def referenced(table: DataFrame, key: str, *users: DataFrame) -> DataFrame:
    """Rows of table that some of the users refer to."""
    return table.join(_keys(key, users), key, "left_semi")


def orphans(table: DataFrame, key: str, *users: DataFrame) -> DataFrame:
    return table.join(_keys(key, users), key, "left_anti")


def reference_counts(key: str, *users: DataFrame) -> DataFrame:
    """How many rows of all users refer to each key."""
    every = users[0].select(key)
    for u in users[1:]:
        every = every.unionAll(u.select(key))
    return every.groupBy(key).agg(F.count("*").alias("refs"))


def _keys(key: str, users: tuple[DataFrame, ...]) -> DataFrame:
    every = users[0].select(key)
    for u in users[1:]:
        every = every.union(u.select(key))
    return every.distinct()


def needs_rebuild(stored: Column, wanted: Column) -> Column:
    """Whether stored metadata (a struct) differs in any field from what is wanted; missing metadata does."""
    return ~stored.eqNullSafe(wanted)
