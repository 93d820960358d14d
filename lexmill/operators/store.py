"""Keeping tables: upserts, inserts, append-only logs and freshness, as DataFrames.

Parquet tables are never overwritten in place: these functions give the new state,
which is written to a new path and swapped in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; a value of ``new`` that is not null wins, columns ``new`` lacks stay. Keys are unique in both."""
    fresh = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in new.columns if c not in keys])
    both = old.join(fresh, keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns if c not in keys])


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows of ``new`` in place of those of ``old`` with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it does not have."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def first_seen(rows: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Of each key the row seen first (a null time is the earliest; ties by the values): an append-only log folded."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(time, *values)).alias("r"))
    return first.select(*keys, *[F.col("r")[c].alias(c) for c in values], F.col("r")[time].alias(time))


def freshness(fetched: Column, now: str, days: int | None) -> Column:
    """reuse or fetch: without a limit whatever was fetched is reused, 0 reuses nothing, else up to ``days`` old."""
    if days is None:
        return F.when(fetched.isNotNull(), "reuse").otherwise("fetch")
    if days <= 0:
        return F.lit("fetch")
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return F.when(fetched.cast("timestamp_ntz") >= limit, "reuse").otherwise("fetch")
