"""Histories of changing attributes: tree-reduction coalescing and closing of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.dates import day_before


def coalesce_runs(df: DataFrame, keys: list[str], slot: str, slots: int, carry: dict[str, Column] | None = None, bridge: bool = False) -> DataFrame:
    """Merge neighbouring unit intervals of equal ``keys`` over logarithmic rounds.

    A row says that the payload (part of ``keys``, beside the entity) was observed in
    snapshot number ``slot`` (0 .. slots-1), the unit interval [slot, slot]. In round r
    the blocks of 2^r slots are reduced pairwise: of each block, the run that ends at
    its middle and the run that begins there become one. No group ever holds more than
    two runs, whatever the number of rows of a key, and a run that touches no middle
    passes on in a group of its own. All rounds keep the partitioning of the first
    exchange.

    With ``bridge`` a snapshot in which the payload was not seen does not part two runs:
    the run of one half of a block and that of the other become one whatever lies
    between, so that one run per key is left, which says when it was first and last seen.

    Result: ``keys``, first_slot, last_slot and the carried columns (an expression each,
    aggregated by max; a null never wins). Rows with a null slot are dropped, repeated
    rows count once, null keys form a key of their own, an empty table gives no rows.
    """
    carry = carry or {}
    ones = df.where(F.col(slot).isNotNull()).select(*keys, F.col(slot).cast("long").alias("first_slot"), *[c.alias(n) for n, c in carry.items()])
    ones = ones.groupBy(*keys, "first_slot").agg(F.count(F.lit(1)).alias("__n"), *[F.max(n).alias(n) for n in carry]).drop("__n")
    runs = ones.repartition(*[F.col(k) for k in keys]).withColumn("last_slot", F.col("first_slot"))
    size = 1
    while size < slots:
        size *= 2
        half = size // 2
        middle = F.floor(F.col("first_slot") / size) if bridge else (
            F.when((F.col("last_slot") + 1) % size == half, F.col("last_slot") + 1)
            .when(F.col("first_slot") % size == half, F.col("first_slot"))
            .otherwise(-1 - F.col("first_slot"))
        )
        runs = (
            runs.groupBy(*keys, middle.alias("__middle"))
            .agg(F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"), *[F.max(n).alias(n) for n in carry])
            .drop("__middle")
        )
    return runs.select(*keys, "first_slot", "last_slot", *carry)


def close_intervals(versions: DataFrame, entity: str, start: str, end: str = "valid_to", forever: str = "99991231") -> DataFrame:
    """Add the last day of each version: the day before the entity's next start.

    ``start`` is ``YYYYMMDD`` or '' for unknown, which comes first. Versions of one
    start share their end. The window runs over the distinct starts of an entity, of
    which there are at most as many as days in the calendar, however many rows it has.
    A null entity is one of its own, a null start gives no row; a column named ``end`` is replaced.
    """
    versions = versions.drop(end)
    starts = versions.select(entity, start).distinct()
    following = F.lead(start).over(Window.partitionBy(entity).orderBy(start))
    closed = starts.withColumn(end, F.coalesce(day_before(following), F.lit(forever)))
    return versions.join(closed, (versions[entity].eqNullSafe(closed[entity])) & (versions[start] == closed[start]), "inner").drop(closed[entity]).drop(closed[start])
