"""Attributes as known at event time: bucketed as-of join over validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity_intervals(changes: DataFrame, entity: str, start: str, value: str) -> DataFrame:
    """Half-open intervals [start, end) from successive change days; the last has a null end.

    Of several values that start on one day the smallest counts. Rows without entity
    or start are ignored.
    """
    firsts = changes.where(F.col(entity).isNotNull() & F.col(start).isNotNull()).groupBy(entity, start).agg(F.min(value).alias(value))
    return firsts.withColumn("end", F.lead(start).over(Window.partitionBy(entity).orderBy(start)))


HOT = 1_000_000  # events of one entity and bucket from which on they are spread over several tasks


def asof_join(events: DataFrame, changes: DataFrame, entity: str, event_day: str, start: str, value: str, hot: int = HOT) -> DataFrame:
    """Each event with the value valid on its day, never one that starts later.

    Days are ``YYYYMMDD`` text, buckets are years. An interval is exploded into the years
    it touches, the open one of an entity up to the entity's latest event; intervals and
    events meet by equality of entity and bucket and are held against start <= day < end.
    An event lies in one bucket and one interval, so no row appears twice.

    Events are counted per entity and year first (combined before the shuffle), which
    gives the ends of open intervals and the hot buckets: one of more than ``hot`` events
    is cut into pieces by the hash of the event, and its intervals are repeated for each.

    Inner join: events with a null entity or day, or before the first start, drop out.
    All columns of ``events`` stay, ``value`` is added (in place of a column of that name).
    ``events`` is read twice: give a written table if it is costly.
    """
    year = lambda c: F.substring(c, 1, 4).cast("int")
    firm = events.where(F.col(entity).isNotNull() & F.col(event_day).isNotNull()).withColumn("__bucket", year(F.col(event_day)))
    load = firm.groupBy(F.col(entity).alias("__e"), "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    latest = load.groupBy("__e").agg(F.max("__bucket").alias("__last"))
    spans = validity_intervals(changes, entity, start, value).select(F.col(entity).alias("__e"), F.col(start).alias("__from"), F.col("end").alias("__to"), F.col(value).alias("__value"))
    # Entities without events drop out here; an end before the begin gives no bucket.
    spans = spans.join(latest, "__e").withColumn("__end", F.least(F.coalesce(year(F.col("__to")), F.col("__last")), F.col("__last"))).where(year(F.col("__from")) <= F.col("__end"))
    buckets = spans.select("__e", "__from", "__to", "__value", F.explode(F.sequence(year(F.col("__from")), F.col("__end"))).alias("__bucket"))
    # At most (number of events) / hot rows, which is what bounds the broadcast.
    crowded = load.where(F.col("__n") > hot).select("__e", "__bucket", F.ceil(F.col("__n") / hot).cast("int").alias("__pieces"))
    one = F.coalesce("__pieces", F.lit(1))
    buckets = buckets.join(F.broadcast(crowded), ["__e", "__bucket"], "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), one - 1))).drop("__pieces")
    pieces = F.broadcast(crowded.withColumnRenamed("__bucket", "__year"))
    probes = firm.join(pieces, (firm[entity] == pieces["__e"]) & (firm["__bucket"] == pieces["__year"]), "left")
    probes = probes.select(*firm.columns, F.pmod(F.xxhash64(*events.columns), one).cast("int").alias("__piece"))
    hit = (
        (probes[entity] == buckets["__e"])
        & (probes["__bucket"] == buckets["__bucket"])
        & (probes["__piece"] == buckets["__piece"])
        & (probes[event_day] >= buckets["__from"])
        & (buckets["__to"].isNull() | (probes[event_day] < buckets["__to"]))
    )
    return probes.join(buckets, hit, "inner").select(*[probes[c] for c in events.columns if c != value], F.col("__value").alias(value))
