"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; column pruning and filters are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], time: str, values: list[str], tie: list[Column] | None = None) -> DataFrame:
    """Of the rows of each key, the one fetched last.

    Partial aggregation runs before the shuffle, so any number of copies of one
    key leaves a map task as one row. A null time is the oldest; rows of equal
    time are ordered by ``tie``, else by the hash of their values, which makes
    the choice the same in every run.
    """
    order = tie or [F.xxhash64(*values)]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(F.col(time), *order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[v].alias(v) for v in values])
