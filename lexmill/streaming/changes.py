"""Snapshots that arrive over time: an append-only log of version changes.

Each micro-batch is a set of delivered laws. The state is a table of the last key seen
per law and a log; both are rebuilt beside the old ones and swapped, so a batch that is
run again after a failure leaves the same log (a change is logged once by law and key).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions.dates import norm_version_key
from lexmill.operators.sinks import recovered, swap
from lexmill.operators.store import insert_absent, replace_rows

STATE = "law_id string, version_key string"
LOG = "law_id string, new_key string, old_key string, detected_at timestamp_ntz"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if recovered(spark, path) else spark.createDataFrame([], schema)


def apply_batch(batch: DataFrame, folder: str) -> None:
    """Fold one delivery: laws whose key differs from the last one known are logged, new laws are not."""
    spark = batch.sparkSession
    state_path, log_path = os.path.join(folder, "state"), os.path.join(folder, "log")
    rows = batch.select("law_id", norm_version_key(F.col("version_key")).alias("version_key"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at")).where("law_id IS NOT NULL AND version_key IS NOT NULL")
    seen = rows.groupBy("law_id").agg(F.max(F.struct("fetched_at", "version_key")).alias("m")).select("law_id", "m.version_key", "m.fetched_at")
    old = _table(spark, state_path, STATE)
    found = seen.join(old.select("law_id", F.col("version_key").alias("old_key")), "law_id").where("old_key <> version_key")
    news = found.select("law_id", F.col("version_key").alias("new_key"), "old_key", F.col("fetched_at").alias("detected_at"))
    swap(insert_absent(_table(spark, log_path, LOG), news, ["law_id", "new_key"]), log_path)
    swap(replace_rows(old, seen.select("law_id", "version_key"), ["law_id"]), state_path)


def follow(spark: SparkSession, drops: str, folder: str, schema: str, checkpoint: str) -> StreamingQuery:
    """Read every new file below ``drops`` as one delivery and keep the log below ``folder``; ends when all is read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(drops)
    run = lambda batch, _: apply_batch(batch, folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
