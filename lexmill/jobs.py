"""Jobs that write the derived tables: a full batch over a source, and a re-derivation from the stored tables.

Sources (ordinances, laws, law_versions) are only read, so what was fetched when is never
touched. Derived tables (citations, findings, law_articles) are rebuilt as a whole and
swapped in; the log of changes is only added to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.dates import norm_version_key
from lexmill.functions.text import label_numbers, unit_label
from lexmill.operators import articles as A
from lexmill.operators import citations as C
from lexmill.operators.changes import WHOLE, changed_labels
from lexmill.operators.sinks import persist_tables, recovered, swap
from lexmill.operators.store import insert_absent
from lexmill.plans import pipeline as P
from lexmill.session import clear_shared
from lexmill.sources.source import Source, TableSource
from lexmill.sources.tables import table

LOG = "law_id string, new_key string, old_key string, name string, new_enforce string, revise_type string, changed_articles string, detected_at timestamp_ntz"
META = "at timestamp_ntz, deep boolean, status string, ordinances_n bigint, laws_n bigint, findings_n bigint"


@dataclass(frozen=True)
class Settings:
    """prefixes: local names; deep: compare with the version of the day; status: ok, incremental, max_age_N or reparsed; at: time of the run; limit: first ordinances only (a trial run)."""

    prefixes: tuple[str, ...] = ()
    deep: bool = True
    status: str = "ok"
    at: str = "1970-01-01 00:00:00"
    limit: int | None = None


def stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(schema).parquet(path) if recovered(spark, path) else spark.createDataFrame([], schema)


def citation_rows(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Citations as stored: labels joined by commas, the law's id beside the name."""
    labels = F.array_join(F.array_distinct(F.transform("tokens", lambda t: t["label"])), ",")
    rows = refs.join(ids.select("mst", "law_name", "law_id").distinct(), ["mst", "law_name"], "left")
    return rows.select("mst", "article_no", "law_name", F.coalesce("law_id", F.lit("")).alias("law_id"), labels.alias("clause_label"), "alias_source", "raw_text", "span_start", "span_end", (F.coalesce(F.col("alias_source") == "naked", F.lit(False))).cast("int").alias("cite_naked"), "ord_seq", "cite_type")


def finding_rows(found: DataFrame) -> DataFrame:
    """Findings as stored."""
    return found.select(
        "mst", "law_id", "law_name", F.col("label").alias("clause_label"), "clause_detail", unit_label(F.col("hang"), F.col("ho"), F.col("mok")).alias("cited_unit"), "category", "severity", "change_type",
        F.col("article_no").alias("ord_clause"), "ord_seq", "detail", "ord_enforce", "old_enforce", "clause_enforce", "evidence", F.col("naked").cast("int").alias("cite_naked"), F.col("spacing").cast("int").alias("cite_spacing"),
    )


def detected(laws: DataFrame, known: DataFrame, articles: DataFrame, at: str) -> DataFrame:
    """Laws whose key differs from the one known before, with the labels changed; new laws and laws without a key are no change."""
    meta = A.law_meta(laws).select("law_id", F.col("name").alias("own_name"), "enforce_date", "revise_type")
    now = laws.select("law_id", "name", norm_version_key(F.col("version_key")).alias("new_key"))
    j = now.join(known.select("law_id", norm_version_key(F.col("version_key")).alias("old_key")), "law_id").where("old_key <> new_key").join(meta, "law_id", "left")
    labels = changed_labels(j.select("law_id", "new_key", "revise_type"), articles)
    text = F.when(F.col("mode") == "full", WHOLE).otherwise(F.array_join("labels", ","))
    return j.join(labels, ["law_id", "new_key"]).select("law_id", "new_key", "old_key", F.coalesce("own_name", "name").alias("name"), F.col("enforce_date").alias("new_enforce"), "revise_type", text.alias("changed_articles"), F.lit(at).cast("timestamp_ntz").alias("detected_at"))


def run_batch(spark: SparkSession, source: Source, folder: str, settings: Settings, known: DataFrame | None = None) -> None:
    """Derive everything from a source into ``folder``; ``known`` (law_id, version_key) is what was known of the laws before."""
    o = P.delivered(source)
    o = o.orderBy("mst").limit(settings.limit) if settings.limit is not None else o
    articles = P.articles_of(source)
    refs = C.extract_citations(o, prefixes=settings.prefixes)
    units = P.cited(source, settings.prefixes)
    units = units.join(o.select("mst"), "mst", "left_semi") if settings.limit is not None else units
    found = P.judged(source, units, articles, settings.prefixes, settings.deep)
    numbers = label_numbers(F.col("label"))
    persist_tables({
        "citations": citation_rows(refs, units.where("law_id != ''")),
        "findings": finding_rows(found),
        "law_articles": articles.select("law_id", "label", numbers["jo"].alias("jo"), numbers["ga"].alias("ga"), "title", "enforce_date", "moved_from", "moved_to", "changed", "content"),
    }, folder)
    if known is not None:
        news = detected(source.laws(), known, articles, settings.at)
        swap(insert_absent(stored(spark, folder, "law_change_log", LOG), news, ["law_id", "new_key"]), f"{folder}/law_change_log.parquet")
    n = lambda df: df.count()
    meta = [(settings.at, settings.deep, settings.status, n(o), n(source.laws()), n(table(spark, folder, "findings")))]
    swap(spark.createDataFrame(meta, META.replace("timestamp_ntz", "string")).withColumn("at", F.col("at").cast("timestamp_ntz")), f"{folder}/batch_meta.parquet")
    clear_shared(spark)


def reparse(spark: SparkSession, sources: str, folder: str, prefixes: tuple[str, ...] = (), deep: bool | None = None, at: str = "1970-01-01 00:00:00") -> None:
    """Derive everything again from the stored tables, as deep as the last run unless told; run twice, it gives the same."""
    last = stored(spark, folder, "batch_meta", META).select("deep").head()
    deep = deep if deep is not None else bool(last[0]) if last else True
    run_batch(spark, TableSource(spark, sources), folder, Settings(prefixes, deep, "reparsed", at))
