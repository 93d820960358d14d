"""Changes of laws and what they affect: labels changed, ordinances touched, acknowledgements folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of revision that renew a whole law, the sign of a whole law in a list of labels.
WHOLE_REVISIONS, WHOLE = ("전부개정", "제정"), "*"


def mode_of(revise_type: Column, labels: Column) -> Column:
    """full for a renewed law, partial if changed labels are known, else unknown."""
    whole = F.lit(False)
    for w in WHOLE_REVISIONS:
        whole = whole | F.contains(F.coalesce(revise_type, F.lit("")), F.lit(w))
    return F.when(whole, "full").when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0, "partial").otherwise("unknown")


def changed_labels(changes: DataFrame, articles: DataFrame) -> DataFrame:
    """changes(law_id, new_key, revise_type) with mode and labels, from articles(law_id, label, changed) of the current laws.

    Labels of a law are collected once, before they meet its changes; a renewed law has none.
    """
    per = articles.where("changed").groupBy("law_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    j = changes.join(per, "law_id", "left").withColumn("mode", mode_of(F.col("revise_type"), F.col("labels")))
    return j.select("law_id", "new_key", "mode", F.when(F.col("mode") == "partial", F.col("labels")).otherwise(F.array().cast("array<string>")).alias("labels"))


def stored_labels(text: Column) -> tuple[Column, Column]:
    """(mode, labels) of a stored list of labels: ``*`` is the whole law, nothing is unknown."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "，", ",")
    labels = F.array_distinct(F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda x: x != ""))
    mode = F.when(text == WHOLE, "full").when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise("partial")
    return mode, F.when(mode == "partial", labels).otherwise(F.array().cast("array<string>"))


def affected_ordinances(log: DataFrame, cited: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(law_id, new_key, mst, state, labels): ordinances that changes touch, for all changes in one join.

    log(law_id, new_key, mode, labels); cited(mst, law_id, label) with '' for a bare name,
    each once; links(mst, law_id) are official links. State: ``affected`` if a changed
    label is cited (any, of a renewed law), with those labels; ``uncertain`` if only the
    name is cited, or nothing is known of the change; ``linked`` if the ordinance is
    linked to the law but does not cite it.

    Labels are met by equality on (law, label), so a law cited by a third of all rows is
    spread over its labels; only whole-law changes and bare names meet by law.
    """
    by_label = log.where("mode = 'partial'").select("law_id", "new_key", F.explode("labels").alias("label"))
    rows = lambda df, rank, label: df.select("law_id", "new_key", "mst", rank.alias("rank"), label.alias("label"))
    none = F.lit(None).cast("string")
    hit = rows(cited.where("label != ''").join(by_label, ["law_id", "label"]), F.lit(2), F.col("label"))
    bare = rows(cited.where("label = ''").join(log.where("mode = 'partial'").select("law_id", "new_key"), "law_id"), F.lit(1), none)
    whole = cited.join(log.where("mode != 'partial'").select("law_id", "new_key", "mode"), "law_id")
    full = F.col("mode") == "full"
    whole = rows(whole, F.when(full, 2).otherwise(1), F.when(full & (F.col("label") != ""), F.col("label")))
    every = hit.unionByName(bare).unionByName(whole)
    if links is not None:
        unseen = links.distinct().join(cited.select("mst", "law_id"), ["mst", "law_id"], "left_anti").join(log.select("law_id", "new_key"), "law_id")
        every = every.unionByName(rows(unseen, F.lit(0), none))
    best = every.groupBy("law_id", "new_key", "mst").agg(F.max("rank").alias("rank"), F.array_sort(F.collect_set("label")).alias("labels"))
    state = F.when(F.col("rank") == 2, "affected").when(F.col("rank") == 1, "uncertain").otherwise("linked")
    return best.select("law_id", "new_key", "mst", state.alias("state"), F.array_join(F.when(F.col("rank") == 2, F.col("labels")).otherwise(F.array().cast("array<string>")), ",").alias("labels"))


def fold_acks(log: DataFrame, acks: DataFrame) -> DataFrame:
    """The log with acked (false without an event) and acked_at (null unless acked): the last event of each entry counts.

    acks(law_id, new_key, acked, at): an event with a null new_key is of all entries of
    the law detected by then (``detected_at``). The log itself is never rewritten, so a
    change detected again keeps its acknowledgement. Of events at one time acked wins.
    """
    entries = log.select("law_id", "new_key", "detected_at")
    own = acks.where("new_key IS NOT NULL").select("law_id", "new_key", "acked", "at")
    of_law = acks.where("new_key IS NULL").select("law_id", "acked", "at").join(entries, "law_id").where("detected_at IS NULL OR detected_at <= at")
    every = own.unionByName(of_law.select("law_id", "new_key", "acked", "at"))
    last = every.groupBy("law_id", "new_key").agg(F.max(F.struct("at", "acked")).alias("e"))
    j = log.join(last, ["law_id", "new_key"], "left")
    acked = F.coalesce(F.col("e.acked"), F.lit(False))
    return j.select(*log.columns, acked.alias("acked"), F.when(acked, F.col("e.at")).alias("acked_at"))


def ack(log: DataFrame, law_id: str, new_key: str | None, acked: bool, at: str) -> tuple[DataFrame, int]:
    """The event that (un)acknowledges an entry, or all of a law, and how many entries it concerns."""
    spark = log.sparkSession
    n = log.where(F.col("law_id") == law_id).where(F.lit(True) if new_key is None else F.col("new_key") == new_key).count()
    event = spark.createDataFrame([(law_id, new_key, acked, at)], "law_id string, new_key string, acked boolean, at string")
    return event.withColumn("at", F.col("at").cast("timestamp_ntz")), n
