"""Ordinance texts to judged citations, over any source: extract, resolve, pick the version of the day, compare, judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.dates import norm_date
from lexmill.functions.text import is_local_rule, label_numbers, loose_name_key, name_key, particle
from lexmill.functions.wording import DETAIL, say
from lexmill.operators import articles as A
from lexmill.operators import citations as C
from lexmill.operators.asof import asof_join
from lexmill.operators.judge import FIELDS, check_clause, diff_clause, judge_rule, verdict
from lexmill.plans.views import index_names, index_rules
from lexmill.session import write_shared
from lexmill.sources.source import COMPARISON, RULE, Source
from lexmill.sources.tables import latest

FOUND = ("mst", "law_id", "law_name", "article_no", "label", "hang", "ho", "mok", "ord_seq", "naked", "spacing", "version_mst", "ord_enforce", *FIELDS)


def delivered(source: Source) -> DataFrame:
    """The last fetched row of each ordinance."""
    return latest(source.ordinances().where("mst IS NOT NULL"), ["mst"], "fetched_at", ["body_xml", "enforce_date"])


def versions_of(source: Source) -> DataFrame:
    """The last fetched row of each version, with its day as ``start``."""
    v = latest(source.versions().where("law_id IS NOT NULL AND version_mst IS NOT NULL"), ["law_id", "version_mst"], "fetched_at", ["enforce_date", "body_xml"])
    return v.withColumn("start", norm_date(F.col("enforce_date")))


def articles_of(source: Source) -> DataFrame:
    """Articles of the current laws and rules, written once."""
    return write_shared(A.parsed_articles(source.laws(), "law_id", rows=A.rule_rows), "articles")


def resolved(source: Source, units: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Cited units with law_id ('' if unresolved) and the law's present name if it has another.

    Laws come before administrative rules; a name that is no law's and never stands in
    brackets in its document is no citation.
    """
    known = source.names()
    by_name = index_names(known).select("name_key", F.col("law_id").alias("by_name"))
    by_rule = index_names(known, rules=True).select("name_key", F.col("law_id").alias("by_rule"))
    names = units.select("law_name").distinct().select("law_name", name_key(F.col("law_name")).alias("name_key"), loose_name_key(F.col("law_name")).alias("loose"))
    loose = index_rules(source.laws()).select("loose", F.col("law_id").alias("by_loose"))
    ids = names.join(by_name, "name_key", "left").join(by_rule, "name_key", "left").join(loose, "loose", "left").select("law_name", "by_name", F.coalesce("by_name", "by_rule", "by_loose", F.lit("")).alias("law_id"))
    current = A.law_meta(source.laws().where("NOT startswith(law_id, 'ADM')")).where("name != ''").select("law_id", F.col("name").alias("current_name"))
    renamed = F.when(loose_name_key(F.col("current_name")) != loose_name_key(F.col("law_name")), F.col("current_name"))
    ids = ids.join(current, "law_id", "left").select("law_name", "law_id", "by_name", renamed.alias("renamed_to"))
    return units.join(ids, "law_name").where("by_name IS NOT NULL OR NOT naked_only").drop("by_name", "naked_only")


def cited(source: Source, prefixes: tuple[str, ...]) -> DataFrame:
    """Citations of laws read from the ordinances, resolved; written, because every step below starts from them and plans stay small."""
    o = delivered(source)
    refs = C.extract_citations(o, prefixes=prefixes).where("cite_type = '법령'")
    units = write_shared(C.cited_units(refs), "units")
    days = o.select("mst", norm_date(F.col("enforce_date")).alias("own_day"), F.coalesce("enforce_date", F.lit("")).alias("ord_enforce"))
    return write_shared(resolved(source, units, prefixes).join(days, "mst"), "resolved")


def compared(source: Source, units: DataFrame, articles: DataFrame, deep: bool = True) -> DataFrame:
    """Cited clauses with the article's text now and at the ordinance's day, and where a missing one went.

    As-of versions are picked on (law, day) before any body is parsed, and only picked
    bodies are; occurrences meet articles by (law, label), which spreads a hot law.
    Without ``deep`` no version is picked.
    """
    known = units.where("law_id != '' AND renamed_to IS NULL AND label IS NOT NULL")
    now = articles.select("law_id", "label", F.col("content").alias("now"), F.col("enforce_date").alias("article_day"))
    versions = versions_of(source)
    days = known.select("law_id", "own_day").where(F.col("own_day").isNotNull() & F.lit(deep)).distinct()
    picked = asof_join(days, versions.select("law_id", "version_mst", "start"), "law_id", "own_day", "start", "version_mst")
    picked = write_shared(picked.join(versions.select("law_id", "version_mst", F.col("start").alias("version_day")), ["law_id", "version_mst"]), "picked")
    used = versions.join(picked.select("law_id", "version_mst").distinct(), ["law_id", "version_mst"], "left_semi").withColumn("key", F.concat_ws("/", "law_id", "version_mst"))
    then = A.parsed_articles(used, "key", rows=A.rule_rows).select(F.substring_index("key", "/", 1).alias("law_id"), F.substring_index("key", "/", -1).alias("version_mst"), "label", "content")
    then = write_shared(then, "then")
    gone = then.join(articles.select("law_id", "label"), ["law_id", "label"], "left_anti")
    same_text = A.renumbered(gone, articles, by=("law_id", "version_mst", "label")).withColumnRenamed("moved_to", "same_text")
    said = A.came_from(articles).select("law_id", "label", "moved_to", F.col("enforce_date").alias("moved_day"), F.col("content").alias("moved_text"))
    j = known.join(picked, ["law_id", "own_day"], "left").join(now, ["law_id", "label"], "left").join(then.withColumnRenamed("content", "then"), ["law_id", "version_mst", "label"], "left")
    return j.join(same_text, ["law_id", "version_mst", "label"], "left").join(said, ["law_id", "label"], "left")


def judged(source: Source, units: DataFrame, articles: DataFrame, prefixes: tuple[str, ...], deep: bool = True) -> DataFrame:
    """Cited units to verdicts: clauses by their texts, renamed laws once per citing article, unresolved ones once per ordinance."""
    none, unit = F.lit(None).cast("string"), (F.col("hang"), F.col("ho"), F.col("mok"))
    pairs = A.comparisons(source.laws().where(F.startswith("law_id", F.lit(COMPARISON))), "law_id", "body_xml")
    pairs = pairs.select(F.replace("law_id", F.lit(COMPARISON), F.lit(RULE)).alias("law_id"), "label", "old", "new", "day")
    j = compared(source, units, articles, deep).join(pairs, ["law_id", "label"], "left")
    article = F.when(F.col("now").isNotNull(), F.struct(F.col("now").alias("content"), F.col("article_day").alias("enforce_date")))
    alone = check_clause(article, F.col("moved_to"), F.col("own_day"), *unit, label=F.col("label"), moved_day=F.col("moved_day"), moved_text=F.col("moved_text"))
    by_text = diff_clause(F.col("now"), F.col("then"), F.col("same_text"), F.col("own_day"), *unit, label=F.col("label"), old_day=F.col("version_day"), now_day=F.col("article_day"))
    of_rule = judge_rule(F.col("old"), F.col("new"), F.col("day"), F.col("own_day"), alone)
    said = F.when(F.col("version_mst").isNotNull(), by_text).when(F.startswith("law_id", F.lit(RULE)), of_rule).otherwise(alone)
    clauses = j.withColumn("v", said).select(*[c for c in FOUND if c not in FIELDS], *[f"v.{f}" for f in FIELDS])

    def whole(rows: DataFrame, article_no: Column, said: Column, naked: Column) -> DataFrame:
        empty = {"label": F.lit(""), "hang": F.lit(None).cast("int"), "ho": none, "mok": none, "version_mst": none, "spacing": F.lit(False), "naked": naked, "ord_seq": F.col("law_seq"), "article_no": article_no}
        return rows.withColumn("v", said).select(*[empty.get(c, F.col(c)).alias(c) for c in FOUND if c not in FIELDS], *[f"v.{f}" for f in FIELDS])

    laws = units.select("mst", "law_name", "law_id", "renamed_to", "law_seq", "cited_in", "naked_any", "ord_enforce").distinct()
    renamed = laws.where("renamed_to IS NOT NULL").withColumn("at", F.explode(F.when(F.size("cited_in") > 0, F.col("cited_in")).otherwise(F.array(F.lit("")))))
    at = F.array_join(F.transform(F.array_sort(F.transform("cited_in", lambda a: F.struct(label_numbers(a).alias("n"), a.alias("a")))), lambda s: s["a"]), ", ")
    law, new = F.col("law_name"), F.col("renamed_to")
    moved = say(DETAIL["renamed"], law=law, new=new, law_particle=particle(law, "이", "가"), new_particle=particle(new, "으로", "로"))
    local = F.coalesce(is_local_rule(law, prefixes), F.lit(False))
    unknown = F.when(local, verdict("status", "check", "지자체행정규칙", F.lit(DETAIL["local_rule"]))).otherwise(verdict("status", "check", "법령미해결", F.lit(DETAIL["unresolved"])))
    return (
        clauses.unionByName(whole(renamed, F.col("at"), verdict("status", "review", "제명변경", moved), F.lit(False)))
        .unionByName(whole(laws.where("law_id = ''"), at, unknown, F.col("naked_any")))
    )


def findings_of(source: Source, prefixes: tuple[str, ...], deep: bool = True) -> DataFrame:
    """All findings of a source's ordinances, see ``judged``."""
    return judged(source, cited(source, prefixes), articles_of(source), prefixes, deep)
