"""Queries of the general data problems p1, p2, p4 and p6 (p5 is in plans.canon)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.dates import norm_date, norm_version_key
from lexmill.operators.article_diff import article_changes
from lexmill.operators.asof import asof_join
from lexmill.operators.history import close_intervals, coalesce_runs
from lexmill.operators.shred import Group, shred_rows, shred_units, with_heads
from lexmill.session import write_shared
from lexmill.sources.tables import latest, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article and sub-unit of laws and ordinances, with its path and the label of its article."""
    laws = shred_units(table(spark, sf_dir, "laws"), "law_id", "body_xml").withColumn("src", F.lit("laws"))
    last = latest(table(spark, sf_dir, "ordinances"), ["mst"], "fetched_at", ["body_xml"])
    ordinances = shred_units(last, "mst", "body_xml").withColumn("src", F.lit("ordinances"))
    return laws.unionByName(ordinances).select("src", "rec_id", "path", "level", "label")


# The whole of a body, laws and ordinances alike: heads, units with what is nested in them, reasons.
BODY = (
    Group("head", ("기본정보", "자치법규기본정보"), {"name": {"기본정보": "법령명_한글", "자치법규기본정보": "자치법규명"}, "rule_name": "행정규칙명", "promulgated": "공포일자", "number": "공포번호", "in_force": "시행일자", "revise_type": "제개정구분", "department": "담당부서명"}),
    Group(
        "unit", ("조문단위", "조"), {"flag": "조문여부", "number": "조문번호", "branch": "조문가지번호", "title": {"조문단위": "조문제목", "조": "조제목"}, "text": {"조문단위": "조문내용", "조": "조내용"}, "in_force": "조문시행일자", "moved_from": "조문이동이전", "changed": "조문변경여부"},
        (Group("nested", ("항", "호", "목"), {"number": {"항": "항번호", "호": "호번호", "목": "목번호"}, "text": {"항": "항내용", "호": "호내용", "목": "목내용"}}, recursive=True),), "조문",
    ),
    Group("reason", ("제개정이유내용",), {"text": ""}),
)


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated group of laws and ordinances as flat rows with all its leaves and its parent."""
    parts = [(table(spark, sf_dir, "laws"), "laws", "law_id"), (latest(table(spark, sf_dir, "ordinances"), ["mst"], "fetched_at", ["body_xml"]), "ordinances", "mst")]
    laws, ordinances = (shred_rows(df, key, "body_xml", BODY).withColumn("src", F.lit(src)) for df, src, key in parts)
    return laws.unionByName(ordinances)


# The leaves of a body's head that name its version.
HEAD = {"promulgated": "공포일자", "number": "공포번호", "in_force": "시행일자"}


def _observed(df: DataFrame, slot: Column) -> DataFrame:
    """(law_id, version_key, slot, stated) of delivered rows: a missing key is read from the body, stated is the day in force it names."""
    rows = with_heads(df.withColumn("slot", slot).where("law_id IS NOT NULL AND slot IS NOT NULL"), "body_xml", HEAD, ["law_id", "version_key", "slot", "fetched_at"])
    key = F.coalesce(norm_version_key(F.col("version_key")), norm_version_key(F.concat_ws("|", "promulgated", "number")))
    day = norm_date(F.col("in_force"))
    return rows.select("law_id", key.alias("version_key"), "slot", F.when(day.isNotNull(), _stated(2, F.col("fetched_at"), day)).alias("stated")).where("version_key IS NOT NULL")


def _stated(rank: int, at: Column, day: Column) -> Column:
    """A day in force and who says so: bodies (2) before changes (1), later before earlier."""
    return F.struct(F.lit(rank).alias("rank"), at.cast("timestamp_ntz").alias("at"), day.alias("day"))


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[list[str], DataFrame]:
    """The days of delivery and all delivered rows by number of their delivery; the table laws is the last."""
    snapshots, laws = table(spark, sf_dir, "law_snapshots"), table(spark, sf_dir, "laws")
    days = [r[0] for r in snapshots.select("batch_date").where("batch_date IS NOT NULL").distinct().orderBy("batch_date").collect()]  # one row per delivery
    number = F.nullif(F.array_position(F.array(*[F.lit(d) for d in days]), F.col("batch_date")), F.lit(0)) - 1 if days else F.lit(None).cast("long")
    return days, _observed(snapshots, number).unionByName(_observed(laws, F.lit(len(days)).cast("long")))


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of consecutive deliveries (numbered from 0; laws is one more) in which a version was seen."""
    days, seen = _deliveries(spark, sf_dir)
    return coalesce_runs(seen, ["law_id", "version_key"], "slot", len(days) + 1)


def _noted(changes: DataFrame, days: list[str]) -> DataFrame:
    """Versions that changes name, as seen at the delivery the change was detected in (the old one at the delivery before)."""
    at = F.date_format("detected_at", "yyyyMMdd")
    place = F.greatest(F.size(F.filter(F.array(*[F.lit(d) for d in days]).cast("array<string>"), lambda d: F.regexp_replace(d, r"\D", "") <= at)) - 1, F.lit(0)).cast("long")
    slot = F.coalesce(F.when(F.col("detected_at").isNotNull(), place), F.lit(0).cast("long"))
    day = norm_date(F.col("new_enforce"))
    told = F.when(day.isNotNull(), _stated(1, F.col("detected_at"), day))
    sides = F.array(
        F.struct(norm_version_key(F.col("old_key")).alias("version_key"), F.greatest(slot - 1, F.lit(0).cast("long")).alias("slot"), F.when(F.lit(False), told).alias("stated")),
        F.struct(norm_version_key(F.col("new_key")).alias("version_key"), slot.alias("slot"), told.alias("stated")),
    )
    return changes.where("law_id IS NOT NULL").select("law_id", F.inline(sides)).where("version_key IS NOT NULL")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history per law: its versions with the period each was in force.

    Deliveries and changes are unit intervals of a version; their reduction leaves one run
    per version, since leaving the deliveries does not end it, with the day in force stated
    best. The next day in force of the law closes the period.
    """
    days, seen = _deliveries(spark, sf_dir)
    units = seen.unionByName(_noted(table(spark, sf_dir, "law_changes"), days))
    runs = coalesce_runs(units, ["law_id", "version_key"], "slot", len(days) + 1, {"stated": F.col("stated")}, bridge=True)
    versions = runs.select("law_id", "version_key", F.coalesce("stated.day", F.lit("")).alias("valid_from"))
    return close_intervals(versions, "law_id", "valid_from").select("law_id", "version_key", "valid_from", "valid_to")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws and articles added, removed or changed from one delivery to the next."""
    return article_changes(table(spark, sf_dir, "law_snapshots"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with the law version in force on the ordinance's date."""
    findings = table(spark, sf_dir, "findings").where("law_id IS NOT NULL").select("id", "law_id", "mst", norm_date(F.col("ord_enforce")).alias("own_day"))
    dated = table(spark, sf_dir, "ordinances").select("mst", norm_date(F.col("enforce_date")).alias("ord_day"), "fetched_at").where("ord_day IS NOT NULL AND mst IS NOT NULL")
    days = latest(dated, ["mst"], "fetched_at", ["ord_day"])
    stated = findings.where("own_day IS NOT NULL").select("id", "law_id", F.col("own_day").alias("day"))
    borrowed = findings.where("own_day IS NULL AND mst IS NOT NULL").join(days, "mst").select("id", "law_id", F.col("ord_day").alias("day"))
    versions = latest(table(spark, sf_dir, "law_versions").where("law_id IS NOT NULL AND version_mst IS NOT NULL"), ["law_id", "version_mst"], "fetched_at", ["enforce_date"])
    versions = versions.select("law_id", "version_mst", norm_date(F.col("enforce_date")).alias("start"))
    events = write_shared(stated.unionByName(borrowed), "events")  # narrow; counted and then joined
    return asof_join(events, versions, "law_id", "day", "start", "version_mst").select("id", "version_mst")


_PARTED = r"^\s*(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*[.일]?\s*$"
_KEY = r"^\s*(\d{4})\s*[.\-/년]?\s*(\d{1,2})\s*[.\-/월]?\s*(\d{1,2})\s*[.일]?\s*\|\s*제?\s*(\d+)\s*호?\s*$"


def _day_sql(c: str) -> str:
    part = lambda g, n: f"lpad(regexp_extract({c}, '{_PARTED}', {g}), {n}, '0')"
    read = f"CASE WHEN regexp_matches({c}, '^\\s*\\d{{8}}\\s*$') THEN trim({c}) WHEN regexp_matches({c}, '{_PARTED}') THEN {part(1, 4)} || {part(2, 2)} || {part(3, 2)} END"
    return f"(CASE WHEN ({read}) >= '1' AND try_strptime(({read}), '%Y%m%d') IS NOT NULL THEN ({read}) END)"


def _key_sql(c: str) -> str:
    part = lambda g, n: f"lpad(regexp_extract({c}, '{_KEY}', {g}), {n}, '0')"
    return f"(CASE WHEN regexp_matches({c}, '{_KEY}') THEN {part(1, 4)} || {part(2, 2)} || {part(3, 2)} || '|' || regexp_extract({c}, '{_KEY}', 4)::BIGINT END)"


def _leaf_sql(tag: str) -> str:
    return f"regexp_extract(split_part(body_xml, '<조문>', 1), '<{tag}(?:\\s[^>]*)?>\\s*(?:<!\\[CDATA\\[)?\\s*([^<\\]]*?)\\s*(?:\\]\\]>)?\\s*</{tag}>', 1)"


_BODY_KEY = _leaf_sql("공포일자") + " || '|' || " + _leaf_sql("공포번호")
_SEEN_SQL = f"""SELECT law_id, coalesce({_key_sql("version_key")}, {_key_sql("(" + _BODY_KEY + ")")}) AS version_key, slot, fetched_at, {_day_sql(_leaf_sql("시행일자"))} AS day FROM (
 SELECT law_id, version_key, body_xml, fetched_at, dense_rank() OVER (ORDER BY batch_date) - 1 AS slot FROM law_snapshots WHERE batch_date IS NOT NULL
 UNION ALL SELECT law_id, version_key, body_xml, fetched_at, (SELECT count(DISTINCT batch_date) FROM law_snapshots) FROM laws)"""

ORACLE_SQL = {
    "p2_runs": f"""WITH s AS (SELECT DISTINCT law_id, version_key, slot FROM ({_SEEN_SQL}) WHERE law_id IS NOT NULL AND version_key IS NOT NULL),
 g AS (SELECT *, slot - row_number() OVER (PARTITION BY law_id, version_key ORDER BY slot) AS island FROM s)
 SELECT law_id, version_key, min(slot) AS first_slot, max(slot) AS last_slot FROM g GROUP BY law_id, version_key, island""",
    "p2_found": f"""WITH seen AS ({_SEEN_SQL}), c AS (
 SELECT law_id, version_key, arg_max(day, fetched_at) FILTER (day IS NOT NULL) AS body_day, NULL AS told FROM seen GROUP BY 1, 2
 UNION ALL SELECT law_id, {_key_sql("old_key")}, NULL, NULL FROM law_changes
 UNION ALL SELECT law_id, {_key_sql("new_key")}, NULL, arg_max({_day_sql("new_enforce")}, detected_at) FILTER ({_day_sql("new_enforce")} IS NOT NULL) FROM law_changes GROUP BY 1, 2),
 v AS (SELECT law_id, version_key, coalesce(max(body_day), max(told), '') AS valid_from FROM c WHERE law_id IS NOT NULL AND version_key IS NOT NULL GROUP BY 1, 2),
 d AS (SELECT law_id, valid_from, lead(valid_from) OVER (PARTITION BY law_id ORDER BY valid_from) AS following FROM (SELECT DISTINCT law_id, valid_from FROM v))
 SELECT v.law_id, v.version_key, v.valid_from, coalesce(strftime(strptime(d.following, '%Y%m%d') - INTERVAL 1 DAY, '%Y%m%d'), '99991231') AS valid_to FROM v JOIN d USING (law_id, valid_from)""",
    "p6_found": f"""WITH o AS (SELECT mst, arg_max(day, fetched_at) AS day FROM (SELECT mst, fetched_at, {_day_sql("enforce_date")} AS day FROM ordinances) WHERE day IS NOT NULL GROUP BY mst),
 f AS (SELECT id, law_id, coalesce({_day_sql("ord_enforce")}, o.day) AS day FROM findings LEFT JOIN o USING (mst) WHERE law_id IS NOT NULL),
 v AS (SELECT law_id, version_mst, {_day_sql("d")} AS start FROM (SELECT law_id, version_mst, arg_max(coalesce(enforce_date, ''), fetched_at) AS d FROM law_versions GROUP BY 1, 2)),
 s AS (SELECT law_id, start, min(version_mst) AS version_mst FROM v WHERE start IS NOT NULL GROUP BY 1, 2)
 SELECT id, arg_max(version_mst, start) AS version_mst FROM f JOIN s ON f.law_id = s.law_id AND s.start <= f.day GROUP BY id""",
}
QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p2_found": p2_found, "p2_runs": p2_runs, "p4_found": p4_found, "p6_found": p6_found}
