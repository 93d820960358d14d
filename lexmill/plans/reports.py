"""Report items, findings browser, change list and acknowledgements over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.wording import ACTION
from lexmill.operators.changes import changed_labels, fold_acks
from lexmill.operators.report import in_order, report_items
from lexmill.plans import views as V
from lexmill.plans.registry import Registry
from lexmill.plans.scalars import _GRADE
from lexmill.sources.tables import table

R = Registry()


def _sql(sentence: str) -> str:
    """A sentence of the report as an SQL expression over the slots below."""
    import re

    out = []
    for k, part in enumerate(re.split(r"\{([^}]+)\}", sentence)):
        if k % 2 == 0:
            out.append("'" + part.replace("'", "''") + "'")
            continue
        name, *particles = part.split("/")
        out.append(name)
        if particles:
            out.append(_particle(name, *particles))
    return "(" + " || ".join(out) + ")"


def _particle(word: str, closed: str, open_: str) -> str:
    return f"CASE WHEN unicode(right({word}, 1)) BETWEEN 44032 AND 55203 AND (unicode(right({word}, 1)) - 44032) % 28 <> 0 THEN '{closed}' ELSE '{open_}' END"


_ITEM = f"""(SELECT f.*, {_GRADE} AS grade, coalesce(nullif(f.law_name, ''), '(법령명 미상)') AS law, coalesce(f.clause_label, '') AS clause, coalesce(f.clause_detail, '') AS unit, coalesce(nullif(f.clause_detail, ''), '해당 호') AS which,
 CASE WHEN coalesce(f.ord_clause, '') <> '' THEN '이 조례 ' || f.ord_clause ELSE '이 조례의 해당 조문' END AS place, coalesce(f.change_type, '') AS ct, coalesce(f.cite_naked, 0) <> 0 AS nk, coalesce(f.cite_spacing, 0) <> 0 AS sp FROM findings f)"""
_SLOTTED = f"""(SELECT * EXCLUDE (detail), coalesce(detail, '') AS detail, law || CASE WHEN clause <> '' THEN ' ' || clause ELSE '' END AS bare, '「' || law || '」' || CASE WHEN clause <> '' THEN ' ' || clause ELSE '' END AS quoted FROM {_ITEM})"""
_WITH_PARTICLES = f"""(SELECT *, {_particle('bare', '을', '를')} AS bare_particle, {_particle('quoted', '으로', '로')} AS quoted_particle FROM {_SLOTTED})"""
_ACTION = f"""CASE WHEN ct = '제명변경' THEN CASE WHEN detail <> '' THEN detail ELSE {_sql(ACTION['renamed'])} END
 WHEN severity = 'current' AND nk THEN {_sql(ACTION['naked_only'])} WHEN severity = 'current' AND sp THEN {_sql(ACTION['spacing_only'])}
 ELSE CASE WHEN severity <> 'current' AND (severity = 'mechanical' OR ct = '번호이동') THEN {_sql(ACTION['mechanical'])}
  WHEN severity = 'review' THEN CASE ct WHEN '내용변경' THEN {_sql(ACTION['내용변경'])} WHEN '삭제' THEN {_sql(ACTION['삭제'])} ELSE {_sql(ACTION['review'])} END
  WHEN ct = '지자체행정규칙' THEN {_sql(ACTION['지자체행정규칙'])} WHEN ct = '법령미해결' THEN {_sql(ACTION['법령미해결'])} WHEN ct = '당시부재' THEN {_sql(ACTION['당시부재'])} WHEN ct = '호미확인' THEN {_sql(ACTION['호미확인'])} ELSE {_sql(ACTION['check'])} END
  || CASE WHEN nk THEN {_sql(ACTION['also_naked'])} ELSE '' END || CASE WHEN sp THEN {_sql(ACTION['also_spacing'])} ELSE '' END END"""


@R.query(f"SELECT id, {_ACTION} AS action FROM {_WITH_PARTICLES} WHERE grade <> 'current'")
def action_text(spark: SparkSession, sf: str) -> DataFrame:
    """What each finding asks to be done, in a sentence."""
    return report_items(table(spark, sf, "findings"), V.ordinances(spark, sf)).select("id", "action")


_NUMBER = lambda c, word, none: f"coalesce(try_cast(nullif(regexp_extract(coalesce({c}, ''), '{word}', 1), '') AS INT), {none})"
_MODEL = f"""SELECT i.id, i.mst, coalesce(nullif(o.name, ''), '(조례명 미상)') AS ord_name, coalesce(o.dept, '') AS ord_dept, coalesce(nullif(o.enforce_date, ''), i.ord_enforce, '') AS ord_day, w.priority, i.grade, coalesce(i.law_name, '') AS law_name, coalesce(i.law_id, '') AS law_id, i.clause AS clause_label, i.unit AS clause_detail, i.ct AS change_type,
 coalesce(i.ord_clause, '') AS ord_clause, coalesce(i.evidence, '') AS evidence, coalesce(nullif(i.ord_enforce, ''), o.enforce_date, '') AS ord_enforce, coalesce(i.old_enforce, '') AS old_enforce, coalesce(i.clause_enforce, '') AS clause_enforce, {_NUMBER('i.ord_clause', '제(\\d+)조', 9999)} AS article_jo, coalesce(i.ord_seq, 999999) AS seq, {_NUMBER('i.clause', '제(\\d+)조', 9999)} AS clause_jo, {_NUMBER('i.clause', '의(\\d+)', 0)} AS clause_ga
 FROM {_ITEM} i LEFT JOIN {V._ORD} o USING (mst) JOIN (SELECT mst, sum(CASE grade WHEN 'mechanical' THEN 100 WHEN 'review' THEN 10 WHEN 'check' THEN 1 ELSE 0 END)::BIGINT AS priority FROM {_ITEM} GROUP BY mst) w ON w.mst = i.mst WHERE i.grade <> 'current'"""


@R.query(_MODEL)
def report_model(spark: SparkSession, sf: str, mst: str | None = None, dept: str | None = None, include_current: bool = False) -> DataFrame:
    """All items of the report in its order, by ordinance of most weight."""
    items = report_items(table(spark, sf, "findings"), V.ordinances(spark, sf), mst, dept, include_current)
    return in_order(items).drop("action", "action_html")


@R.query(f"SELECT id, ord_clause FROM ({_MODEL}) WHERE ord_dept = '도로과'")
def report_of_dept(spark: SparkSession, sf: str) -> DataFrame:
    return report_model(spark, sf, dept="도로과").select("id", "ord_clause")


@R.query(f"SELECT id, ord_clause FROM ({_MODEL}) WHERE mst = (SELECT min(mst) FROM findings)")
def report_of_ordinance(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "findings").agg(F.min("mst")).head()[0]
    return report_model(spark, sf, mst=first or "").select("id", "ord_clause")


def browse(spark: SparkSession, sf: str, change: str | None = None, q: str | None = None) -> DataFrame:
    """Findings of known ordinances by change type and by text in the law's or the ordinance's name, taken literally."""
    f = table(spark, sf, "findings").join(V.ordinances(spark, sf).select("mst", F.col("name").alias("ord_name")), "mst")
    f = f if change is None else f.where(F.coalesce("change_type", F.lit("")) == change)
    return f if not q else f.where(F.contains(F.lower("law_name"), F.lit(q.lower())) | F.contains(F.lower("ord_name"), F.lit(q.lower())))


_BROWSED = f"(SELECT f.*, o.name AS ord_name FROM findings f JOIN {V._ORD} o USING (mst) WHERE coalesce(f.change_type, '') = '내용변경' AND (contains(lower(f.law_name), '법') OR contains(lower(o.name), '법')))"


@R.query(f"SELECT severity, count(*) AS n FROM {_BROWSED} GROUP BY severity")
def findings_counts(spark: SparkSession, sf: str, change: str | None = "내용변경", q: str | None = "법") -> DataFrame:
    """How many findings of each severity a search has, whatever severity is shown."""
    return browse(spark, sf, change, q).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@R.query(f"SELECT id, ord_name, law_name, severity FROM {_BROWSED} WHERE severity = 'review' ORDER BY ord_name NULLS FIRST, ord_seq NULLS FIRST, id LIMIT 300")
def findings_browse(spark: SparkSession, sf: str, severity: str | None = "review", change: str | None = "내용변경", q: str | None = "법", n: int = 300) -> DataFrame:
    """The first ``n`` findings of a search, the gravest first: a page of a browser, whose totals findings_counts gives."""
    f = browse(spark, sf, change, q)
    f = f if severity is None else f.where(F.col("severity") == severity)
    return f.orderBy(F.expr(V._RANK), "ord_name", "ord_seq", "id").limit(n).select("id", "ord_name", "law_name", "severity")


# ---- changes
def _acks(spark: SparkSession, sf: str) -> DataFrame:
    """Acknowledgements made of the log: every third change a day after it was seen, every sixth undone a day later, whole laws by their id."""
    log = V.change_log(spark, sf).where("detected_at IS NOT NULL").withColumn("n", F.length(F.coalesce("old_key", F.lit(""))) + F.length("law_id") + F.substring("law_id", -2, 2).try_cast("int"))
    one = log.where("n % 3 = 0").select("law_id", "new_key", F.lit(True).alias("acked"), F.expr("detected_at + INTERVAL 1 DAY").alias("at"))
    undone = log.where("n % 6 = 0").select("law_id", "new_key", F.lit(False).alias("acked"), F.expr("detected_at + INTERVAL 2 DAY").alias("at"))
    whole = log.where("n % 5 = 0").groupBy("law_id").agg(F.min("detected_at").alias("at")).select("law_id", F.lit(None).cast("string").alias("new_key"), F.lit(True).alias("acked"), F.expr("at + INTERVAL 30 DAY").alias("at"))
    return one.unionByName(undone).unionByName(whole)


_N = "length(coalesce(old_key, '')) + length(law_id) + try_cast(right(law_id, 2) AS INT)"
_ACKED = f"""(WITH log AS (SELECT *, {_N} AS n FROM {V._LOG}), seen AS (SELECT * FROM log WHERE detected_at IS NOT NULL),
 e AS (SELECT law_id, new_key, true AS acked, detected_at + INTERVAL 1 DAY AS t FROM seen WHERE n % 3 = 0 UNION ALL SELECT law_id, new_key, false, detected_at + INTERVAL 2 DAY FROM seen WHERE n % 6 = 0
  UNION ALL SELECT l.law_id, l.new_key, true, w.t FROM (SELECT law_id, min(detected_at) + INTERVAL 30 DAY AS t FROM seen WHERE n % 5 = 0 GROUP BY law_id) w JOIN log l ON l.law_id = w.law_id AND (l.detected_at IS NULL OR l.detected_at <= w.t)),
 last AS (SELECT law_id, new_key, arg_max(acked, struct_pack(t := t, a := acked)) AS acked, max(t) AS t FROM e GROUP BY 1, 2)
 SELECT log.*, coalesce(last.acked, false) AS acked, CASE WHEN last.acked THEN last.t END AS acked_at FROM log LEFT JOIN last USING (law_id, new_key))"""


@R.query(f"SELECT law_id, new_key, acked, strftime(acked_at, '%Y-%m-%d %H:%M:%S') AS acked_at FROM {_ACKED}")
def ack_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Which logged changes are acknowledged, by the last event of each."""
    return fold_acks(V.change_log(spark, sf), _acks(spark, sf)).select("law_id", "new_key", "acked", F.date_format("acked_at", "yyyy-MM-dd HH:mm:ss").alias("acked_at"))


_CHANGES = f"""SELECT l.law_id, l.new_key, l.name, l.old_key, l.new_enforce, l.revise_type, l.acked, coalesce(a.affected_n, 0) AS affected_n, coalesce(a.uncertain_n, 0) AS uncertain_n, coalesce(a.linked_n, 0) AS linked_n FROM {_ACKED} l
 LEFT JOIN (SELECT law_id, new_key, count(*) FILTER (state = 'affected') AS affected_n, count(*) FILTER (state = 'uncertain') AS uncertain_n, count(*) FILTER (state = 'linked') AS linked_n FROM {V._AFFECTED} GROUP BY ALL) a USING (law_id, new_key)"""


def change_list(spark: SparkSession, sf: str, acks: DataFrame, acked_too: bool = False) -> DataFrame:
    """Logged changes with the impact of today's citations: open ones first, the most affecting first, then the latest, then by name."""
    log = fold_acks(V.change_log(spark, sf), acks)
    log = log if acked_too else log.where("NOT acked")
    n = lambda s: F.count_if(F.col("state") == s).alias(f"{s}_n")
    counts = V.affected(spark, sf).groupBy("law_id", "new_key").agg(n("affected"), n("uncertain"), n("linked"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = log.join(counts, ["law_id", "new_key"], "left")
    j = j.orderBy("acked", F.desc(F.coalesce("affected_n", F.lit(0))), F.desc(F.coalesce("uncertain_n", F.lit(0))), F.desc("detected_at"), "name", "law_id", "new_key")
    return j.select("law_id", "new_key", "name", "old_key", "new_enforce", "revise_type", "acked", zero("affected_n"), zero("uncertain_n"), zero("linked_n"))


@R.query(_CHANGES)
def changes_all(spark: SparkSession, sf: str) -> DataFrame:
    return change_list(spark, sf, _acks(spark, sf), acked_too=True)


@R.query(f"SELECT * FROM ({_CHANGES}) WHERE NOT acked")
def changes_open(spark: SparkSession, sf: str) -> DataFrame:
    return change_list(spark, sf, _acks(spark, sf))


_ARTICLES = "(SELECT DISTINCT l_partkey::VARCHAR AS law_id, '제' || l_linenumber || '조' AS label, l_suppkey % 3 = 0 AND l_partkey % 4 <> 0 AS changed FROM lineitem)"


@R.query(f"""WITH a AS (SELECT law_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM {_ARTICLES} WHERE changed GROUP BY law_id),
 c AS (SELECT p_partkey::VARCHAR AS law_id, CASE p_size % 4 WHEN 0 THEN '전부개정' WHEN 1 THEN '일부개정' WHEN 2 THEN '타법폐지제정' END AS revise_type FROM part)
 SELECT law_id, CASE WHEN contains(revise_type, '전부개정') OR contains(revise_type, '제정') THEN 'full' WHEN labels IS NOT NULL THEN 'partial' ELSE 'unknown' END AS mode,
 CASE WHEN contains(coalesce(revise_type, ''), '전부개정') OR contains(coalesce(revise_type, ''), '제정') THEN '' ELSE coalesce(labels, '') END AS labels FROM c LEFT JOIN a USING (law_id)""")
def change_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Mode and labels of changes from the kind of revision and the changed articles, both made of rows."""
    i, c = table(spark, sf, "lineitem"), F.col
    articles = i.select(c("l_partkey").cast("string").alias("law_id"), F.concat(F.lit("제"), c("l_linenumber"), F.lit("조")).alias("label"), ((c("l_suppkey") % 3 == 0) & (c("l_partkey") % 4 != 0)).alias("changed")).distinct()
    kind = F.element_at(F.array(F.lit("전부개정"), F.lit("일부개정"), F.lit("타법폐지제정"), F.lit(None)), (c("p_size") % 4 + 1).cast("int"))
    changes = table(spark, sf, "part").select(c("p_partkey").cast("string").alias("law_id"), F.lit("k").alias("new_key"), kind.alias("revise_type"))
    return changed_labels(changes, articles).select("law_id", "mode", F.array_join("labels", ",").alias("labels"))
