"""Joins, rollups, searches, orderings and incremental steps over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions.dates import norm_version_key
from lexmill.operators import store
from lexmill.operators.changes import affected_ordinances, stored_labels
from lexmill.plans.registry import Registry
from lexmill.plans.scalars import _GRADE, _KIND, PREFIXES, graded
from lexmill.sources.source import RULE, TableSource
from lexmill.sources.tables import table

R = Registry()

# One row per mst: the row fetched last; equal times are decided by name, department and date.
_ORD = """(SELECT mst, name, dept, enforce_date FROM (SELECT *, row_number() OVER (PARTITION BY mst ORDER BY fetched_at DESC NULLS LAST, name DESC NULLS LAST, dept DESC NULLS LAST, enforce_date DESC NULLS LAST) AS k FROM ordinances WHERE mst IS NOT NULL) WHERE k = 1)"""
_GRADED = f"(SELECT *, {_GRADE} AS grade FROM findings)"


def ordinances(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["name", "dept", "enforce_date"]
    o = table(spark, sf, "ordinances").where("mst IS NOT NULL")
    return o.groupBy("mst").agg(F.max_by(F.struct(*cols), F.struct("fetched_at", *cols)).alias("r")).select("mst", *[F.col("r")[c].alias(c) for c in cols])


def _filled(c: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))


def scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every ordinance with its findings by grade; findings are counted before the join."""
    counts = graded(table(spark, sf, "findings").where("severity IS NOT NULL")).groupBy("mst").agg(*[F.count_if(F.col("grade") == g).alias(g) for g in X.GRADES], F.count_if(F.col("grade") != "current").alias("items"))
    return ordinances(spark, sf).join(counts, "mst", "left").select("mst", _filled("name", "(조례명 미상)").alias("name"), _filled("dept", "(미지정)").alias("dept"), F.coalesce("enforce_date", F.lit("")).alias("enforce_date"), *[F.coalesce(g, F.lit(0)).alias(g) for g in (*X.GRADES, "items")])


_COUNTS = ", ".join(f"count(*) FILTER (grade = '{g}') AS \"{g}\"" for g in X.GRADES)
_SUMS = ", ".join(f'sum("{g}")::BIGINT AS "{g}"' for g in X.GRADES)
_SCAN = f"""(SELECT o.mst, coalesce(nullif(o.name,''),'(조례명 미상)') AS name, coalesce(nullif(o.dept,''),'(미지정)') AS dept, coalesce(o.enforce_date,'') AS enforce_date, {", ".join(f'coalesce("{g}",0) AS "{g}"' for g in (*X.GRADES, "items"))}
 FROM {_ORD} o LEFT JOIN (SELECT mst, {_COUNTS}, count(*) FILTER (grade <> 'current') AS items FROM {_GRADED} WHERE severity IS NOT NULL GROUP BY mst) f USING (mst))"""


@R.query(f"SELECT * FROM {_SCAN}")
def scan_grades(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf)


@R.query(f"SELECT count(*) AS ordinances, count(*) FILTER (items > 0) AS action, count(DISTINCT dept) AS depts, {_SUMS} FROM {_SCAN}")
def overview_totals(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf).agg(F.count(F.lit(1)).alias("ordinances"), F.count_if(F.col("items") > 0).alias("action"), F.countDistinct("dept").alias("depts"), *[F.sum(g).alias(g) for g in X.GRADES])


def departments(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf).groupBy("dept").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("items") > 0).alias("action"), *[F.sum(g).alias(g) for g in X.GRADES])


_DEPTS = f"(SELECT dept, count(*) AS total, count(*) FILTER (items > 0) AS action, {_SUMS} FROM {_SCAN} GROUP BY dept)"


@R.query(f"SELECT * FROM {_DEPTS} ORDER BY action DESC, dept")
def overview_depts(spark: SparkSession, sf: str) -> DataFrame:
    return departments(spark, sf).orderBy(F.desc("action"), "dept")


# A parameter: bureaus and their departments in organisational order.
BUREAUS = (("01", "행정국", ("총무과", "회계과", "세정과", "정보통신과")), ("02", "복지국", ("복지정책과", "보건행정과", "평생학습과")), ("03", "도시국", ("도로과", "주택과", "건축허가과", "교통행정과")))


def rollup_bureaus(depts: DataFrame, bureaus: tuple = BUREAUS) -> DataFrame:
    """Departments below bureaus; departments of no bureau go to 기타, empty bureaus drop out."""
    rows = [(no, name, d) for no, name, members in bureaus for d in members]
    mapping = depts.sparkSession.createDataFrame(rows, "no string, bureau string, dept string")  # a fixed list
    return depts.join(F.broadcast(mapping), "dept", "left").groupBy(F.coalesce("no", F.lit("")).alias("no"), F.coalesce("bureau", F.lit("기타")).alias("bureau")).agg(*[F.sum(c).alias(c) for c in ("total", "action", *X.GRADES)], F.count(F.lit(1)).alias("depts"))


_VALUES = ", ".join(f"('{no}', '{name}', '{d}')" for no, name, ms in BUREAUS for d in ms)


@R.query(f"SELECT coalesce(no, '') AS no, coalesce(bureau, '기타') AS bureau, sum(total)::BIGINT AS total, sum(action)::BIGINT AS action, {_SUMS}, count(*) AS depts FROM {_DEPTS} d LEFT JOIN (VALUES {_VALUES}) b(no, bureau, dept) USING (dept) GROUP BY 1, 2")
def dept_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rollup_bureaus(departments(spark, sf))


# ---- name resolution
def index_names(names: DataFrame, rules: bool = False) -> DataFrame:
    """(name_key, law_id, prio) of laws, or of administrative rules, from a source's names: the smallest (prio, place) of a name."""
    every = names.where(F.startswith("law_id", F.lit(RULE)) == F.lit(rules)).select(X.name_key(F.col("name")).alias("name_key"), "law_id", "prio", "place")
    return every.groupBy("name_key").agg(F.min(F.struct("prio", "place", "law_id")).alias("m")).select("name_key", "m.law_id", "m.prio")


def name_index(spark: SparkSession, sf: str, rules: bool = False) -> DataFrame:
    """The same of the stored tables: citations before findings before laws, the smallest place within each."""
    return index_names(TableSource(spark, sf).names(), rules)


_INDEX = """(SELECT name_key, law_id, prio FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY prio, place, law_id) AS k FROM (
 SELECT replace(law_name,' ','') AS name_key, law_id, 0 AS prio, lpad(id::VARCHAR, 20, '0') AS place FROM citations WHERE law_name IS NOT NULL AND law_id <> '' AND law_id NOT LIKE 'ADM:%'
 UNION ALL SELECT replace(law_name,' ',''), law_id, 1, lpad(id::VARCHAR, 20, '0') FROM findings WHERE law_name IS NOT NULL AND law_id <> '' AND law_id NOT LIKE 'ADM:%'
 UNION ALL SELECT replace(name,' ',''), law_id, 2, lpad(law_id, 20, '0') FROM laws WHERE name IS NOT NULL AND law_id <> '' AND law_id NOT LIKE 'ADM:%')) WHERE k = 1)"""


@R.query(f"SELECT name_key, law_id, prio FROM {_INDEX}")
def name_index_priority(spark: SparkSession, sf: str) -> DataFrame:
    return name_index(spark, sf)


_ADM = """(SELECT regexp_replace(name, '[ \\t\\n\\r·ㆍ・]', '', 'g') AS loose, min(law_id) AS law_id FROM laws WHERE law_id LIKE 'ADM:%' AND name IS NOT NULL GROUP BY 1)"""


def index_rules(laws: DataFrame) -> DataFrame:
    """(loose, law_id) of administrative rules by their name without blanks and middle dots."""
    return laws.where(F.startswith("law_id", F.lit(RULE)) & F.col("name").isNotNull()).groupBy(X.loose_name_key(F.col("name")).alias("loose")).agg(F.min("law_id").alias("law_id"))


def rule_index(spark: SparkSession, sf: str) -> DataFrame:
    return index_rules(table(spark, sf, "laws"))


@R.query(f"SELECT n.law_name, a.law_id FROM (SELECT DISTINCT law_name, regexp_replace(law_name, '[ \\t\\n\\r·ㆍ・]', '', 'g') AS loose FROM citations WHERE law_name IS NOT NULL) n JOIN {_ADM} a USING (loose)")
def admrul_exact_resolve(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "citations").select("law_name").where("law_name IS NOT NULL").distinct()
    return names.join(rule_index(spark, sf), X.loose_name_key(names.law_name) == F.col("loose")).select("law_name", "law_id")


@R.query(f"SELECT n.law_name, i.law_id AS by_name, a.law_id AS by_rule, coalesce(i.law_id, a.law_id) AS resolved FROM (SELECT DISTINCT law_name, replace(law_name,' ','') AS name_key, regexp_replace(law_name, '[ \\t\\n\\r·ㆍ・]', '', 'g') AS loose FROM citations WHERE law_name IS NOT NULL) n LEFT JOIN {_INDEX} i USING (name_key) LEFT JOIN {_ADM} a USING (loose)")
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct cited names through the index, then through the administrative rules; unresolved ones stay null."""
    names = table(spark, sf, "citations").select("law_name").where("law_name IS NOT NULL").distinct()
    index = name_index(spark, sf).select(F.col("name_key"), F.col("law_id").alias("by_name"))
    rules = rule_index(spark, sf).select("loose", F.col("law_id").alias("by_rule"))
    return names.join(index, X.name_key(names.law_name) == index.name_key, "left").join(rules, X.loose_name_key(names.law_name) == rules.loose, "left").select("law_name", "by_name", "by_rule", F.coalesce("by_name", "by_rule").alias("resolved"))


@R.query(f"SELECT n.law_name, l.law_id, l.name AS current_name FROM (SELECT DISTINCT law_name, law_id FROM citations WHERE law_name IS NOT NULL AND law_id <> '') n JOIN laws l USING (law_id) WHERE regexp_replace(n.law_name, '[ \\t\\n\\r·ㆍ・]', '', 'g') <> regexp_replace(l.name, '[ \\t\\n\\r·ㆍ・]', '', 'g')")
def renamed_law(spark: SparkSession, sf: str) -> DataFrame:
    """Cited names that differ from the stored name of the law they resolve to."""
    cited = table(spark, sf, "citations").where("law_name IS NOT NULL AND law_id <> ''").select("law_name", "law_id").distinct()
    laws = table(spark, sf, "laws").select("law_id", F.col("name").alias("current_name"))
    return cited.join(laws, "law_id").where(X.loose_name_key(F.col("law_name")) != X.loose_name_key(F.col("current_name"))).select("law_name", "law_id", "current_name")


@R.query("""SELECT law_name, count(*) AS n, bool_and(coalesce(cite_naked,0) <> 0) AS naked_only FROM citations WHERE law_name IS NOT NULL AND (law_id IS NULL OR law_id = '') GROUP BY law_name""")
def unresolved_law(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "citations").where("law_name IS NOT NULL AND (law_id IS NULL OR law_id = '')")
    return c.groupBy("law_name").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("cite_naked", F.lit(0)) != 0).alias("naked_only"))


@R.query(f"SELECT c.mst, c.article_no, c.law_name, min(o.mst) AS target FROM (SELECT DISTINCT mst, article_no, law_name FROM citations WHERE law_name <> '') c JOIN {_ORD} o ON replace(c.law_name,' ','') = replace(o.name,' ','') AND o.mst <> c.mst GROUP BY ALL")
def local_ref_resolve(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "citations").where("law_name <> ''").select("mst", "article_no", "law_name").distinct()
    return local_targets(c, ["mst", "article_no", "law_name"], ordinances(spark, sf))


def local_targets(cited: DataFrame, by: list[str], ordinances: DataFrame) -> DataFrame:
    """(*by, target) of cited(mst, law_name, ...) that name an ordinance(mst, name), never the citing one; of several the smallest mst.

    The two smallest ordinances of a name are found first, so a name many share is no long list to meet.
    """
    named = ordinances.groupBy(X.name_key(F.col("name")).alias("k")).agg(F.min("mst").alias("first"))
    second = ordinances.withColumn("k", X.name_key(F.col("name"))).join(named, "k").where("mst <> first").groupBy("k").agg(F.min("mst").alias("second"))
    two = named.join(second, "k", "left").select("k", "first", "second")
    c = cited.withColumn("k", X.name_key(F.col("law_name"))).join(two, "k")
    target = F.when(F.col("first") == F.col("mst"), F.col("second")).otherwise(F.col("first"))
    return c.withColumn("target", target).where("target IS NOT NULL").groupBy(*by).agg(F.min("target").alias("target"))


# ---- changes and affected ordinances
_MODE = """CASE WHEN changed_articles = '*' THEN 'full' WHEN coalesce(changed_articles,'') = '' THEN 'unknown' ELSE 'partial' END"""


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """(law_id, new_key): the first detection of each change, whatever the order of arrival."""
    rows = table(spark, sf, "law_changes").where("law_id IS NOT NULL AND new_key IS NOT NULL")
    return store.first_seen(rows, ["law_id", "new_key"], "detected_at", ["old_key", "changed_articles", "name", "new_enforce", "revise_type"])


_LOG = """(SELECT law_id, new_key, old_key, changed_articles, detected_at, name, new_enforce, revise_type FROM (SELECT *, row_number() OVER (PARTITION BY law_id, new_key ORDER BY detected_at NULLS FIRST, old_key NULLS FIRST, changed_articles NULLS FIRST, name NULLS FIRST, new_enforce NULLS FIRST, revise_type NULLS FIRST) AS k FROM law_changes WHERE law_id IS NOT NULL AND new_key IS NOT NULL) WHERE k = 1)"""


@R.query(f"SELECT law_id, new_key, old_key, changed_articles, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected FROM {_LOG}")
def change_log_append(spark: SparkSession, sf: str) -> DataFrame:
    return change_log(spark, sf).select("law_id", "new_key", "old_key", "changed_articles", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss").alias("detected"))


@R.query(f"SELECT law_id, new_key, {_MODE} AS mode FROM {_LOG}")
def change_mode(spark: SparkSession, sf: str) -> DataFrame:
    return change_log(spark, sf).select("law_id", "new_key", stored_labels(F.col("changed_articles"))[0].alias("mode"))


def _cited_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(mst, law_id, label): labels an ordinance cites of a law, '' for the bare name."""
    c = table(spark, sf, "citations").where("mst IS NOT NULL AND law_id <> ''")
    return c.select("mst", "law_id", F.explode(F.split(F.coalesce("clause_label", F.lit("")), ",")).alias("label")).select("mst", "law_id", F.trim("label").alias("label")).distinct()


def affected(spark: SparkSession, sf: str) -> DataFrame:
    """(law_id, new_key, mst, state, labels): known ordinances the logged changes touch; findings stand in for official links."""
    mode, labels = stored_labels(F.col("changed_articles"))
    log = change_log(spark, sf).select("law_id", "new_key", mode.alias("mode"), labels.alias("labels"))
    links = table(spark, sf, "findings").where("mst IS NOT NULL AND law_id <> ''").select("mst", "law_id")
    return affected_ordinances(log, _cited_labels(spark, sf), links).join(ordinances(spark, sf).select("mst"), "mst", "left_semi")


_AFFECTED = f"""(WITH log AS (SELECT law_id, new_key, {_MODE} AS mode, regexp_replace(coalesce(changed_articles,''), '，', ',', 'g') AS ca FROM {_LOG}),
 cited AS (SELECT DISTINCT mst, law_id, trim(unnest(string_split(coalesce(clause_label,''), ','))) AS label FROM citations WHERE mst IS NOT NULL AND law_id <> ''),
 ch AS (SELECT DISTINCT law_id, new_key, trim(unnest(string_split(ca, ','))) AS label FROM log WHERE mode = 'partial'),
 u AS (SELECT law_id, new_key, mst, 2 AS rank, label FROM cited JOIN ch USING (law_id, label) WHERE label <> ''
  UNION ALL SELECT law_id, new_key, mst, 1, NULL FROM cited JOIN log USING (law_id) WHERE mode = 'partial' AND label = ''
  UNION ALL SELECT law_id, new_key, mst, CASE WHEN mode = 'full' THEN 2 ELSE 1 END, CASE WHEN mode = 'full' THEN nullif(label, '') END FROM cited JOIN log USING (law_id) WHERE mode <> 'partial'
  UNION ALL SELECT l.law_id, new_key, mst, 0, NULL FROM (SELECT DISTINCT mst, law_id FROM findings WHERE mst IS NOT NULL AND law_id <> '') l JOIN log USING (law_id) WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.mst = l.mst AND c.law_id = l.law_id))
 SELECT law_id, new_key, mst, CASE max(rank) WHEN 2 THEN 'affected' WHEN 1 THEN 'uncertain' ELSE 'linked' END AS state, CASE WHEN max(rank) = 2 THEN coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') ELSE '' END AS labels FROM u WHERE mst IN (SELECT mst FROM ordinances) GROUP BY law_id, new_key, mst)"""


@R.query(f"SELECT * FROM {_AFFECTED}")
def affected_by_change(spark: SparkSession, sf: str) -> DataFrame:
    return affected(spark, sf)


@R.query(f"SELECT law_id, new_key, count(*) FILTER (state = 'affected') AS affected_n, count(*) FILTER (state = 'uncertain') AS uncertain_n FROM {_AFFECTED} GROUP BY ALL")
def affected_counts(spark: SparkSession, sf: str) -> DataFrame:
    return affected(spark, sf).groupBy("law_id", "new_key").agg(F.count_if(F.col("state") == "affected").alias("affected_n"), F.count_if(F.col("state") == "uncertain").alias("uncertain_n"))


@R.query(f"SELECT l.law_id, l.new_key, l.old_key, coalesce(a.affected_n, 0) AS affected_n, coalesce(a.uncertain_n, 0) AS uncertain_n FROM {_LOG} l LEFT JOIN (SELECT law_id, new_key, count(*) FILTER (state = 'affected') AS affected_n, count(*) FILTER (state = 'uncertain') AS uncertain_n FROM {_AFFECTED} GROUP BY ALL) a USING (law_id, new_key) ORDER BY affected_n DESC, uncertain_n DESC, law_id, new_key")
def change_report(spark: SparkSession, sf: str) -> DataFrame:
    """The log with the impact recomputed from today's citations, the most affecting first."""
    counts = affected_counts(spark, sf)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return change_log(spark, sf).join(counts, ["law_id", "new_key"], "left").select("law_id", "new_key", "old_key", zero("affected_n"), zero("uncertain_n")).orderBy(F.desc("affected_n"), F.desc("uncertain_n"), "law_id", "new_key")


@R.query("""SELECT DISTINCT f.mst, f.law_id FROM findings f WHERE f.mst IS NOT NULL AND f.law_id <> '' AND f.mst IN (SELECT mst FROM ordinances) AND NOT EXISTS (SELECT 1 FROM citations c WHERE c.mst = f.mst AND c.law_id = f.law_id)""")
def linked_not_cited(spark: SparkSession, sf: str) -> DataFrame:
    """Links of an ordinance to a law (here: those of findings) that no citation shows."""
    links = table(spark, sf, "findings").where("mst IS NOT NULL AND law_id <> ''").select("mst", "law_id").distinct()
    return links.join(ordinances(spark, sf), "mst", "left_semi").join(table(spark, sf, "citations").select("mst", "law_id"), ["mst", "law_id"], "left_anti")


_VKEY = r"regexp_extract(trim({c}), '^(\d{{4}})[.\-/]?\s*(\d{{1,2}})[.\-/]?\s*(\d{{1,2}})\.?\s*\|\s*제?(\d+)호?$', {g})"
_NORM = lambda c: f"CASE WHEN {_VKEY.format(c=c, g=1)} <> '' THEN {_VKEY.format(c=c, g=1)} || lpad({_VKEY.format(c=c, g=2)}, 2, '0') || lpad({_VKEY.format(c=c, g=3)}, 2, '0') || '|' || ({_VKEY.format(c=c, g=4)})::BIGINT END"


@R.query(f"""WITH s AS (SELECT law_id, arg_max({_NORM('version_key')}, fetched_at) FILTER ({_NORM('version_key')} IS NOT NULL) AS old_key FROM law_snapshots WHERE batch_date = (SELECT max(batch_date) FROM law_snapshots WHERE batch_date < (SELECT max(batch_date) FROM law_snapshots)) GROUP BY law_id),
 n AS (SELECT law_id, {_NORM('version_key')} AS new_key FROM laws) SELECT law_id, old_key, new_key FROM s JOIN n USING (law_id) WHERE old_key <> new_key""")
def version_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Laws whose key differs from the one of the delivery before the last; new laws are no change."""
    s = table(spark, sf, "law_snapshots").select("law_id", "batch_date", norm_version_key(F.col("version_key")).alias("key"), "fetched_at")
    days = sorted(r[0] for r in s.select("batch_date").where("batch_date IS NOT NULL").distinct().collect())  # one row per delivery
    before = days[-2] if len(days) > 1 else None
    old = s.where((F.col("batch_date") == F.lit(before)) & F.col("key").isNotNull()).groupBy("law_id").agg(F.max_by("key", "fetched_at").alias("old_key"))
    new = table(spark, sf, "laws").select("law_id", norm_version_key(F.col("version_key")).alias("new_key"))
    return old.join(new, "law_id").where("old_key <> new_key").select("law_id", "old_key", "new_key")


# ---- findings, reports, searches
@R.query(f"SELECT f.id, f.mst, o.name AS ord_name, f.grade, coalesce(f.ord_seq, 999999) AS seq FROM {_GRADED} f LEFT JOIN {_ORD} o USING (mst) WHERE f.grade <> 'current'")
def report_items(spark: SparkSession, sf: str) -> DataFrame:
    f = graded(table(spark, sf, "findings")).where("grade <> 'current'")
    return f.join(ordinances(spark, sf).select("mst", F.col("name").alias("ord_name")), "mst", "left").select("id", "mst", "ord_name", "grade", F.coalesce("ord_seq", F.lit(999999)).alias("seq"))


@R.query(f"SELECT count(DISTINCT mst) AS ordinances_total, count(DISTINCT CASE WHEN grade <> 'current' THEN mst END) AS ordinances_action, {_COUNTS} FROM {_GRADED}")
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = graded(table(spark, sf, "findings"))
    return f.agg(F.countDistinct("mst").alias("ordinances_total"), F.countDistinct(F.when(F.col("grade") != "current", F.col("mst"))).alias("ordinances_action"), *[F.count_if(F.col("grade") == g).alias(g) for g in X.GRADES])


@R.query(f"SELECT mst, name, mechanical * 100 + review * 10 + \"check\" AS weight FROM {_SCAN} WHERE items > 0 ORDER BY weight DESC, name, mst")
def report_priority(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf).where("items > 0").select("mst", "name", (F.col("mechanical") * 100 + F.col("review") * 10 + F.col("check")).alias("weight")).orderBy(F.desc("weight"), "name", "mst")


@R.query(f"SELECT mst, name, items FROM {_SCAN} ORDER BY items DESC, mst LIMIT 15")
def top_ordinances(spark: SparkSession, sf: str, n: int = 15) -> DataFrame:
    return scan(spark, sf).select("mst", "name", "items").orderBy(F.desc("items"), "mst").limit(n)


_Q = "온천"


@R.query(f"""SELECT mst, name, items, in_name, coalesce(hits, '') AS law_hits FROM (SELECT s.*, contains(replace(name,' ',''), '{_Q}') AS in_name, CASE WHEN contains(replace(name,' ',''), '{_Q}') THEN '' ELSE h.hits END AS hits, h.hits IS NOT NULL AS by_law
 FROM {_SCAN} s LEFT JOIN (SELECT mst, string_agg(law_name, ',' ORDER BY law_name) AS hits FROM (SELECT DISTINCT mst, law_name FROM citations WHERE contains(lower(law_name), lower('{_Q}'))) GROUP BY mst) h USING (mst)) WHERE in_name OR by_law""")
def search_ordinances(spark: SparkSession, sf: str, q: str = _Q) -> DataFrame:
    """Ordinances whose name (without spaces) or a cited law holds the text, taken literally; names of hit laws unless the name hit."""
    hits = table(spark, sf, "citations").where(F.contains(F.lower("law_name"), F.lit(q.lower()))).select("mst", "law_name").distinct()
    hits = hits.groupBy("mst").agg(F.array_join(F.array_sort(F.collect_set("law_name")), ",").alias("hits"))
    key = q.replace(" ", "")
    s = scan(spark, sf).join(hits, "mst", "left").withColumn("in_name", F.contains(X.name_key(F.col("name")), F.lit(key)))
    return s.where("in_name OR hits IS NOT NULL").select("mst", "name", "items", "in_name", F.when(F.col("in_name"), "").otherwise(F.col("hits")).alias("law_hits"))


@R.query(f"SELECT mst, name, items FROM {_SCAN} WHERE dept = '도로과' AND items > 0 ORDER BY items DESC, name, mst")
def list_by_dept(spark: SparkSession, sf: str, dept: str | None = "도로과", action: bool = True) -> DataFrame:
    """Ordinances of a department (of all without one), those with something to do if ``action``."""
    rows = scan(spark, sf).where(F.lit(True) if dept is None else F.col("dept") == dept)
    return rows.where("items > 0" if action else "true").select("mst", "name", "items").orderBy(F.desc("items"), "name", "mst")


@R.query(f"SELECT mst, nullif(trim(enforce_date), '') AS day FROM {_SCAN} ORDER BY day NULLS LAST, mst")
def list_sorted_by_date(spark: SparkSession, sf: str, newest: bool = False) -> DataFrame:
    """The whole list, oldest or newest first, those without a day last."""
    day = F.desc_nulls_last("day") if newest else F.asc_nulls_last("day")
    return scan(spark, sf).select("mst", F.nullif(F.trim("enforce_date"), F.lit("")).alias("day")).orderBy(day, "mst")


@R.query(R.oracles["list_sorted_by_date"])
def list_all_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """The same list under the name it was first whole by."""
    return list_sorted_by_date(spark, sf)


_RANK = "CASE severity WHEN 'mechanical' THEN 0 WHEN 'review' THEN 1 WHEN 'check' THEN 2 WHEN 'current' THEN 3 ELSE 4 END"


@R.query(f"SELECT f.id, f.severity, o.name FROM findings f JOIN {_ORD} o USING (mst) WHERE (contains(f.law_name, '법') OR contains(o.name, '법')) ORDER BY {_RANK}, o.name NULLS FIRST, f.ord_seq NULLS FIRST, f.id LIMIT 300")
def list_findings(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.expr(_RANK)
    f = table(spark, sf, "findings").join(ordinances(spark, sf).select("mst", "name"), "mst").where("contains(law_name, '법') OR contains(name, '법')")
    return f.orderBy(rank, "name", "ord_seq", "id").limit(300).select("id", "severity", "name")


@R.query(f"SELECT id, mst, law_name, clause_label FROM {_GRADED} WHERE grade = 'review'")
def grade_report(spark: SparkSession, sf: str) -> DataFrame:
    return graded(table(spark, sf, "findings")).where("grade = 'review'").select("id", "mst", "law_name", "clause_label")


@R.query(f"""SELECT mst, count(DISTINCT CASE WHEN kind = '법령' AND NOT rule THEN law_name END) AS laws, count(DISTINCT CASE WHEN kind = '법령' AND rule THEN law_name END) AS rules, count(DISTINCT CASE WHEN kind = '자치법규' THEN law_name END) AS locals
 FROM (SELECT mst, law_name, {_KIND} AS kind, coalesce(law_id LIKE 'ADM:%', false) AS rule FROM citations) GROUP BY mst""")
def cite_features(spark: SparkSession, sf: str) -> DataFrame:
    """How many laws, administrative rules and local rules an ordinance cites."""
    c = table(spark, sf, "citations").select("mst", "law_name", X.cited_kind(F.col("law_name"), PREFIXES).alias("kind"), F.coalesce(F.startswith("law_id", F.lit("ADM:")), F.lit(False)).alias("rule"))
    one = c.distinct()
    n = lambda cond, name: F.countDistinct(F.when(cond, F.col("law_name"))).alias(name)
    return one.groupBy("mst").agg(n((F.col("kind") == "법령") & ~F.col("rule"), "laws"), n((F.col("kind") == "법령") & F.col("rule"), "rules"), n(F.col("kind") == "자치법규", "locals"))


@R.query(f"""SELECT c.mst, c.name_key, c.law_id, c.labels, {", ".join(f'coalesce(f."{g}", 0) AS "{g}"' for g in X.GRADES)} FROM (
 SELECT mst, replace(law_name,' ','') AS name_key, arg_min(law_id, id) FILTER (law_id <> '') AS law_id, count(DISTINCT nullif(clause_label,'')) AS labels FROM citations WHERE law_name IS NOT NULL AND mst IS NOT NULL GROUP BY 1, 2) c
 LEFT JOIN (SELECT mst, replace(law_name,' ','') AS name_key, {_COUNTS} FROM {_GRADED} WHERE law_name IS NOT NULL GROUP BY 1, 2) f USING (mst, name_key)""")
def law_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Per ordinance and cited law: its first id, distinct labels and findings by grade."""
    key = X.name_key(F.col("law_name")).alias("name_key")
    c = table(spark, sf, "citations").where("law_name IS NOT NULL AND mst IS NOT NULL")
    labels = c.where("clause_label <> ''").select("mst", key, "clause_label").distinct().groupBy("mst", "name_key").agg(F.count(F.lit(1)).alias("labels"))
    first = F.min(F.when(F.col("law_id") != "", F.struct("id", "law_id")))
    cards = c.groupBy("mst", key).agg(first.alias("f")).join(labels, ["mst", "name_key"], "left")
    f = graded(table(spark, sf, "findings").where("law_name IS NOT NULL")).groupBy("mst", key).agg(*[F.count_if(F.col("grade") == g).alias(g) for g in X.GRADES])
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return cards.join(f, ["mst", "name_key"], "left").select("mst", "name_key", F.col("f.law_id").alias("law_id"), zero("labels"), *[zero(g) for g in X.GRADES])


@R.query("SELECT mst, string_agg(law_name, ',' ORDER BY law_name) AS laws FROM (SELECT DISTINCT mst, law_name FROM citations WHERE law_name <> '') GROUP BY mst")
def law_names_by_ord(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "citations").where("law_name <> ''").select("mst", "law_name").distinct()
    return c.groupBy("mst").agg(F.array_join(F.array_sort(F.collect_set("law_name")), ",").alias("laws"))


@R.query("""SELECT DISTINCT c.id FROM (SELECT id, mst, article_no, law_name, trim(unnest(string_split(coalesce(clause_label,''), ','))) AS label FROM citations) c
 JOIN (SELECT DISTINCT mst, coalesce(ord_clause,'') AS article, law_name, coalesce(clause_label,'') AS label FROM findings WHERE severity <> 'current') f ON f.mst = c.mst AND f.article = coalesce(c.article_no,'') AND f.law_name = c.law_name AND (f.label = c.label OR f.label = '')""")
def actionable_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations that a finding other than current points at, by any of their labels or by the law alone."""
    c = table(spark, sf, "citations").select("id", "mst", F.coalesce("article_no", F.lit("")).alias("article"), "law_name", F.explode(F.split(F.coalesce("clause_label", F.lit("")), ",")).alias("label"))
    c = c.withColumn("label", F.explode(F.array_distinct(F.array(F.trim("label"), F.lit("")))))
    f = table(spark, sf, "findings").where("severity <> 'current'").select("mst", F.coalesce("ord_clause", F.lit("")).alias("article"), "law_name", F.coalesce("clause_label", F.lit("")).alias("label"))
    return c.join(f, ["mst", "article", "law_name", "label"], "left_semi").select("id").distinct()


@R.query("""SELECT mst, string_agg(article, ',' ORDER BY jo, article) AS articles FROM (SELECT DISTINCT mst, article_no AS article, coalesce(try_cast(nullif(regexp_extract(article_no, '제(\\d+)조', 1), '') AS INT), 9999) AS jo FROM (SELECT mst, article_no FROM citations UNION ALL SELECT mst, ord_clause FROM findings) WHERE article_no <> '') GROUP BY mst""")
def citing_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of an ordinance that cite anything, of citations and findings together, by article number."""
    a = table(spark, sf, "citations").select("mst", "article_no").unionByName(table(spark, sf, "findings").select("mst", F.col("ord_clause").alias("article_no"))).where("article_no <> ''").distinct()
    keyed = F.struct(X.label_numbers(F.col("article_no"))["jo"].alias("jo"), F.col("article_no").alias("article"))
    return a.groupBy("mst").agg(F.array_join(F.transform(F.array_sort(F.collect_set(keyed)), lambda x: x["article"]), ",").alias("articles"))


@R.query("""WITH s AS (SELECT mst, id, ord_seq, coalesce(ord_clause,'') AS article, lag(coalesce(ord_clause,'')) OVER (PARTITION BY mst ORDER BY ord_seq NULLS FIRST, id) AS before FROM findings WHERE mst IS NOT NULL),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> article THEN 1 ELSE 0 END) OVER (PARTITION BY mst ORDER BY ord_seq NULLS FIRST, id) AS section FROM s)
 SELECT mst, section::BIGINT AS section, article, count(*) AS items FROM g GROUP BY ALL""")
def section_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive findings of one article as sections."""
    w = Window.partitionBy("mst").orderBy("ord_seq", "id")
    f = table(spark, sf, "findings").where("mst IS NOT NULL").select("mst", "id", "ord_seq", F.coalesce("ord_clause", F.lit("")).alias("article"))
    f = f.withColumn("before", F.lag("article").over(w))
    f = f.withColumn("section", F.sum(F.when(F.col("before").isNull() | (F.col("before") != F.col("article")), 1).otherwise(0)).over(w))
    return f.groupBy("mst", "section", "article").agg(F.count(F.lit(1)).alias("items"))


# ---- freshness, upserts, meta
_NOW = "2025-06-01 00:00:00"


@R.query(f"SELECT law_id, CASE WHEN fetched_at IS NOT NULL AND fetched_at >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY THEN 'reuse' ELSE 'fetch' END AS state FROM laws")
def freshness_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "laws").select("law_id", store.freshness(F.col("fetched_at"), _NOW, 30).alias("state"))


@R.query(f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN fetched_at IS NOT NULL AND fetched_at >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY THEN 'reuse' ELSE 'fetch' END AS state FROM laws) GROUP BY state")
def freshness_counts(spark: SparkSession, sf: str) -> DataFrame:
    return freshness_split(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@R.query(f"SELECT (SELECT count(*) FROM {_ORD}) AS ordinances_n, (SELECT count(*) FROM laws) AS laws_n, (SELECT count(*) FROM findings) AS findings_n")
def batch_meta(spark: SparkSession, sf: str) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k)) for k, df in (("ordinances_n", ordinances(spark, sf)), ("laws_n", table(spark, sf, "laws")), ("findings_n", table(spark, sf, "findings")))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return counts.agg(*[F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("ordinances_n", "laws_n", "findings_n")])


_BATCH = "(SELECT max(batch_date) FROM law_snapshots)"
_DELIVERED = f"(SELECT law_id, arg_max(name, fetched_at) AS name, max(fetched_at) AS fetched_at FROM law_snapshots WHERE batch_date = {_BATCH} GROUP BY law_id)"


def _delivered(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "law_snapshots")
    last = s.agg(F.max("batch_date").alias("batch_date"))
    return s.join(F.broadcast(last), "batch_date").groupBy("law_id").agg(F.max_by("name", "fetched_at").alias("name"), F.max("fetched_at").alias("fetched_at"))


@R.query(f"SELECT law_id, coalesce(d.name, l.name) AS name, l.version_key FROM laws l FULL JOIN {_DELIVERED} d USING (law_id)")
def ordinance_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last delivery laid over laws: new values win, columns it does not have stay."""
    return store.upsert(table(spark, sf, "laws").select("law_id", "name", "version_key"), _delivered(spark, sf).select("law_id", "name"), ["law_id"])


@R.query(f"SELECT law_id, name FROM {_DELIVERED} UNION ALL SELECT law_id, name FROM laws WHERE law_id NOT IN (SELECT law_id FROM {_DELIVERED})")
def replace_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return store.replace_rows(table(spark, sf, "laws").select("law_id", "name"), _delivered(spark, sf).select("law_id", "name"), ["law_id"])


@R.query(f"SELECT law_id, name FROM laws UNION ALL SELECT law_id, name FROM {_DELIVERED} WHERE law_id NOT IN (SELECT law_id FROM laws)")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    return store.insert_absent(table(spark, sf, "laws").select("law_id", "name"), _delivered(spark, sf).select("law_id", "name"), ["law_id"])


@R.query("SELECT law_id, version_mst, enforce_date FROM law_versions WHERE version_mst <> '' AND enforce_date <> ''")
def version_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "law_versions").where("version_mst <> '' AND enforce_date <> ''").select("law_id", "version_mst", "enforce_date")
