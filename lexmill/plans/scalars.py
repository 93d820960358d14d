"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.clauses import clause_tokens, expand_range
from lexmill.plans.registry import Registry
from lexmill.sources.tables import table

R = Registry()
PREFIXES = ("윤슬시", "도담군", "보람구")


@R.query(r"""SELECT mst, CASE WHEN trim(regexp_split_to_array(d, '\s*[,，、/;]\s*')[1]) <> '' THEN trim(regexp_split_to_array(d, '\s*[,，、/;]\s*')[1]) ELSE d END AS department
 FROM (SELECT mst, trim(coalesce(dept, '')) AS d FROM ordinances)""")
def primary_dept(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ordinances").select("mst", X.primary_department(F.col("dept")).alias("department"))


@R.query("SELECT DISTINCT law_name, replace(law_name, ' ', '') AS name_key, regexp_replace(law_name, '[ \\t\\n\\r\\f\\x0b·ㆍ・]', '', 'g') AS loose_key FROM citations WHERE law_name IS NOT NULL")
def name_key(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "citations").select("law_name").where("law_name IS NOT NULL").distinct()
    return names.select("law_name", X.name_key(F.col("law_name")).alias("name_key"), X.loose_name_key(F.col("law_name")).alias("loose_key"))


@R.query(r"""SELECT id, CASE WHEN length(d) = 8 THEN substr(d,1,4)||'-'||substr(d,5,2)||'-'||substr(d,7,2) WHEN r <> '' THEN r ELSE '—' END AS shown
 FROM (SELECT id, trim(coalesce(ord_enforce,'')) AS r, substr(regexp_replace(trim(coalesce(ord_enforce,'')), '[^0-9]', '', 'g'), 1, 8) AS d FROM findings)""")
def fmtdate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").select("id", X.format_day(F.col("ord_enforce")).alias("shown"))


@R.query("""SELECT id, replace(replace(replace(replace(replace(evidence, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM findings""")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").select("id", X.escape_html(F.col("evidence")).alias("html"))


@R.query("""SELECT id, CASE WHEN unicode(right(clause_label,1)) BETWEEN 44032 AND 55203 AND (unicode(right(clause_label,1)) - 44032) % 28 <> 0 THEN '은' ELSE '는' END AS particle FROM findings WHERE clause_label <> ''""")
def josa(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").where("clause_label <> ''").select("id", X.particle(F.col("clause_label"), "은", "는").alias("particle"))


@R.query(r"""WITH e AS (SELECT id, '[당시] ' || coalesce(detail, '') || chr(10) || '[현행] ' || coalesce(evidence, '') AS x FROM findings), p AS (
 SELECT id, trim(regexp_extract(x, '(?s)^\[당시\]\s*(.*?)\n\[현행\]\s*(.*)', 1)) AS was, trim(regexp_extract(x, '(?s)^\[당시\]\s*(.*?)\n\[현행\]\s*(.*)', 2)) AS now FROM e)
 SELECT id, was, now, regexp_replace(was, '\s+', '', 'g') = regexp_replace(now, '\s+', '', 'g') AS equal FROM p""")
def split_evidence(spark: SparkSession, sf: str) -> DataFrame:
    both = F.concat(F.lit("[당시] "), F.coalesce("detail", F.lit("")), F.lit("\n[현행] "), F.coalesce("evidence", F.lit("")))
    f = table(spark, sf, "findings").select("id", X.split_evidence(both).alias("e"))
    return f.select("id", "e.was", "e.now", (X.without_blanks(F.col("e.was")) == X.without_blanks(F.col("e.now"))).alias("equal"))


@R.query("""SELECT DISTINCT code, CASE WHEN substr(code,1,4)::INT = 0 THEN '' WHEN substr(code,5,2)::INT = 0 THEN '제'||substr(code,1,4)::INT||'조' ELSE '제'||substr(code,1,4)::INT||'조의'||substr(code,5,2)::INT END AS label
 FROM (SELECT lpad((l_linenumber - 1)::VARCHAR, 4, '0') || lpad((l_suppkey % 4)::VARCHAR, 2, '0') AS code FROM lineitem)""")
def decode_article_code(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.lpad((F.col("l_linenumber") - 1).cast("string"), 4, "0"), F.lpad((F.col("l_suppkey") % 4).cast("string"), 2, "0"))
    return table(spark, sf, "lineitem").select(code.alias("code")).distinct().select("code", X.article_code(F.col("code")).alias("label"))


@R.query(r"""SELECT id, jo, ga, CASE WHEN ga = 0 THEN '제'||jo||'조' ELSE '제'||jo||'조의'||ga END AS label FROM (
 SELECT id, coalesce(try_cast(nullif(regexp_extract(clause_label, '제(\d+)조', 1), '') AS INT), 9999) AS jo, coalesce(try_cast(nullif(regexp_extract(clause_label, '의(\d+)', 1), '') AS INT), 0) AS ga
 FROM citations WHERE clause_label <> '')""")
def label_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "citations").where("clause_label <> ''").select("id", X.label_numbers(F.col("clause_label")).alias("n"))
    return c.select("id", "n.jo", "n.ga", X.make_label(F.col("n.jo"), F.col("n.ga")).alias("label"))


@R.query("""SELECT id, CASE WHEN trim(split_part(coalesce(ord_clause,''), ',', 1)) <> '' THEN trim(split_part(coalesce(ord_clause,''), ',', 1)) ELSE '(위치 미상)' END AS article FROM findings""")
def primary_article(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").select("id", X.primary_article(F.col("ord_clause")).alias("article"))


_KIND = """CASE WHEN law_name IS NULL OR law_name IN ('', '법령', '다른 법령', '법령이나 조례', '법령이나 다른 조례', '법령 등') THEN '기타'
 WHEN ends_with(law_name, '조례') THEN '자치법규' WHEN ends_with(law_name, '규칙') AND NOT contains(law_name, '시행규칙') THEN '자치법규'
 WHEN regexp_matches(law_name, '^(윤슬시|도담군|보람구)') AND NOT regexp_matches(law_name, '(훈령|예규|고시|지침|요령|규정|기준)$') THEN '자치법규' ELSE '법령' END"""


@R.query(f"""SELECT DISTINCT law_name, {_KIND} AS kind, coalesce(regexp_matches(law_name, '^(윤슬시|도담군|보람구)') AND regexp_matches(law_name, '(훈령|예규|고시|지침|요령|규정|기준)$'), false) AS local_rule FROM citations""")
def classify_name(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "citations").select("law_name").distinct()
    return names.select("law_name", X.cited_kind(F.col("law_name"), PREFIXES).alias("kind"), F.coalesce(X.is_local_rule(F.col("law_name"), PREFIXES), F.lit(False)).alias("local_rule"))


@R.query(r"""SELECT id, strftime(try_strptime(CASE WHEN length(d) = 8 THEN d END, '%Y%m%d'), '%Y-%m-%d') AS day FROM (SELECT id, substr(regexp_replace(coalesce(ord_enforce,''), '[^0-9]', '', 'g'), 1, 8) AS d FROM findings)""")
def date_digits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").select("id", X.day_of(F.col("ord_enforce")).cast("string").alias("day"))


_TEXT = "replace(replace(coalesce(body_xml,''), '&lt;', '<'), '&gt;', '>')"
_DAYS = r"""list_sort(list_distinct(flatten(list_transform(regexp_extract_all(TEXT, '<(?:개정|신설|전문개정)([^>]*)>', 1),
 lambda t: list_transform(regexp_extract_all(t, '\d{4}\.\s*\d{1,2}\.\s*\d{1,2}'), lambda d: regexp_extract(d, '^(\d{4})', 1) || lpad(regexp_extract(d, '\.\s*(\d{1,2})\.', 1), 2, '0') || lpad(regexp_extract(d, '(\d{1,2})$', 1), 2, '0'))))))""".replace("TEXT", _TEXT)


def _law_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Law bodies with the marks of amendment tags unescaped."""
    raw = F.coalesce(F.col("body_xml"), F.lit(""))
    return table(spark, sf, "laws").select("law_id", "version_key", F.replace(F.replace(raw, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")).alias("text"))


@R.query(f"SELECT law_id, array_to_string({_DAYS}, ',') AS days FROM laws")
def amend_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _law_texts(spark, sf).select("law_id", F.array_join(X.amend_days(F.col("text")), ",").alias("days"))


@R.query(f"""SELECT law_id, coalesce(list_filter(days, lambda d: own <> '' AND d <= own)[-1], '원제정') AS was, days[-1] AS now, own <> '' AND days[-1] > own AS amended_after FROM (
 SELECT law_id, {_DAYS} AS days, substr(regexp_replace(coalesce(version_key,''), '[^0-9]', '', 'g'), 1, 8) AS own FROM laws) WHERE len(days) > 0""")
def basis_dates(spark: SparkSession, sf: str) -> DataFrame:
    f = _law_texts(spark, sf).select("law_id", X.basis_days(F.col("text"), F.col("version_key")).alias("b")).where("b IS NOT NULL")
    return f.select("law_id", "b.was", "b.now", "b.amended_after")


@R.query(r"""SELECT id, concat(CASE WHEN h <> '' THEN '제'||h||'항' ELSE '' END, CASE WHEN o <> '' THEN '제'||o||'호' ELSE '' END, CASE WHEN m <> '' THEN m||'목' ELSE '' END) AS label FROM (
 SELECT id, regexp_extract(clause_detail, '제(\d+)항', 1) AS h, regexp_extract(clause_detail, '제(\d+(?:의\d+)?)호', 1) AS o, regexp_extract(clause_detail, '([가-힣])목', 1) AS m FROM findings WHERE clause_detail <> '')""")
def subspec_label(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("clause_detail", p, 1)
    return table(spark, sf, "findings").where("clause_detail <> ''").select("id", X.unit_label(part(r"제(\d+)항"), part(r"제(\d+(?:의\d+)?)호"), part("([가-힣])목")).alias("label"))


@R.query("SELECT id, translate(nfc_normalize(coalesce(law_name, '')), '・　', '· ') AS plain FROM citations")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "citations").select("id", X.normalize_text(F.col("law_name")).alias("plain"))


_GRADE = """CASE WHEN severity = 'current' AND (coalesce(cite_naked,0) <> 0 OR coalesce(cite_spacing,0) <> 0) THEN 'format' WHEN severity = 'current' THEN 'current'
 WHEN severity = 'mechanical' OR coalesce(change_type,'') = '번호이동' THEN 'mechanical' WHEN severity = 'review' THEN 'review' ELSE 'check' END"""


def graded(f: DataFrame) -> DataFrame:
    return f.withColumn("grade", X.finding_grade(F.col("severity"), F.col("change_type"), F.col("cite_naked"), F.col("cite_spacing")))


@R.query(f"SELECT id, {_GRADE} AS grade FROM findings")
def finding_grade(spark: SparkSession, sf: str) -> DataFrame:
    return graded(table(spark, sf, "findings")).select("id", "grade")


@R.query("SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT coalesce(nullif(change_type, ''), '(미분류)') AS change, count(*) AS n FROM findings GROUP BY 1")
def change_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.coalesce(F.nullif(F.col("change_type"), F.lit("")), F.lit("(미분류)"))
    return table(spark, sf, "findings").groupBy(blank.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""SELECT a, b, '제' || unnest(CASE WHEN a = b THEN [a] WHEN b < a THEN [a, b] ELSE range(a, b + 1) END) || '조' AS label
 FROM (SELECT DISTINCT l_linenumber::BIGINT AS a, (l_linenumber + l_quantity::INT % 7 - 1)::BIGINT AS b FROM lineitem)""")
def clause_range_expand(spark: SparkSession, sf: str) -> DataFrame:
    ends = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 7 - 1).alias("b")).distinct()
    return ends.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.explode(expand_range(F.col("a"), F.col("b"))).alias("label"))


@R.query("""WITH t AS (SELECT DISTINCT l_linenumber AS jo, (l_suppkey % 3)::INT AS ga, (1 + l_partkey % 9)::INT AS h, (1 + l_quantity::INT % 5) AS o FROM lineitem)
 SELECT '제'||jo||'조'||CASE WHEN ga > 0 THEN '의'||ga ELSE '' END||'제'||h||'항제'||o||'호 및 제'||(o+1)||'호' AS clause, '제'||jo||'조'||CASE WHEN ga > 0 THEN '의'||ga ELSE '' END AS label, h AS hang, unnest([o::VARCHAR, (o+1)::VARCHAR]) AS ho FROM t""")
def clause_token_items(spark: SparkSession, sf: str) -> DataFrame:
    """Clause texts made of rows, and the tokens read back from them."""
    t = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("jo"), (F.col("l_suppkey") % 3).alias("ga"), (1 + F.col("l_partkey") % 9).alias("h"), (1 + F.col("l_quantity").cast("int") % 5).alias("o")).distinct()
    clause = F.concat(X.make_label(F.col("jo"), F.col("ga")), F.lit("제"), F.col("h"), F.lit("항제"), F.col("o"), F.lit("호 및 제"), F.col("o") + 1, F.lit("호"))
    return t.select(clause.alias("clause")).select("clause", F.explode(clause_tokens("clause")).alias("t")).select("clause", "t.label", "t.hang", "t.ho")
