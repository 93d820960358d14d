"""Queries whose inputs are made of rows, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import narrow_unit
from lexmill.operators import articles as A
from lexmill.operators import citations as C
from lexmill.operators.asof import asof_join
from lexmill.operators.judge import check_clause, diff_clause, judge_rule
from lexmill.plans.registry import Registry
from lexmill.sources.tables import table

R = Registry()


def _parts(spark: SparkSession, sf: str, cases: int) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % cases).alias("k"), (2000 + F.col("p_size") % 20).alias("y"), F.col("p_size").alias("s"))


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _pick(k: int, value: Column) -> Column:
    return F.when(F.col("k") == k, value)


@R.query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat_ws(chr(10), '① 항' || p_size, '1. 호' || p_size, '가. 목' || p_size, '2. 둘' || p_size) WHEN 1 THEN '2. 둘' || p_size WHEN 2 THEN '1. 셋' || p_size WHEN 3 THEN '가. 목' || p_size END AS unit FROM part""")
def extract_subunit(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf, 5)
    line = lambda head: F.concat(F.lit(head), F.col("s"))
    content = F.concat_ws("\n", F.lit("제1조(목적) 머리"), line("① 항"), line("1. 호"), line("가. 목"), line("2. 둘"), line("② 넷"), line("1. 셋"))
    k = F.col("k")
    hang = F.when(k.isin(0, 1), 1).when(k == 2, 2).when(k == 4, 3)
    ho = F.when(k == 1, "2").when(k.isin(2, 3), "1")
    return p.select("id", narrow_unit(content, hang, ho, F.when(k == 3, "가")).alias("unit"))


_TAGGED = "CASE WHEN 2000 + p_size % 20 > 2010 THEN {a} ELSE {b} END"


@R.query(f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'mechanical' WHEN 1 THEN 'check' WHEN 2 THEN {_TAGGED.format(a="'review'", b="'current'")} WHEN 3 THEN {_TAGGED.format(a="'check'", b="'current'")}
 WHEN 4 THEN 'check' ELSE {_TAGGED.format(a="'check'", b="'current'")} END AS severity, CASE WHEN p_partkey % 6 = 5 THEN {_TAGGED.format(a="'호미확인'", b="''")} ELSE '' END AS change_type FROM part""")
def check_clause_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Moved, missing, tagged, dated, without a day of its own, and a unit without the article's tag."""
    p = _parts(spark, sf, 6)
    tag = F.concat(F.lit("본문 <개정 "), F.col("y"), F.lit(".1.1>"))
    content = F.when(F.col("k").isin(2, 4), tag).when(F.col("k") == 5, F.concat(tag, F.lit("\n1. 하나"))).otherwise(F.lit("본문"))
    day = F.when(F.col("k") == 3, F.concat(F.col("y"), F.lit("0101"))).otherwise("")
    article = F.when(F.col("k") >= 2, F.struct(content.alias("content"), day.alias("enforce_date")))
    own = F.when(F.col("k") == 4, "미상").otherwise("20100101")
    v = check_clause(article, _pick(0, F.lit("제9조")), own, _none("int"), _pick(5, F.lit("1")), _none())
    return p.select("id", v.alias("v")).select("id", "v.severity", "v.change_type")


@R.query(f"""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 2 THEN 'check' WHEN 3 THEN {_TAGGED.format(a="'review'", b="'current'")} WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'current' ELSE 'review' END WHEN 5 THEN 'current' WHEN 6 THEN CASE WHEN p_size % 2 = 0 THEN 'current' ELSE 'review' END ELSE 'review' END AS severity,
 CASE p_partkey % 7 WHEN 0 THEN '번호이동' WHEN 1 THEN '삭제' WHEN 2 THEN '미확인' WHEN 3 THEN {_TAGGED.format(a="'내용변경'", b="'동일'")} WHEN 5 THEN '동일' ELSE CASE WHEN p_size % 2 = 0 THEN '동일' ELSE '내용변경' END END AS change_type FROM part""")
def diff_clause_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Moved, deleted, found nowhere, tagged, text against text, new since, and one unit against itself."""
    p = _parts(spark, sf, 7)
    k, odd = F.col("k"), F.when(F.col("s") % 2 == 0, "가 나").otherwise("다")
    now = F.when(k == 3, F.concat(F.lit("본문 <개정 "), F.col("y"), F.lit(".1.1>"))).when(k == 4, odd).when(k == 5, "본문").when(k == 6, F.concat(F.lit("머리 <개정 2020.1.1>\n1. "), odd))
    then = F.when(k.isin(0, 1), "옛글").when(k == 4, "가나").when(k == 6, "머리\n1. 가나")
    v = diff_clause(now, then, _pick(0, F.lit("제9조")), F.lit("20100101"), _none("int"), _pick(6, F.lit("1")), _none())
    return p.select("id", v.alias("v")).select("id", "v.severity", "v.change_type")


@R.query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 AND 2000 + p_size % 20 > 2010 THEN 'review' ELSE 'current' END AS severity FROM part""")
def admrul_judge(spark: SparkSession, sf: str) -> DataFrame:
    """An administrative rule: a later comparison that changes the clause asks for review, else the clause is checked as it is."""
    p = _parts(spark, sf, 2)
    article = F.struct(F.lit("본문").alias("content"), F.lit("").alias("enforce_date"))
    plain = check_clause(article, _none(), F.lit("20100101"), _none("int"), _none(), _none())
    v = judge_rule(F.lit("가"), F.when(F.col("s") % 2 == 1, "나").otherwise("(현행과 같음) 가"), F.concat(F.col("y"), F.lit("0101")), F.lit("20100101"), plain)
    return p.select("id", v["severity"].alias("severity"))


@R.query("""SELECT id, label, content FROM (SELECT p_partkey AS id, unnest(['제1조', '제2조의2']) AS label, unnest(['제1조(가) 하나' || p_size || chr(10) || '더', '제2조의2 둘' || p_size]) AS content FROM part)""")
def admrul_flat_articles(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("<a><조문내용>앞글\n제1조(가) 하나"), F.col("s"), F.lit("\n더\n제2조의2 둘"), F.col("s"), F.lit("</조문내용></a>"))
    rules = _parts(spark, sf, 1).select("id", text.alias("body_xml"))
    return A.parsed_articles(rules, "id", rows=A.rule_rows).select("id", "label", "content")


@R.query("""SELECT p_partkey AS id, unnest(['제1조', '제' || p_size || '조']) AS clause, '건축' || p_size || '법' AS law_name, unnest(['inline', 'alias_spacing']) AS alias_source FROM part WHERE p_size > 1
 UNION ALL SELECT p_partkey, '제' || p_size || '조제2항', '주민등록법', 'naked' FROM part WHERE p_size > 1""")
def alias_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """A short name glued to the word before it, and a bare name; words that only look like a law are none."""
    text = F.concat(F.lit("「건축"), F.col("s"), F.lit('법」(이하 "법"이라 한다) 제1조의 경우에는법 제'), F.col("s"), F.lit("조, 상위법 제3조와 주민등록법 제"), F.col("s"), F.lit("조제2항"))
    texts = _parts(spark, sf, 1).where("s > 1").select("id", text.alias("text"))
    return C.extract_from_text(texts, "id", "text").where("alias_source <> 'alias'").select("id", "clause", "law_name", "alias_source")


@R.query("""SELECT e.l_orderkey, e.l_partkey, max(v.day) AS version FROM (SELECT DISTINCT l_orderkey, l_partkey, strftime(o_orderdate, '%Y%m%d') AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey) e
 JOIN (SELECT DISTINCT l_partkey, strftime(l_shipdate, '%Y%m%d') AS day FROM lineitem) v ON v.l_partkey = e.l_partkey AND v.day <= e.day GROUP BY 1, 2""")
def asof_version(spark: SparkSession, sf: str) -> DataFrame:
    """For each order and part the last shipping day of the part not after the order."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    events = items.join(orders, items.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_partkey", day("o_orderdate").alias("day")).distinct()
    changes = items.select("l_partkey", day("l_shipdate").alias("start")).distinct().withColumn("version", F.col("start"))
    return asof_join(events, changes, "l_partkey", "day", "start", "version").select("l_orderkey", "l_partkey", "version")
