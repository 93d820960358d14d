"""The whole pipeline over a source made of rows, one kind of finding per row, with SQL that says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import articles as A
from lexmill.operators import citations as C
from lexmill.operators import diff as D
from lexmill.plans import pipeline as P
from lexmill.plans import views as V
from lexmill.plans.registry import Registry
from lexmill.plans.scalars import PREFIXES
from lexmill.sources.source import FrameSource
from lexmill.sources.tables import table

R = Registry()
CASES = 16
OLD = "19990101"


def _law(name: str, *articles: tuple[int, str, str, str]) -> str:
    units = "".join(f"<조문단위><조문여부>조문</조문여부><조문번호>{n}</조문번호><조문시행일자>{day}</조문시행일자><조문이동이전>{came}</조문이동이전><조문내용>{text}</조문내용></조문단위>" for n, text, came, day in articles)
    return f"<법령><기본정보><법령명_한글>{name}</법령명_한글></기본정보><조문>{units}</조문></법령>"


def _one(n: int, text: str, came: str = "", day: str = "") -> tuple[int, str, str, str]:
    return n, text.replace("<", "&lt;").replace(">", "&gt;"), came, day


def _texts() -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """(law_id, cited name, body now) and (law_id, body then) of the cases that need them."""
    tagged = "본문 <개정 2010. 1. 1.>"
    now = {
        0: _one(1, "새 글"), 1: _one(1, "같은 글"), 2: _one(5, "다섯", "000200", "20210101"), 3: _one(4, "하나둘"), 4: _one(9, "다른 글"), 5: _one(9, "다른 글"), 6: _one(1, "글"),
        12: _one(1, "글"), 13: _one(1, "본문 <개정 2005.1.1> <개정 2010.1.1>"), 14: _one(1, "머리\n① 가\n② 다"), 15: _one(1, "글"),
    }
    then = {0: _one(1, "옛 글"), 1: _one(1, "같 은 글"), 3: _one(1, "하나 둘"), 4: _one(1, "사라짐"), 5: _one(8, "여덟"), 13: _one(1, "본문"), 14: _one(1, "머리\n① 가\n② 나")}
    name = lambda k: "사례십오법" if k == 15 else f"사례{k}법"
    laws = [(f"L{k}", name(k), _law("새" * (k == 6) + name(k), a)) for k, a in now.items()]
    laws += [("ADM:9", "사례9 지침", _law("사례9 지침", _one(1, "을"))), ("ADM:10", "사례10 고시", _law("사례10 고시", _one(1, tagged)))]
    pair = "<R><신구법존재여부>Y</신구법존재여부><신조문_기본정보><시행일자>20100101</시행일자></신조문_기본정보><구조문목록><조문>제1조(목적) 갑</조문></구조문목록><신조문목록><조문>제1조(목적) 을</조문></신조문목록></R>"
    return [*laws, ("ADMONV:9", "", pair)], [(f"L{k}", _law(name(k), a)) for k, a in then.items()]


# What is cited in the ordinance of each case.
CITED = {
    0: "「사례0법」 제1조에 따라", 1: "「사례1법」 제1조", 2: "「사례2법」 제2조", 3: "「사례3법」 제1조", 4: "「사례4법」 제1조", 5: "「사례5법」 제1조", 6: "「사례6법」 제1조와 같은 법 제3조", 7: "「없는사례7법」 제1조",
    8: "「윤슬시 사례8 규정」 제1조", 9: "「사례9 지침」 제1조", 10: "「사례10 고시」 제1조", 11: "모르는법 제1조", 12: "「사례12법」에 따라", 13: "「사례13법」 제1조", 14: "「사례14법」 제1조제2항", 15: "사례십오법 제1조",
}


def rows_source(spark: SparkSession, sf: str) -> FrameSource:
    """An ordinance per part, citing the law of its case."""
    laws, then = _texts()
    k = F.col("p_partkey") % CASES
    said = F.element_at(F.array(*[F.lit(CITED[i]) for i in range(CASES)]), (k + 1).cast("int"))
    body = F.concat(F.lit("<법령><조문><조><조문번호>000100</조문번호><조문여부>Y</조문여부><조내용>"), said, F.lit("</조내용></조></조문></법령>"))
    ordinances = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("mst"), body.alias("body_xml"), F.concat((2000 + F.col("p_size") % 20).cast("string"), F.lit("0101")).alias("enforce_date"), F.lit(0).alias("fetched_at"))
    law_frame = spark.createDataFrame(laws, "law_id string, name string, body_xml string")
    versions = spark.createDataFrame([(i, "v1", OLD, x, 0) for i, x in then], "law_id string, version_mst string, enforce_date string, body_xml string, fetched_at int")
    names = spark.createDataFrame([(n, i, 0, i) for i, n, _ in laws if n], "name string, law_id string, prio int, place string")
    return FrameSource(ordinances, law_frame, versions, names)


_EARLY = "own < '20100101'"
_PIPELINE = f"""WITH p AS (SELECT p_partkey::VARCHAR AS mst, p_partkey % {CASES} AS k, (2000 + p_size % 20) || '0101' AS own FROM part),
 x AS (SELECT *, {_EARLY} AS early, CASE WHEN own >= '20100101' THEN '20100101' WHEN own >= '20050101' THEN '20050101' ELSE '원제정' END AS basis, date_diff('day', strptime(own, '%Y%m%d'), DATE '2010-01-01') AS apart FROM p)
 SELECT mst, CASE WHEN k IN (7, 8) THEN '' WHEN k IN (9, 10) THEN 'ADM:' || k ELSE 'L' || k END AS law_id, '제1조' AS article_no, CASE WHEN k IN (6, 7, 8) THEN '' WHEN k = 2 THEN '제2조' ELSE '제1조' END AS label,
 CASE WHEN k IN (2, 3, 4, 5, 6, 7, 8) THEN 'status' WHEN k IN (1, 15) OR (k IN (9, 10, 13) AND NOT early) THEN 'current' ELSE 'timing' END AS category,
 CASE WHEN k = 2 THEN 'mechanical' WHEN k IN (5, 7, 8) THEN 'check' WHEN k IN (1, 15) OR (k IN (9, 10, 13) AND NOT early) THEN 'current' ELSE 'review' END AS severity,
 CASE k WHEN 0 THEN '내용변경' WHEN 1 THEN '동일' WHEN 3 THEN '번호이동' WHEN 4 THEN '삭제' WHEN 5 THEN '미확인' WHEN 6 THEN '제명변경' WHEN 7 THEN '법령미해결' WHEN 8 THEN '지자체행정규칙' WHEN 9 THEN CASE WHEN early THEN '내용변경' ELSE '' END WHEN 13 THEN CASE WHEN early THEN '내용변경' ELSE '동일' END WHEN 14 THEN '내용변경' ELSE '' END AS change_type,
 CASE k WHEN 0 THEN '제1조 내용이 조례 제정 당시와 달라짐(개정이력 표기 없음) — 검토 필요' WHEN 1 THEN '당시 조문과 현행 내용 동일 — 검토 불필요' WHEN 2 THEN '제2조 → 제5조 로 이동(번호 변경). 인용 조문번호 수정 필요' WHEN 3 THEN '제1조 내용이 현행 제4조 로 이동(번호 변경) — 검토 필요'
  WHEN 4 THEN '제1조가 현행 법령에서 사라짐(삭제/통합 의심) — 검토 필요' WHEN 5 THEN '제1조 를 당시·현행 어디서도 못 찾음 — 확인 필요'
  WHEN 6 THEN '인용한 「사례6법」이 현행 「새사례6법」으로 제명변경(개칭·통폐합)됨 — 법령 자체가 바뀌었으니 인용 법령명을 현행화하고 관련 조문을 전면 검토. (조문번호·내용이 재편됐을 수 있어 개별 조문 비교는 생략) [개칭 아니면 인용 오기 확인]'
  WHEN 7 THEN '법령ID 미해결 (폐지/제명변경 의심)' WHEN 8 THEN '지자체 자체 행정규칙 — 국가법령정보 API 미수록(자동 대조 불가), 원문 수기 확인 필요'
  WHEN 9 THEN CASE WHEN early THEN '[행정규칙] 인용 조항이 조례 시행(' || own || ') 이후 개정됨 (개정 시행 2010-01-01) — 신구조문 대비상 내용 변경, 검토 필요' ELSE '[행정규칙] 개정이력 없음·조문시행일 조례 이전 — 현행 정합' END
  WHEN 10 THEN CASE WHEN early THEN '[행정규칙] 인용 조항이 조례 시행(' || own || ') 이후 개정됨 (개정 원제정→20100101, ' || apart || '일 차) — 내용 변경, 검토 필요' ELSE '[행정규칙] 인용 조항 최종 개정일(20100101)이 조례 시행 이전 — 현행 정합' END
  WHEN 13 THEN CASE WHEN early THEN '제1조가 조례 시행(' || own || ') 이후 개정됨 (개정 ' || basis || '→20100101) — 검토 필요' ELSE '제1조는 조례 시행 이후 개정 이력 없음(최종 개정 20100101) — 현행 정합' END
  WHEN 14 THEN '제1조제2항이 조례 시행(' || own || ') 이후 개정됨 — 검토 필요' ELSE '개정이력 없음·조문시행일 조례 이전 — 현행 정합' END AS detail,
 CASE k WHEN 0 THEN '[당시] 옛 글' || chr(10) || '[현행] 새 글' WHEN 2 THEN '다섯' WHEN 3 THEN '하나 둘' WHEN 4 THEN '사라짐' WHEN 9 THEN CASE WHEN early THEN '제1조(목적) 갑' ELSE '을' END WHEN 10 THEN '본문 <개정 2010. 1. 1.>'
  WHEN 13 THEN CASE WHEN early THEN '[당시] 본문' || chr(10) || '[현행] 본문 <개정 2005.1.1> <개정 2010.1.1>' ELSE '' END WHEN 14 THEN '[당시] ② 나' || chr(10) || '[현행] ② 다' WHEN 15 THEN '글' ELSE '' END AS evidence,
 CASE WHEN k = 2 THEN '20210101' WHEN k IN (10, 13) OR (k = 9 AND early) THEN '20100101' ELSE '' END AS clause_enforce,
 CASE WHEN k IN (0, 1, 3, 4, 5, 14) THEN '{OLD}' WHEN k = 13 THEN basis WHEN k = 10 THEN CASE WHEN early THEN '원제정' ELSE '20100101' END ELSE '' END AS old_enforce,
 CASE WHEN k = 14 THEN '제2항' ELSE '' END AS clause_detail, k = 15 AS naked FROM x WHERE k NOT IN (11, 12)"""


@R.query(_PIPELINE)
def pipeline_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Changed, same, moved, renumbered, deleted, lost, renamed, unresolved, local rules, administrative rules, bare and unbracketed citations."""
    found = P.findings_of(rows_source(spark, sf), PREFIXES)
    return found.select("mst", "law_id", "article_no", "label", "category", "severity", "change_type", "detail", "evidence", "clause_enforce", "old_enforce", "clause_detail", "naked")


# ---- citations, tokens and articles made of rows
_ROWS = "(SELECT DISTINCT l_orderkey * 100000 + l_linenumber * 10000 + (1 + l_partkey % 9) * 1000 + (1 + l_suppkey % 5) * 10 + (l_quantity::INT % 4) AS doc, l_linenumber AS n, 1 + l_partkey % 9 AS h, 1 + l_suppkey % 5 AS g, (l_quantity::INT % 4) AS o FROM lineitem)"
_TOKENS = f"""(SELECT doc, unnest([1, 2, 3, 4, 4]) AS seq, unnest(['법' || h || '률', '법' || h || '률' || CASE WHEN o % 2 = 0 THEN ' 시행령' ELSE '' END, '도로' || '법', '법' || h || '률', '법' || h || '률']) AS law_name,
 unnest(['제' || n || '조', '제' || g || '조', '제' || h || '조', '제' || (n + 1) || '조', '제' || (n + 2) || '조']) AS label, unnest([g, 0, 0, 0, 0]) AS hang, unnest(['inline', 'carry_over', 'naked', 'alias', 'alias']) AS way FROM {_ROWS})"""


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """Citations read from texts made of rows, with every way of citing."""
    c = F.col
    r = table(spark, sf, "lineitem").select("l_orderkey", c("l_linenumber").alias("n"), (1 + c("l_partkey") % 9).alias("h"), (1 + c("l_suppkey") % 5).alias("g"), (c("l_quantity").cast("int") % 4).alias("o")).distinct()
    text = F.concat(
        F.lit("「법"), c("h"), F.lit('률」(이하 "약칭"이라 한다) 제'), c("n"), F.lit("조제"), c("g"), F.lit("항에 따라 같은 "), F.when(c("o") % 2 == 0, "법 시행령").otherwise("법"), F.lit(" 제"), c("g"),
        F.lit("조와 도로법 제"), c("h"), F.lit("조를 보고 약칭 제"), c("n") + 1, F.lit("조부터 제"), c("n") + 2, F.lit("조까지 본다."),
    )
    docs = r.select((c("l_orderkey") * 100000 + c("n") * 10000 + c("h") * 1000 + c("g") * 10 + c("o")).alias("doc"), text.alias("text"))
    return C.extract_from_text(docs, "doc", "text")


@R.query(f"""SELECT doc, law_name, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT way, ',' ORDER BY way) AS ways, min(seq)::INT AS first_seq, bool_and(way = 'naked') AS naked_only FROM {_TOKENS} GROUP BY doc, law_name""")
def group_by_law_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    g = C.group_by_law(_references(spark, sf), key="doc")
    return g.select("doc", "law_name", F.array_join("labels", ",").alias("labels"), F.array_join("ways", ",").alias("ways"), "first_seq", "naked_only")


@R.query(f"SELECT doc, law_name, label, nullif(hang, 0)::INT AS hang, min(seq)::INT AS ord_seq FROM {_TOKENS} GROUP BY doc, law_name, label, hang")
def dedup_occurrences_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return C.occurrences(_references(spark, sf), key="doc").select("doc", "law_name", "label", "hang", "ord_seq")


@R.query(f"SELECT doc, law_name, label, CASE WHEN count(DISTINCT hang) = 1 AND min(hang) > 0 THEN min(hang) END::INT AS hang FROM {_TOKENS} GROUP BY doc, law_name, label")
def resolve_specs_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return C.narrow_specs(C.occurrences(_references(spark, sf), key="doc"), key="doc").select("doc", "law_name", "label", "hang")


@R.query("""SELECT o_orderkey::VARCHAR AS rec_id, '조례' || o_orderkey AS name, strftime(o_orderdate, '%Y%m%d') AS enforce_date, o_orderpriority AS dept, '본문' || o_custkey || chr(10) || '고친 글' || chr(10) || '까닭 ' || (o_custkey % 7) AS full_text, '제' || (1 + o_custkey % 30) || '조' || CASE WHEN o_custkey % 3 > 0 THEN '의' || (o_custkey % 3) ELSE '' END AS label, o_custkey % 2 = 0 AS is_article FROM orders""")
def ordinance_parse_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of ordinances made of orders: head, full text and articles read back."""
    o, c = table(spark, sf, "orders"), F.col
    code = F.concat(F.lpad((1 + c("o_custkey") % 30).cast("string"), 4, "0"), F.lpad((c("o_custkey") % 3).cast("string"), 2, "0"))
    leaf = lambda tag, v: F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>"))
    head = leaf("자치법규기본정보", F.concat(leaf("자치법규명", F.concat(F.lit("조례"), c("o_orderkey"))), leaf("시행일자", F.date_format("o_orderdate", "yyyyMMdd")), leaf("담당부서명", F.concat(c("o_orderpriority"), F.lit(" , 다른 과")))))
    unit = leaf("조문", leaf("조", F.concat(leaf("조문번호", code), leaf("조문여부", F.when(c("o_custkey") % 2 == 0, "Y").otherwise("N")), leaf("조내용", F.concat(F.lit(" 본문"), c("o_custkey"), F.lit(" "))))))
    tail = F.concat(leaf("개정문내용", F.lit(" 고친 글 ")), leaf("제개정이유내용", F.concat(F.lit("<p>까닭 "), c("o_custkey") % 7, F.lit("</p>"))))
    docs = o.select(c("o_orderkey").cast("string").alias("mst"), leaf("법령", F.concat(head, unit, tail)).alias("body_xml"))
    articles = A.parsed_articles(docs, "mst", rows=A.ordinance_rows).select(F.col("mst").alias("rec_id"), "label", "is_article")
    return A.ordinance_meta(docs).select("rec_id", "name", "enforce_date", "dept", "full_text").join(articles, "rec_id")


_MOVES = "(SELECT p_partkey AS k, p_size AS s FROM part)"


@R.query(f"SELECT k::VARCHAR AS law_id, '제' || (s + 100) || '조' AS label, CASE WHEN k % 3 = 0 THEN '제' || s || '조' END AS moved_to, CASE WHEN k % 3 = 1 THEN '제' || s || '조' END AS same_text, CASE WHEN k % 3 = 0 THEN '20200101' END AS enforce_date FROM {_MOVES}")
def moved_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that are gone, found again by what the new article says of itself, or by its text."""
    c = F.col
    p = table(spark, sf, "part").select(c("p_partkey").cast("string").alias("law_id"), c("p_partkey").alias("k"), c("p_size").alias("s"))
    label = lambda n: F.concat(F.lit("제"), n, F.lit("조"))
    now = p.select("law_id", F.lit(3).alias("pos"), label(c("s")).alias("label"), F.when(c("k") % 3 == 0, label(c("s") + 100)).otherwise("").alias("moved_from"), F.lit("20200101").alias("enforce_date"), F.concat(F.lit("글 "), c("s")).alias("content"))
    later = now.select("law_id", F.lit(9).alias("pos"), F.lit("제999조").alias("label"), "moved_from", F.lit("20210101").alias("enforce_date"), F.lit("다른 글").alias("content"))
    articles = now.unionByName(later)
    gone = p.select("law_id", label(c("s") + 100).alias("label"), F.when(c("k") % 3 == 1, F.concat(F.lit("글"), c("s"))).otherwise("없는 글").alias("content"))
    same = A.renumbered(gone, articles).select("law_id", "label", F.col("moved_to").alias("same_text"))
    return A.moved_to(gone.select("law_id", "label"), articles).join(same, ["law_id", "label"], "left").select("law_id", "label", "moved_to", "same_text", "enforce_date")


@R.query("""SELECT p_partkey AS id, '가 <mark class="d">나' || p_size || '</mark><mark class="i">다' || p_size || '</mark> 라' AS one, '가 <mark class="d">나' || p_size || '</mark> 라' AS was, '가 <mark class="i">다' || p_size || '</mark> 라' AS now,
 '가 나<mark class="pt" title="&lt;' || p_size || ' 추가됨">‸</mark>' AS inserted FROM part""")
def token_diff_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """An exchanged word in one flow and on two sides, and an insertion with its caret."""
    s = F.col("p_size")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("가 나"), s, F.lit(" 라")).alias("a"), F.concat(F.lit("가 다"), s, F.lit(" 라")).alias("b"), F.lit("가 나").alias("c"), F.concat(F.lit("가 나<"), s).alias("d"))
    both, added = D.token_diff("a", "b"), D.token_diff("c", "d")
    t = p.select("id", both.alias("x"), added.alias("y"))
    return t.select("id", D.unified_html(F.col("x")).alias("one"), D.sided_html(F.col("x"))["was"].alias("was"), D.sided_html(F.col("x"))["now"].alias("now"), D.sided_html(F.col("y"))["was"].alias("inserted"))


@R.query("""SELECT c_custkey AS id, (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = c_nationkey % 5 AND n_nationkey <> c_nationkey) AS target FROM customer""")
def local_ref_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinances cited by name: of several of one name the smallest, never the citing one."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("mst"), F.concat(F.lit("지역 "), F.col("c_nationkey") % 5, F.lit(" 조례")).alias("law_name"))
    o = table(spark, sf, "nation").select(F.col("n_nationkey").alias("mst"), F.concat(F.lit("지역"), F.col("n_regionkey"), F.lit("조례")).alias("name"))
    return V.local_targets(c, ["id"], o).select("id", "target")
