import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from lexmill.operators import articles as A
from lexmill.operators import store

LAW = """<법령><기본정보><법령명_한글><![CDATA[ 가법 ]]></법령명_한글><공포일자>20240101</공포일자><공포번호>7</공포번호><시행일자>20240201</시행일자><제개정구분>일부개정</제개정구분></기본정보><조문>
<조문단위><조문여부>전문</조문여부><조문번호>1</조문번호></조문단위>
<조문단위><조문여부>조문</조문여부><조문번호>2</조문번호><조문가지번호>3</조문가지번호><조문제목>t</조문제목><조문이동이전>000100</조문이동이전><조문변경여부>Y</조문변경여부><조문내용>머리</조문내용>
<항><항내용>① a</항내용><호><호내용>1. b</호내용><목><목내용>가. c</목내용></목></호></항><호><호내용>2. d</호내용></호></조문단위>
<조문단위><조문여부>조문</조문여부><조문번호>5</조문번호><조문내용>old</조문내용></조문단위><조문단위><조문여부>조문</조문여부><조문번호>5</조문번호><조문내용>new</조문내용></조문단위></조문></법령>"""


def test_law_rows():
    rows = A.law_rows(ET.fromstring(LAW))
    assert [(r[1], r[8]) for r in rows] == [("제2조의3", "머리\n① a\n1. b\n가. c\n2. d"), ("제5조", "new")]
    assert rows[0][5] == "제1조" and rows[0][7] is True


def test_rule_styles():
    flat = "<a><조문내용>앞글\n제1조(가) 하나\n더\n제2조의2 둘</조문내용></a>"
    assert [(r[1], r[8]) for r in A.rule_rows(ET.fromstring(flat))] == [("제1조", "제1조(가) 하나\n더"), ("제2조의2", "제2조의2 둘")]
    ordinance = "<a><조문><조><조문번호>x</조문번호><조내용>제3조 셋</조내용></조><조><조문여부>N</조문여부><조문번호>000400</조문번호></조></조문></a>"
    assert [r[1] for r in A.rule_rows(ET.fromstring(ordinance))] == ["제3조"]
    assert [r[1] for r in A.rule_rows(ET.fromstring(LAW))] == ["제2조의3", "제5조"]
    assert A.rule_rows(ET.fromstring("<a/>")) == []


def test_meta(spark, got):
    df = spark.createDataFrame([("1", LAW), ("2", None), ("3", "<a><행정규칙명>r&amp;d</행정규칙명></a>")], "law_id string, body_xml string")
    assert got(A.law_meta(df)) == [("1", "가법", "가법", "20240201", "일부개정", "20240101|7"), ("2", "", "", "", "", None), ("3", "", "r&d", "", "", None)]


def test_frames(spark, got):
    df = spark.createDataFrame([("1", LAW), ("2", None), ("3", "<x"), (None, LAW)], "law_id string, body_xml string")
    assert A.parsed_articles(df, "law_id").count() == 4 and A.parsed_articles(df.limit(0), "law_id").count() == 0


def comparison(exists="Y", new="제1조 가 나"):
    return f"<R><신구법존재여부>{exists}</신구법존재여부><신조문_기본정보><시행일자>2024.01.02</시행일자></신조문_기본정보><구조문목록><조문>앞</조문><조문>제1조 가나</조문><조문>① (생 략)</조문></구조문목록><신조문목록><조문>{new}</조문><조문>(현행과 같음)①</조문><조문>제2조 새</조문></신조문목록></R>"


def test_comparisons(spark, got):
    df = spark.createDataFrame([(1, comparison()), (2, comparison("n")), (3, comparison(new="제1조 다")), (4, None)], "id int, x string")
    out = A.comparisons(df, "id", "x").select("id", "label", A.comparison_changed(F.col("old"), F.col("new")).alias("c"), "day")
    assert got(out) == [(1, "제1조", False, "20240102"), (1, "제2조", True, "20240102"), (3, "제1조", True, "20240102"), (3, "제2조", True, "20240102")]


def test_moves(spark, got):
    arts = spark.createDataFrame([("L", 0, "제1조", "", "d1", "a b"), ("L", 1, "제4조", "제9조", "d2", "x  y"), ("L", 2, "제5조", "제9조", "d3", "xy")], "law_id string, pos int, label string, moved_from string, enforce_date string, content string")
    cited = spark.createDataFrame([("L", "제1조"), ("L", "제9조"), ("L", "제8조")], "law_id string, label string")
    assert got(A.moved_to(cited, arts)) == [("L", "제8조", None, None), ("L", "제9조", "제4조", "d2")]
    gone = spark.createDataFrame([("L", "제7조", "x y"), ("L", "제6조", "none")], "law_id string, label string, content string")
    assert got(A.renumbered(gone, arts)) == [("L", "제7조", "제4조")]


def test_store(spark, got):
    old = spark.createDataFrame([("a", 1, "keep"), ("b", 2, "keep")], "k string, v int, w string")
    new = spark.createDataFrame([("b", None), ("c", 5)], "k string, v int")
    assert got(store.upsert(old, new, ["k"])) == [("a", 1, "keep"), ("b", 2, "keep"), ("c", 5, None)]
    assert got(store.replace_rows(old, new, ["k"])) == [("a", 1, "keep"), ("b", None, None), ("c", 5, None)]
    assert got(store.insert_absent(old, new, ["k"])) == [("a", 1, "keep"), ("b", 2, "keep"), ("c", 5, None)]
    log = spark.createDataFrame([("a", "2", "x"), ("a", "1", "y"), ("a", "1", "z")], "k string, t string, v string")
    assert got(store.first_seen(log, ["k"], "t", ["v"])) == [("a", "y", "1")]
    t = F.to_timestamp_ntz(F.lit("2024-05-20 00:00:00"))
    say = lambda d: spark.range(1).select(store.freshness(t, "2024-06-01 00:00:00", d)).collect()[0][0]
    assert [say(d) for d in (None, 0, 5, 30)] == ["reuse", "fetch", "fetch", "reuse"]
