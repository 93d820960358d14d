import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.judge import check_clause, diff_clause
from lexmill.operators.diff import changes, highlight, token_diff, unified_html


def one(spark, expression, **values):
    kinds = {str: "string", int: "int", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expression.alias("x")).collect()[0][0]


def test_scalars(spark):
    c = F.col("c")
    say = lambda f, v: one(spark, f(c), c=v)
    assert [say(X.primary_department, v) for v in ("건설과, 위생과", "건설과、위생과", " , x", "", None)] == ["건설과", "건설과", ", x", "", ""]
    assert [say(X.format_day, v) for v in ("20240131", "2024.01.31", "원제정", " ", None)] == ["2024-01-31", "2024-01-31", "원제정", "—", "—"]
    assert say(X.escape_html, "<a b=\"c'\">&") == "&lt;a b=&quot;c&#x27;&quot;&gt;&amp;"
    assert [say(lambda x: X.particle(x, "이", "가"), v) for v in ("제3호", "가목", "x", "")] == ["가", "이", "가", "가"]
    assert [say(X.article_code, v) for v in ("003000", "001502", "000000", "12", "0015ab", None)] == ["제30조", "제15조의2", "", "", "", ""]
    assert say(X.normalize_text, "가나・　") == "가나· "
    assert [say(lambda x: X.cited_kind(x, ("가온시",)), v) for v in ("주차장법 시행규칙", "가온시 조례", "x 규칙", "가온시 지침", "가온시 x", "법령", "", None)] == ["법령", "자치법규", "자치법규", "법령", "자치법규", "기타", "기타", "기타"]
    assert say(X.amend_days, "<개정 2020.1.2, 2019. 12. 31> <신설 2020.1.2> <삭제 2021.1.1>") == ["20191231", "20200102"]
    assert say(X.amend_days, None) == []
    assert tuple(say(lambda x: X.basis_days(x, F.lit("20200101")), "<개정 2019.1.1> <개정 2021.1.1>")) == ("20190101", "20210101", True)
    assert tuple(say(lambda x: X.basis_days(x, F.lit("2018-01-01")), "<개정 2019.1.1>")) == ("원제정", "20190101", True)
    assert say(lambda x: X.basis_days(x, F.lit("")), "none") is None
    assert tuple(say(X.split_evidence, "[당시] a\nb\n[현행] c")) == ("a\nb", "c") and say(X.split_evidence, "x") is None


TEXT = "제2조(정의) 머리\n① 첫째\n1. 하나\n가. ㄱ\n나. ㄴ\n5의2. 다섯\n② 둘째\n1. 둘의 하나"


@pytest.mark.parametrize("hang,ho,mok,want", [
    (1, None, None, "① 첫째\n1. 하나\n가. ㄱ\n나. ㄴ\n5의2. 다섯"), (2, "1", None, "1. 둘의 하나"), (1, "1", "나", "나. ㄴ"), (1, "5의2", None, "5의2. 다섯"),
    (3, None, None, None), (1, "9", None, None), (None, None, None, None), (None, "1", None, "1. 하나\n가. ㄱ\n나. ㄴ"), (25, None, None, None),
])
def test_narrow(spark, hang, ho, mok, want):
    x = X.narrow_unit(F.lit(TEXT), F.lit(hang).cast("int"), F.lit(ho).cast("string"), F.lit(mok).cast("string"))
    assert spark.range(1).select(x.alias("x")).collect()[0][0] == want


def verdict(spark, x):
    v = spark.range(1).select(x.alias("x")).collect()[0][0]
    return v["severity"], v["change_type"]


def no(kind="string"):
    return F.lit(None).cast(kind)


@pytest.mark.parametrize("content,day,own,ho,moved,want", [
    (None, "", "20200101", None, "제3조", ("mechanical", "")), (None, "", "20200101", None, None, ("check", "")), ("x", "", "없음", None, None, ("check", "")),
    ("x <개정 2021.1.1>", "", "20200101", None, None, ("review", "")), ("x <개정 2019.1.1>", "", "20200101", None, None, ("current", "")), ("x <개정 2020.1.1>", "", "20200101", None, None, ("current", "")),
    ("머리 <개정 2021.1.1>\n1. 하나", "", "20200101", "1", None, ("check", "호미확인")), ("x", "20210101", "20200101", None, None, ("check", "")), ("x", "20190101", "20200101", None, None, ("current", "")),
])
def test_check(spark, content, day, own, ho, moved, want):
    article = F.struct(F.lit(content).alias("content"), F.lit(day).alias("enforce_date")) if content else F.lit(None).cast("struct<content:string,enforce_date:string>")
    assert verdict(spark, check_clause(article, F.lit(moved).cast("string"), F.lit(own), no("int"), F.lit(ho).cast("string"), no())) == want


@pytest.mark.parametrize("now,then,moved,ho,want", [
    (None, "a", "제9조", None, ("review", "번호이동")), (None, "a", None, None, ("review", "삭제")), (None, None, None, None, ("check", "미확인")),
    ("h <개정 2021.1.1>\n1. a", "h\n1.  a", None, "1", ("current", "동일")), ("h\n1. b", "h\n1. a", None, "1", ("review", "내용변경")),
    ("x <개정 2021.1.1>", "x <개정 2021.1.1>", None, None, ("review", "내용변경")), ("x <개정 2019.1.1>", "y", None, None, ("current", "동일")),
    ("a b", "ab", None, None, ("current", "동일")), ("a", "b", None, None, ("review", "내용변경")), ("a", None, None, None, ("current", "동일")),
])
def test_diff_clause(spark, now, then, moved, ho, want):
    s = lambda v: F.lit(v).cast("string")
    assert verdict(spark, diff_clause(s(now), s(then), s(moved), F.lit("20200101"), no("int"), s(ho), no())) == want


def test_token_diff(spark):
    assert changes("가 나 다", "가 라 다!") == [("=", "가 "), ("-", "나"), ("+", "라"), ("=", " 다"), ("+", "!")]
    assert changes(None, "") == []
    df = spark.createDataFrame([("a <b", "a c"), (None, None)], "o string, n string")
    assert [r[0] for r in df.select(unified_html(token_diff("o", "n"))).collect()] == ['a <mark class="d">&lt;b</mark><mark class="i">c</mark>', ""]


def test_highlight(spark):
    df = spark.createDataFrame([("ab<cd", [(2, 4, "x"), (0, 1, "y"), (3, 5, "late"), (4, 9, "out"), (1, 1, "none")]), ("q", [])], "t string, s array<struct<start:int,end:int,css:string>>")
    assert [r[0] for r in df.select(highlight(F.col("t"), F.col("s"))).collect()] == ['<mark class="y">a</mark>b<mark class="x">&lt;c</mark>d', "q"]
