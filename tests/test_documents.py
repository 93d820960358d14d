"""Queries over texts on small tables written by hand."""

import datetime

import pytest

from lexmill.plans import documents as P

DAY = datetime.datetime(2024, 1, 1)


def law(name, *articles):
    units = "".join(f"<조문단위><조문여부>조문</조문여부><조문번호>{n}</조문번호><조문이동이전>{came}</조문이동이전><조문내용>{text}</조문내용></조문단위>" for n, came, text in articles)
    return f"<법령><기본정보><법령명_한글>{name}</법령명_한글></기본정보><조문>{units}</조문></법령>"


TEXT = "「가나법」 제1조, 「가나법」 제2조제3항, 「다라법」 제5조, 「마바 규정」 제1조, 「옛이름법」 제1조, 「옛이름법」 제2조, 「없는법」 제1조와 모르는법 제9조"
FINDINGS = [
    (1, "1", "01", "가나법", "제1조", "", "review", "번호이동", "제1조"), (2, "1", "01", "가나법", "제2조", "제3항", "review", "내용변경", "제1조"),
    (3, "1", "01", "가나법", "제2조", "제4항", "current", "동일", "제1조"), (4, "1", None, "없는법", None, None, "check", "법령미해결", "제1조"),
    (5, "1", "ADM:9", "마바 규정", "제1조", None, "current", None, "제1조"), (6, "9", "01", "가나법", "제1조", "", "check", None, None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("tables")
    body = f"<법령><조문><조><조문번호>000100</조문번호><조문여부>Y</조문여부><조내용>{TEXT}</조내용></조></조문></법령>"
    tables = {
        "ordinances": ([("1", body, "20200101", DAY)], "mst string, body_xml string, enforce_date string, fetched_at timestamp"),
        "citations": ([(1, "가나법", "01"), (2, "다라법", "02"), (3, "옛이름법", "03"), (4, "마바 규정", "ADM:9")], "id long, law_name string, law_id string"),
        "findings": (FINDINGS, "id long, mst string, law_id string, law_name string, clause_label string, clause_detail string, severity string, change_type string, ord_clause string"),
        "laws": (
            [("01", "가나법", law("가나법", (2, "", "둘"), (7, "", "하 나"))), ("02", "다라법", law("다라법", (6, "000500", "다섯"))), ("03", "새이름법", law("새이름법", (1, "", "하나"))), ("ADM:9", "마바 규정", law("마바 규정", (1, "", "갑 &lt;개정 2010. 1. 1.&gt;")))],
            "law_id string, name string, body_xml string",
        ),
        "law_versions": ([("01", "77", "20190101", law("가나법", (1, "", "하나"), (2, "", "두울")), DAY)], "law_id string, version_mst string, enforce_date string, body_xml string, fetched_at timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")
    return str(sf)


def test_every_cited_law_is_judged(spark, folder, got):
    found = P.findings_end_to_end(spark, folder).select("law_id", "law_name", "article_no", "label", "severity", "change_type")
    assert got(found) == sorted([
        ("01", "가나법", "제1조", "제1조", "review", "번호이동"), ("01", "가나법", "제1조", "제2조", "review", "내용변경"),
        ("02", "다라법", "제1조", "제5조", "mechanical", ""), ("ADM:9", "마바 규정", "제1조", "제1조", "current", ""),
        ("03", "옛이름법", "제1조", "", "review", "제명변경"), ("", "없는법", "제1조", "", "check", "법령미해결"),
    ], key=repr)


def test_findings_not_replayed_do_not_match(spark, folder, got):
    assert got(P.trace_match(spark, folder).select("id", "match")) == [(1, True), (2, True), (3, False), (4, True), (5, True), (6, False)]


def test_cited_texts_are_diffed(spark, folder, got):
    want = '<mark class="d">두울</mark><mark class="i">둘</mark>'
    assert got(P.token_diff(spark, folder)) == [("01", "77", "제2조", want)]
