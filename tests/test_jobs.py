"""Jobs, the detail of an ordinance and the site on small tables written by hand."""

import json
import os

from lexmill import jobs
from lexmill.operators.report import report_items
from lexmill.operators.site import fragments, safe_name, write_grade, write_report, write_static
from lexmill.plans import documents as D
from lexmill.plans.views import index_names
from lexmill.sources.landing import first_body
from lexmill.sources.source import Source, TableSource, ranked_names
from test_documents import folder  # noqa: F401

SETTINGS = jobs.Settings(at="2024-05-01 00:00:00")


def test_batch_and_reparse_are_the_same(spark, folder, tmp_path, got):  # noqa: F811
    source = TableSource(spark, folder)
    assert isinstance(source, Source)
    out = str(tmp_path / "out")
    jobs.run_batch(spark, source, out, SETTINGS)
    read = lambda t: spark.read.parquet(f"{out}/{t}.parquet")
    first = {t: got(read(t)) for t in ("findings", "citations", "law_articles")}
    assert len(first["findings"]) == 6 and len(first["citations"]) == 8
    assert got(read("batch_meta").select("deep", "status", "ordinances_n", "findings_n")) == [(True, "ok", 1, 6)]
    jobs.reparse(spark, folder, out)
    assert {t: got(read(t)) for t in first} == first
    assert got(read("batch_meta").select("deep", "status")) == [(True, "reparsed")]


def test_changes_are_logged_once(spark, tmp_path, got):
    law = lambda n, kind, flag: f"<법령><기본정보><법령명_한글>{n}</법령명_한글><시행일자>20240101</시행일자><제개정구분>{kind}</제개정구분></기본정보><조문><조문단위><조문여부>조문</조문여부><조문번호>2</조문번호><조문변경여부>{flag}</조문변경여부></조문단위></조문></법령>"
    laws = spark.createDataFrame([("1", "가법", law("가법", "일부개정", "Y"), "2024.1.1|제7호"), ("2", "나법", law("나법", "전부개정", "N"), "20240101|8"), ("3", "다법", law("다법", "일부개정", "N"), "20240101|9"), ("4", "라법", None, "|"), ("5", "새법", None, "20240101|1")], "law_id string, name string, body_xml string, version_key string")
    known = spark.createDataFrame([("1", "20230101|1"), ("2", "20230101|1"), ("3", "20230101|1"), ("4", "20230101|1"), ("1x", "20230101|1")], "law_id string, version_key string")
    from lexmill.operators.articles import parsed_articles

    found = jobs.detected(laws, known, parsed_articles(laws, "law_id"), "2024-05-01 00:00:00")
    assert got(found.select("law_id", "new_key", "name", "new_enforce", "changed_articles")) == [("1", "20240101|7", "가법", "20240101", "제2조"), ("2", "20240101|8", "나법", "20240101", "*"), ("3", "20240101|9", "다법", "20240101", "")]


def test_detail_of_an_ordinance(spark, folder, got):  # noqa: F811
    cites = spark.createDataFrame([("1", "제1조", "가나법", "제1조,제9조", 0, 9, 0, "법령"), ("1", "제1조", "다라법", "제5조", 10, 15, 1, "법령"), ("1", "제1조", "남의 조례", "", 20, 24, 0, "자치법규"), ("1", "제1조", "가나법", "", 90, 999, 0, "법령")], "mst string, article_no string, law_name string, clause_label string, span_start int, span_end int, cite_naked int, cite_type string")
    found = spark.createDataFrame([("1", "가나법", "제9조", "제1조, 제2조", "review", "내용변경", 0, 0), ("1", "다라법", "", "제1조", "check", None, 0, 0), ("1", "남", "제1조", "제1조", "current", None, 0, 0)], "mst string, law_name string, clause_label string, ord_clause string, severity string, change_type string, cite_naked int, cite_spacing int")
    row = D.detail_articles(TableSource(spark, folder), cites, found).collect()[0]
    assert (row.label, row.cites, row.act) == ("제1조", 4, 2)
    assert [p.split('"')[1] for p in row.html.split("<mark ")[1:]] == ["cite-law", "cite-naked", "cite-local"]


FOUND = "id long, mst string, law_name string, clause_label string, severity string, change_type string, ord_clause string, ord_seq int, detail string, cite_naked int"
ROWS = [(1, "1", "가법", "제2조", "review", "내용변경", "제10조", 3, None, 0), (2, "1", "나법", "제3조", "current", None, "제2조", 1, None, 1), (3, "1", "다법", None, "review", "제명변경", "제2조", 2, "인용한 「다법」이 현행 「라<법」으로", 0), (4, "1", "가법", "제1조", "current", "동일", None, None, None, 0), (5, "9", None, None, "check", "법령미해결", None, None, None, 0)]


def test_report_and_site(spark, tmp_path, got):
    f = spark.createDataFrame(ROWS, FOUND)
    o = spark.createDataFrame([("1", "가 조례/1", "도로과", "20200101")], "mst string, name string, dept string, enforce_date string")
    items = report_items(f, o)
    assert [r[0] for r in got(items.select("id"))] == [1, 2, 3, 5] and report_items(f, o, include_current=True).count() == 5
    assert got(report_items(f, o, dept="도로과").select("id")) == [(1,), (2,), (3,)] and got(report_items(f, o, mst="9").select("id", "ord_name")) == [(5, "(조례명 미상)")]
    said = {r.id: (r.action, r.action_html) for r in items.collect()}
    assert said[1][0] == "「가법」 제2조 개정 내용을 반영하여 이 조례 제10조를 검토·정비"
    assert said[2][0] == '(서식만 정비) "나법 제3조"를 "「나법」 제3조"로 정정 — 내용 변경은 없음 (이 조례 제2조)'
    assert '<span class="fx-old">「다법」</span>' in said[3][1] and '<span class="fx-new">「라&lt;법」</span>' in said[3][1]
    html = {r.mst: r.html for r in fragments(items).collect()}
    assert html["1"].count("<h2>") == 2 and html["1"].index("나법") < html["1"].index("다법") < html["1"].index("가법")
    assert "<h1>가 조례/1</h1>" in open(write_report(items, str(tmp_path / "r.html"), "모두"), encoding="utf-8").read()
    assert "가법" in open(write_grade(items, "review", str(tmp_path / "g.csv")), encoding="utf-8").read()
    made = write_static(str(tmp_path / "site"), items, spark.createDataFrame([("1", "<p>")], "mst string, html string"), {"overview": o}, ["도로과", "없는과"], "끝")
    assert [os.path.basename(p) for p in made] == ["overview.json", "dept_0.csv", "dept_0.html", "grade_mechanical.csv", "grade_review.csv", "grade_check.csv", "grade_format.csv"]
    assert json.load(open(made[0], encoding="utf-8"))[0]["mst"] == "1" and os.path.isdir(tmp_path / "site/ordinance/mst=1")
    assert safe_name('a/b:c*?"<>|d') == "a_b_c______d"


def test_names_of_all_tiers(spark, got):
    frame = lambda *rows: spark.createDataFrame(list(rows), "name string, law_id string, place string")
    names = ranked_names((frame(("가 법", "1", "2"), ("가법", "9", "1"), (None, "3", "1")), "name", "place"), (frame(("나법", "2", "1"), ("나법", "", "0"), ("규정", "ADM:1", "1")), "name", "place"), (frame(("나법", "5", "0"), ("다법", "6", "1")), "name", "place"))
    assert got(index_names(names)) == [("가법", "9", 0), ("나법", "2", 1), ("다법", "6", 2)] and got(index_names(names, rules=True)) == [("규정", "ADM:1", 1)]


def test_bodies_are_asked_in_turn(spark, got):
    t = lambda *rows: spark.createDataFrame(list(rows), "k string, body_xml string")
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert got(first_body(asked, "id", (t(("1", "a"), ("2", "")), "k"), (t(("1", "x"), ("2", "b")), "k"))) == [("1", "a"), ("2", "b"), ("3", "")]
