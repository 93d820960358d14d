import json
import zipfile

import pytest

from lexmill import config
from lexmill.operators import sinks
from lexmill.sources import landing
from lexmill.streaming.changes import apply_batch, follow


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("가", 1, "<b>"), (None, 2, "x")], "name string, n int, h string")
    text = open(sinks.write_csv(df.orderBy("n"), str(tmp_path / "a.csv"), "끝"), encoding="utf-8").read()
    assert text.startswith("﻿name,n,h") and "가,1,<b>" in text and text.rstrip().endswith("끝")
    page = open(sinks.write_html(df, str(tmp_path / "a.html"), "t<", markup=["h"]), encoding="utf-8").read()
    assert "<td><b></td>" in page and "t&lt;" in page
    assert json.load(open(sinks.write_site({"v": df.orderBy("n")}, str(tmp_path / "site"))[0], encoding="utf-8"))[0] == {"name": "가", "n": 1, "h": "<b>"}
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "b.csv"), rows=1)
    sinks.write_json(df, str(tmp_path / "j"), "n")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_slim_and_swap(spark, tmp_path, got):
    o = spark.createDataFrame([("m", "x" * 9)], "mst string, body_xml string")
    assert sinks.slim_copy({"ordinances": o, "laws": o}, str(tmp_path / "slim")) == ["ordinances"]
    assert spark.read.parquet(str(tmp_path / "slim/ordinances.parquet")).columns == ["mst"]
    assert any(n.startswith("ordinances.parquet/") for n in zipfile.ZipFile(sinks.zip_folder(str(tmp_path / "slim"), str(tmp_path / "s.zip"))).namelist())
    sinks.swap(o, str(tmp_path / "t"))
    again = sinks.swap(spark.read.parquet(str(tmp_path / "t")).unionByName(o), str(tmp_path / "t"))
    assert again.count() == 2
    c = spark.createDataFrame([("법령", "e" * 20), ("기타", "e"), (None, None)], "cite_type string, evidence string")
    sinks.persist_tables({"citations": c}, str(tmp_path / "p"), 5)
    assert got(spark.read.parquet(str(tmp_path / "p/citations.parquet"))) == [("법령", "eeeee"), (None, None)]


def test_landing(spark, tmp_path, got):
    for i, text in enumerate(("<r><n>2</n><law><이름>가 법</이름><id>1</id></law><law><이름>나법</이름></law></r>", "<r><law><이름>다</이름><id>3</id></law></r>")):
        (tmp_path / f"p{i}.xml").write_text(text, encoding="utf-8")
    items = landing.read_items(spark, str(tmp_path / "*.xml"), "law", ["이름", "id"])
    assert got(items.select("이름", "id")) == [("가 법", "1"), ("나법", None), ("다", "3")]
    links = spark.createDataFrame([("가 법", "1", 1), ("가법", "2", 2), ("나", "", 3), (None, "4", 4)], "n string, l string, o int")
    assert got(landing.link_index(links, "n", "l", "o")) == [("가법", "2")]
    hits = spark.createDataFrame([("가법", "가 법 시행령", "9", 1), ("가법", "가 법", "8", 2), ("다", "라", "7", 1)], "asked string, name string, id string, rank int")
    assert got(landing.best_hit(hits, "asked", "name", "id", "rank")) == [("가법", "8"), ("다", "7")]
    assert got(landing.best_hit(hits, "asked", "name", "id", "rank", exact_only=True)) == [("가법", "8")]
    assert got(landing.numbered(links.where("n IS NOT NULL"), ["o"], 2).select("o", "place")) == [(1, 1), (2, 2)]
    assert landing.merged(links.select("n"), links).count() == 8


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"region": "가시", "local_prefix": ["나시", "가시"], "other": 1, "deep": true}', encoding="utf-8")
    assert config.load(str(f), {}) == config.Config("가시", ("가시", "나시"), None, True)
    assert config.load(str(f), {"LEXMILL_REGION": "다시", "LEXMILL_MAX_AGE_DAYS": "3", "LEXMILL_DEEP": "0"}).local_prefix == ("다시", "나시", "가시")
    f.write_text("{bad")
    assert config.load(str(f), {}) == config.Config() == config.load(None, {})


SCHEMA = "law_id string, version_key string, fetched_at timestamp_ntz"


def test_change_stream(spark, tmp_path, got):
    import datetime as dt

    day = lambda n: dt.datetime(2025, 1, n)
    drops, folder = str(tmp_path / "drops"), str(tmp_path / "state")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1)
    frame([("a", "20240101|1", day(1)), ("b", "20240101|2", day(1))]).write.mode("append").parquet(drops)
    follow(spark, drops, folder, SCHEMA, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{folder}/log").count() == 0
    frame([("a", "2024.2.1.|제3호", day(2)), ("a", "20240101|1", day(1)), ("b", "|", day(2)), ("c", "20240101|9", day(2)), (None, "20240101|9", day(2))]).write.mode("append").parquet(drops)
    follow(spark, drops, folder, SCHEMA, str(tmp_path / "cp")).awaitTermination()
    want = [("a", "20240201|3", "20240101|1", day(2))]
    assert got(spark.read.parquet(f"{folder}/log")) == want
    apply_batch(frame([("a", "20240201|3", day(3))]), folder)
    assert got(spark.read.parquet(f"{folder}/log")) == want
    assert got(spark.read.parquet(f"{folder}/state")) == [("a", "20240201|3"), ("b", "20240101|2"), ("c", "20240101|9")]
