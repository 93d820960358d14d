import datetime

from lexmill.llm.queries import p3_plain


def test_bodies_come_out_plain(spark, tmp_path, got):
    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("7", "<b>제１조</b>", day), ("7", "<b>제２조</b>", day), ("8", None, day)], "mst string, body_xml string, fetched_at timestamp").write.parquet(f"{tmp_path}/ordinances.parquet")
    for name in ("citations", "findings"):
        spark.createDataFrame([(1, "도로ㆍ법")], "id long, law_name string").write.parquet(f"{tmp_path}/{name}.parquet")
    out = p3_plain(spark, str(tmp_path))
    assert got(out.select("src", "rec_id", "plain")) == [("citations", "1", "도로·법"), ("findings", "1", "도로·법"), ("ordinances", "7", "<b>제1조</b>"), ("ordinances", "7", "<b>제2조</b>")]
    assert out.select("src", "rec_id", "text_key").distinct().count() == 4
