from lexmill import session
from lexmill.sources.tables import latest


def test_latest(spark, got):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "only"), (None, 1, "n"), ("t", 1, "p"), ("t", 1, "q")]
    out = got(latest(spark.createDataFrame(rows, "k string, t int, v string"), ["k"], "t", ["v"]))
    assert out[:3] == [("a", "y"), ("b", "only"), ("t", out[2][1])] and out[3] == (None, "n")
    again = got(latest(spark.createDataFrame(rows[::-1], "k string, t int, v string"), ["k"], "t", ["v"]))
    assert again == out  # ties are settled by content, not by place


def test_shared_folder_is_the_sessions_own(spark):
    folder = session.checkpoint_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    df = session.write_shared(spark.range(3), "x")
    assert df.count() == 3 and any(folder.rstrip("/") in f for f in df.inputFiles())
    assert session.spread(spark.range(10)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
