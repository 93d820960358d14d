import random

from pyspark.sql import functions as F

from lexmill.operators.history import close_intervals, coalesce_runs


def test_runs_equal_islands(spark, got):
    r = random.Random(3)
    seen = [(r.choice("ab"), r.choice("xyz"), r.randrange(13)) for _ in range(60)] + [("hot", "x", s) for s in range(13)] * 5 + [(None, None, 2), ("a", "x", None)]
    df = spark.createDataFrame(seen, "e string, p string, slot long")
    want = set()
    for key in {(e, p) for e, p, s in seen if s is not None}:
        slots = sorted({s for e, p, s in seen if (e, p) == key and s is not None})
        start = last = slots[0]
        for s in [*slots[1:], 99]:
            if s != last + 1:
                want.add((*key, start, last))
                start = s
            last = s
    assert set(got(coalesce_runs(df, ["e", "p"], "slot", 13))) == want
    assert got(coalesce_runs(df.limit(0), ["e", "p"], "slot", 0)) == []


def test_carried_values_never_null(spark, got):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 5), ("a", 2, 3)], "e string, slot long, v int")
    assert got(coalesce_runs(df, ["e"], "slot", 3, {"v": F.col("v")})) == [("a", 0, 2, 5)]


def test_close(spark, got):
    df = spark.createDataFrame([("a", "k1", ""), ("a", "k2", "20200301"), ("a", "k3", "20240101"), ("b", "k", "20200101"), ("c", "t1", "20200101"), ("c", "t2", "20200101")], "e string, k string, f string")
    assert got(close_intervals(df.withColumn("valid_to", F.lit("old")), "e", "f").select("e", "k", "valid_to")) == [
        ("a", "k1", "20200229"), ("a", "k2", "20231231"), ("a", "k3", "99991231"), ("b", "k", "99991231"), ("c", "t1", "99991231"), ("c", "t2", "99991231"),
    ]
    assert got(close_intervals(df.limit(0), "e", "f")) == []
