import random

from pyspark.sql import functions as F

from lexmill.functions.dates import norm_date, norm_version_key
from lexmill.operators.asof import asof_join


def test_asof_equals_brute_force(spark, got):
    r = random.Random(9)
    day = lambda: f"{r.randint(1999, 2012)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"
    changes = [(r.choice("abh"), day(), f"v{i}") for i in range(60)] + [("a", "20050505", "v9"), ("a", "20050505", "v1"), ("a", None, "x"), (None, "20000101", "y")]
    events = [(i, r.choice("ahhhhz"), day(), "keep") for i in range(400)] + [(900, None, "20050101", "n"), (901, "a", None, "n"), (902, "a", "20050505", "t")]
    want = set()
    for i, e, d, _ in events:
        c = [x for x in changes if e and d and x[0] == e and x[1] and x[1] <= d]
        if c:
            top = max(x[1] for x in c)
            want.add((i, min(x[2] for x in c if x[1] == top)))
    ev = spark.createDataFrame(events, "id int, e string, d string, version string")
    ch = spark.createDataFrame(changes, "e string, start string, version string")
    assert set(got(asof_join(ev, ch, "e", "d", "start", "version").select("id", "version"))) == want
    assert got(asof_join(ev, ch.limit(0), "e", "d", "start", "version")) == [] == got(asof_join(ev.limit(0), ch, "e", "d", "start", "version"))


def test_days_and_keys(spark):
    days = ["20240131", " 20240131", "2024.1.31.", "2024. 1. 31.", "2024-01-31", "2024/01/31", "2024년 1월 31일", "２０２４０１３１", "20240231", "00000000", "2024", "미정", "", None]
    out = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").select("i", norm_date(F.col("d"))).collect()
    assert [r[1] for r in sorted(out, key=lambda r: r[0])] == ["20240131"] * 8 + [None] * 6
    keys = ["20240131|0012", "2024.1.31.|제12호", " 20240131 | 12 ", "2024-01-31|12", "|", "", None, "x|1"]
    out = spark.createDataFrame([(i, d) for i, d in enumerate(keys)], "i int, d string").select("i", norm_version_key(F.col("d"))).collect()
    assert [r[1] for r in sorted(out, key=lambda r: r[0])] == ["20240131|12"] * 4 + [None] * 4
