import random

from pyspark.sql import functions as F

from lexmill.operators.article_diff import article_changes, article_digests
from lexmill.operators.snapshot_diff import merkle_diff


def test_merkle_equals_full_comparison(spark, got):
    r = random.Random(5)
    state, snaps = {f"k{i}": 0 for i in range(300)}, {}
    for day in ("d1", "d2", "d3"):
        snaps[day] = dict(state)
        for k in r.sample(sorted(state), 9):
            r.choice([lambda: state.pop(k), lambda: state.__setitem__(k, (state[k] or 0) + 1), lambda: state.__setitem__(f"n{day}{k}", None)])()
    data = [(d, k, v) for d, s in snaps.items() for k, v in s.items()] + [("d1", None, 1), ("d2", None, 2)]
    want = {("d1", "d2", None, "differs"), ("d2", "d3", None, "removed")}
    for a, b in (("d1", "d2"), ("d2", "d3")):
        for k in snaps[a].keys() | snaps[b].keys():
            if k not in snaps[a]:
                want.add((a, b, k, "added"))
            elif k not in snaps[b]:
                want.add((a, b, k, "removed"))
            elif snaps[a][k] != snaps[b][k]:
                want.add((a, b, k, "differs"))
    df = spark.createDataFrame(data, "snap string, key string, v int")
    for depth in (1, 2):
        assert set(got(merkle_diff(df, "snap", "key", F.col("v"), ["d1", "d2", "d3"], depth))) == want
    assert got(merkle_diff(df, "snap", "key", F.col("v"), ["d1"])) == []


def law(*articles, tail=""):
    return "<법령><조문>" + "".join(f"<조문단위><조문여부>조문</조문여부><조문번호>{n}</조문번호><조문제목>{t}</조문제목><조문내용>{c}</조문내용></조문단위>" for n, t, c in articles) + f"</조문>{tail}</법령>"


def test_what_is_no_change():
    a = article_digests(law((1, "목적", "가 나&lt;b&gt;")))
    assert a == article_digests(law((1, "목적 ", "가나<![CDATA[<b>]]>"), tail="<부칙>x</부칙>"))
    assert a != article_digests(law((1, "목 적이", "가 나&lt;b&gt;")))
    assert article_digests("<법령>") is None and article_digests(None) is None


def test_article_changes(spark, got):
    one, two = law((1, "t", "a"), (2, "t", "b")), law((1, "t", "a2"), (3, "t", "c"))
    data = [
        ("d1", "L1", "20200101|1", one, "1"), ("d1", "L1", "20200101|1", two, "2"), ("d1", "L1", "20200101|1", one, "3"),  # the last fetched counts
        ("d2", "L1", "2020.1.1.|제1호", two, "1"),
        ("d1", "L2", "20200101|1", one, "1"), ("d2", "L2", "|", None, "1"),  # missing says nothing
        ("d1", "L3", "20200101|1", one, "1"), ("d2", "L3", "20210101|1", one.replace("><", "> <"), "1"),
        ("d1", "L4", None, one, "1"), ("d2", "L5", None, one, "1"), (None, "L6", None, one, "1"), ("d2", None, None, one, "1"),
        ("d1", "L7", "20200101|1", one, "1"), ("d2", "L7", "20200101|1", "<broken", "1"),
    ]
    df = spark.createDataFrame(data, "batch_date string, law_id string, version_key string, body_xml string, fetched_at string").withColumn("label", F.lit("clash"))
    assert got(article_changes(df, 1)) == [
        ("d2", "L1", "", "changed"), ("d2", "L1", "제1조", "changed"), ("d2", "L1", "제2조", "removed"), ("d2", "L1", "제3조", "added"),
        ("d2", "L3", "", "changed"), ("d2", "L4", "", "removed"), ("d2", "L5", "", "added"),
    ]
    assert got(article_changes(df.limit(0))) == []
