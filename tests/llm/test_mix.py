import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import mix as M
from lexmill.llm.queries import TOKENIZER as PATH


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80), st.floats(0.01, 0.99), st.integers(0, 999))
def test_flight_keeps_both_totals(tokens, p, seed):
    t, start = np.array(tokens), np.full(len(tokens), p)
    out = M.flight(start, t, np.random.default_rng(seed))
    assert abs(out.sum() - start.sum()) < 1e-6 and abs(out @ t - start @ t) < 1e-5
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
    landed = M.land(out, t)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed @ t - start @ t) <= 2 * max(tokens)


def test_inclusion_is_unbiased():
    t = np.array([5, 9, 2, 7, 7, 3, 8, 1])
    total = sum(M.flight(np.full(8, 0.3), t, np.random.default_rng(s)) for s in range(4000)) / 4000
    assert np.abs(total - 0.3).max() < 0.03


def test_allocate():
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)]
    assert M.allocate({"a": 100, "b": 30}, targets) == {"a": 100.0, "b": 60.0, "c": 0.0}
    assert M.allocate({"a": 100, "b": 10}, targets, 200) == {"a": 100.0, "b": 20.0, "c": 0.0}
    assert M.allocate({}, targets) == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_mix(spark, got, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 20)
    docs = [(i, "word " * (i % 37 + 1), "Big-Source " if i % 3 else "big_source") for i in range(300)] + [(1000 + i, "text " * 40, "small") for i in range(9)]
    docs += [(2000, None, "small"), (2001, "", "small"), (2002, "x", None), (2003, "x", "unlisted"), (1000, "text " * 40, "small")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big_source", 0.7, 1), ("small", 0.25, 3), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = M.mix(d, t, path=PATH, block=20)
    s = {r["source"]: r for r in shares.collect()}
    for name in ("big_source", "small"):
        assert abs(s[name]["mixed_tokens"] - s[name]["planned_tokens"]) <= 2 * 41
        assert s[name]["most_copies"] <= s[name]["max_repeats"]
    assert s["none"]["mixed_tokens"] == 0 and abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-9
    assert abs(s["big_source"]["actual_share"] - 0.7 / 0.95) < 0.03
    rows = chosen.collect()
    assert sum(r["tokens"] * r["copies"] for r in rows) == sum(r["mixed_tokens"] for r in s.values())
    assert not {2000, 2001, 2002, 2003} & {r["doc_id"] for r in rows}
    again, _ = M.mix(d, t, path=PATH, block=20)
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted(map(tuple, chosen.select("doc_id", "copies").collect()))
    for n in (1, 7):  # several blocks of a source, whatever the layout
        other, _ = M.mix(d.repartition(n), t, path=PATH, block=20)
        assert sorted(map(tuple, other.select("doc_id", "copies").collect())) == sorted(map(tuple, chosen.select("doc_id", "copies").collect()))
    nothing, _ = M.mix(d.limit(0), t, path=PATH)
    assert nothing.count() == 0
