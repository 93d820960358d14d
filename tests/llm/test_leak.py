import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm.leak import FMIndex, Items, Wavelet, find_leaks, leak_spans, leaks_in, plain_letters, reproduced, suffix_order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200), st.integers(0, 9), st.integers(0, 200))
def test_wavelet_rank(codes, code, at):
    at = min(at, len(codes))
    w = Wavelet(np.array(codes, np.uint32), 4)
    assert w.rank(np.array([code]), np.array([at]))[0] == codes[:at].count(code)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 14))
def test_backward_search_finds_every_occurrence(seed, depth):
    r = random.Random(seed)
    codes = [r.choice([1, 1, 2, 3, 0]) for _ in range(r.randint(depth, 300))] + [0]
    phrases = [codes[i : i + depth] for i in range(0, len(codes) - depth, 3)] + [[r.randint(1, 3) for _ in range(depth)] for _ in range(5)]
    phrases = [p for p in phrases if len(p) == depth and 0 not in p] or [[3] * depth]
    index = FMIndex(np.array(codes, np.uint32), depth % 5 + 1)
    which, at = index.locate(*index.search(np.array(phrases, np.uint32)))
    want = {(k, i) for k, p in enumerate(phrases) for i in range(len(codes) - depth + 1) if codes[i : i + depth] == p}
    assert sorted(zip(which.tolist(), at.tolist())) == sorted(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_suffixes_are_in_order(codes):
    want = sorted(range(len(codes)), key=lambda i: codes[i:])
    assert suffix_order(np.array(codes, np.uint32), 2).tolist() == want


def words(r, n):
    return " ".join("".join(chr(0xAC00 + r.randrange(4000)) for _ in range(r.randint(2, 4))) for _ in range(n))


def case():
    r = random.Random(11)
    items = [words(r, 60) for _ in range(4)]
    w = items[0].split()
    docs = {
        1: items[0], 2: words(r, 50) + " " + " ".join(w[:36]) + " " + words(r, 20), 3: " ".join(w[:10]) + words(r, 90), 4: words(r, 200),
        5: "\n".join([" ".join(w[:12]), words(r, 9), " ".join(w[20:34]), words(r, 8), " ".join(w[40:54])]),
        6: " ".join(x if k % 9 else "다른말" for k, x in enumerate(w)), 7: "".join(w).replace("가", "가,\n"), 8: "", 9: None, 10: items[1] + words(r, 5000) + items[2],
    }
    return items, docs, {(1, 0), (2, 0), (5, 0), (6, 0), (7, 0), (10, 1), (10, 2)}


def test_leaks_whatever_the_shard():
    items, docs, want = case()
    known = Items.of(list(range(4)), items)
    points, offsets = plain_letters(pa.array(list(docs.values()), pa.string()))
    for shard in (10**6, 3000, 400):
        assert {(d, int(i)) for d, i in leaks_in(list(docs), points, offsets, known, shard)} == want


def test_forms_are_disregarded():
    a, _ = plain_letters(pa.array(["Ａbc 가나.다"]))
    b, _ = plain_letters(pa.array(["ABC가" + chr(0x1102) + chr(0x1161) + "​ 다!"]))
    assert a.tolist() == b.tolist()


def test_reproduced():
    r = random.Random(2)
    item, _ = plain_letters(pa.array([words(r, 40)]))
    assert reproduced(item, item) == 1.0 and reproduced(item, item[:10]) == 0.0 and reproduced(item[:0], item) == 0.0
    half = item[: len(item) // 2]
    assert abs(reproduced(item, half) - len(half) / len(item)) < 1e-9


def test_frames(spark, got):
    items, docs, want = case()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    i = spark.createDataFrame([*enumerate(items), (90, None), (91, "짧다")], "item_id int, text string")
    assert set(got(find_leaks(d, i))) == want
    assert set(got(find_leaks(d, i, block=2))) == want
    assert got(find_leaks(d.limit(0), i)) == [] == got(find_leaks(d, i.limit(0)))


def test_spans_are_those_to_remove(spark, got):
    items, docs, want = case()
    d = spark.createDataFrame([(1, "앞말. " + items[0] + " 뒷말"), (2, "가".join(["x" * 40, items[1][: len(items[1]) * 2 // 3], items[2]]))], "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    spans = {(r.doc_id, r.item_id): (r.start, r.end, r.share) for r in leak_spans(d, i).collect()}
    text = {r.doc_id: r.text for r in d.collect()}
    assert set(spans) == {(1, 0), (2, 1), (2, 2)} and spans[1, 0][2] == 1.0
    assert [text[k[0]][a:b] for k, (a, b, _) in sorted(spans.items())][::2] == [items[0], items[2]]


def test_short_items_must_occur_whole():
    known = Items.of([1, 2, 3], ["아주짧음", "가", ""])
    points, offsets = plain_letters(pa.array(["이것은 아주 짧음!", "아주 짧", "가", None]))
    assert sorted(leaks_in([10, 11, 12, 13], points, offsets, known)) == [(10, 1), (12, 2)]
