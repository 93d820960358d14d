import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm.normalize import normalize_batch, normalize_text

LIKE = {"А": "A", "Ѕ": "S", "Ι": "I", "ㆍ": "·", "・": "·", "•": "·"}
PIECES = [*"가각힣법률abcXYZ0129 「」㎡℃Ⅱ①※、。(（）)．Ａ９", *LIKE, " ", "　", "ㅤ", "​", "­", "﻿", "金", chr(0xF90A), "e" + chr(0x301), unicodedata.normalize("NFD", "한글"), "\n"]


def brute(text):
    """One character at a time: what each stands for, then composition."""
    out = []
    for c in text:
        o = ord(c)
        if o in (0x200B, 0xAD, 0xFEFF):
            continue
        if c in LIKE:
            c = LIKE[c]
        elif o in (0xA0, 0x3000, 0x3164):
            c = " "
        elif 0xFF01 <= o <= 0xFF5E or 0xF900 <= o <= 0xFAFF:
            c = unicodedata.normalize("NFKC", c)
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**9))
def test_equals_character_by_character(seed):
    r = random.Random(seed)
    texts = ["".join(p for p in r.choices(PIECES, k=r.randint(0, 12)) if p.upper() not in ("O", "I")) for _ in range(8)] + [None, ""]
    plain, found = normalize_batch(pa.array(texts, pa.string()))
    want = [None if t is None else brute(t) for t in texts]
    for t, w, p, f in zip(texts, want, plain.to_pylist(), found.tolist()):
        if t is None or not any(a.isascii() and a.isalnum() and b.isascii() and b.isalnum() for a, b in zip(w, w[1:])):  # stand-ins among letters and digits are tested below
            assert p == w
            if t is not None and w != t:
                assert f


def test_slices_and_rows_do_not_mix():
    parts = chr(0x1100), chr(0x1161), chr(0x11A8)
    a = pa.array(["x", parts[0], parts[1] + "y", None, "ᄀ​ᅡ" + parts[2]])
    plain, found = normalize_batch(a.slice(1))
    assert plain.to_pylist() == [parts[0], parts[1] + "y", None, "각"] and found.tolist() == [True, True, False, True]


def test_references():
    plain, found = normalize_batch(pa.array(["a&#x3000;b&#65313;&amp;&lt;", "<![CDATA[&#x3000;]]>&#x3000;", "&#xZZ; &# &#x3000", "&#60;&#38;"]))
    assert plain.to_pylist() == ["a bA&amp;&lt;", "<![CDATA[&#x3000;]]> ", "&#xZZ; &# &#x3000", "&#60;&#38;"]
    assert found.tolist() == [True, True, False, False]


def test_ascii_stand_ins():
    texts = ["제l조", "제1O조의2", "제l9조", "제3조제I항", "CCTV", "ESG I동", "GlS", "Al상담", "IO", "10-1", "a1", "B1층", "G20", "제10조", "G1S"]
    plain, found = normalize_batch(pa.array(texts))
    assert plain.to_pylist()[:4] == ["제1조", "제10조의2", "제19조", "제3조제1항"] and found.tolist()[:4] == [True] * 4
    assert plain.to_pylist()[4] == "CCTV" and plain.to_pylist()[6:8] == ["GIS", "AI상담"]
    assert plain.to_pylist()[9:11] == ["10-1", "a1"] and not any(found.tolist()[i] for i in (4, 5, 8, 9, 10, 11, 12, 13)) and found[14]


def test_frame(spark, got):
    df = spark.createDataFrame([("1", "제１조"), ("2", None), ("3", ""), ("4", "가" * 50000 + "　")], "id string, text string")
    out = got(normalize_text(df, "text", ["id"]))
    assert [(i, t if t is None or len(t) < 9 else t[-1], f) for i, t, f in out] == [("1", "제1조", True), ("2", None, False), ("3", "", False), ("4", " ", True)]
    assert got(normalize_text(df.limit(0), "text", ["id"])) == []


def test_open_cdata_ends_with_its_row():
    plain, found = normalize_batch(pa.array(["<![CDATA[&#x3000;", "a&#x3000;b", None, "x<![CDATA[y", "&#x3000;", "<![CDA", "TA[&#x3000;"]))
    assert plain.to_pylist() == ["<![CDATA[&#x3000;", "a b", None, "x<![CDATA[y", " ", "<![CDA", "TA[ "]
    assert found.tolist() == [False, True, False, False, True, False, True]


def test_composed_and_decomposed_text_is_one_text_in_every_script():
    chars = [chr(c) for c in range(0xA0, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != unicodedata.normalize("NFD", chr(c))]
    as_is, composed, apart = (normalize_batch(pa.array([f(c) for c in chars]))[0].to_pylist() for f in (str, lambda c: unicodedata.normalize("NFC", c), lambda c: unicodedata.normalize("NFD", c)))
    assert as_is == composed == apart


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_any_number_of_marks_in_any_order(seed):
    r = random.Random(seed)
    marks = [chr(c) for c in (*range(0x300, 0x34F), *range(0x350, 0x370), 0x5B0, 0x64B, 0x654, 0x3099, 0x93C, 0x9BE)]
    texts = ["".join(r.choice("abeouéâबকか") + "".join(r.choices(marks, k=r.randint(0, 7))) for _ in range(r.randint(1, 4))) for _ in range(50)]
    assert normalize_batch(pa.array(texts))[0].to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_look_alikes_in_words_of_their_own_stay():
    texts = ["Москва", "Москва시", "АB12", "제А호", "ЖабА", "СССР", "Αθήνα"]
    plain, found = normalize_batch(pa.array(texts))
    assert plain.to_pylist() == ["Москва", "Москва시", "AB12", "제A호", "ЖабА", "CCCP", "Αθήνα"]
    assert found.tolist() == [False, False, True, True, False, True, False]


def test_references_of_any_length():
    plain, found = normalize_batch(pa.array(["&#x0000AC00;&#000000000000044032;", "&#65;&#xFF21;&#x1100;&#x1161;", "&#;&#x;&#", "&#xAC00 &#99999999;"]))
    assert plain.to_pylist() == ["가가", "AA가", "&#;&#x;&#", "&#xAC00 &#99999999;"] and found.tolist() == [False, True, False, False]
