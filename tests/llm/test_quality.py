import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import quality as Q

AT = {k: i for i, k in enumerate(Q.STATISTICS)}
COMMON = ["the", "및", "또는"]
PIECES = ["the", "The,", "및", "또는.", "가나다", "x1", "12,3", "-", "\n", "\n\n", "다.", "끝났다.", "…", "  ", "\t", "법은"]


def novelty(values):
    last, new = {}, []
    for k, v in enumerate(values):
        new.append(min(Q.WINDOW, k - last[v]) / Q.WINDOW if v in last else 1)
        last[v] = k
    return sum(new) / max(1, len(new))


def brute(t):
    words = t.split()
    shown = "".join(t.split())
    lines = [x.strip() for x in t.split("\n") if x.strip()]
    bare = [re.sub(r"""[.,?!:;)\]」』"'。]{1,3}$""", "", w) if len(w) > 1 else w for w in words]
    n = max(1, len(words))
    letters = sum(c.isalpha() for c in shown)
    return {
        "words": len(words), "mean_word": sum(map(len, words)) / n, "lines": len(lines), "ended_lines": sum(x[-1] in ".?!。" for x in lines) / max(1, len(lines)),
        "common": sum(w.lower() in COMMON for w in bare) / n, "symbols": (len(shown) - letters - sum(c.isdigit() for c in shown)) / max(1, len(shown)), "digits": sum(c.isdigit() for c in shown) / max(1, len(shown)),
        "distinct_words": novelty([w.lower() for w in bare]), "distinct_lines": novelty([x.lower() for x in lines]),
    }


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9))
def test_statistics_equal_brute_force(seed):
    r = random.Random(seed)
    texts = [" ".join(r.choices(PIECES, k=r.randint(0, 25))) for _ in range(6)] + [None, "", " \n "]
    x = Q.statistics(pa.array(texts, pa.string()), Q.word_hashes(sorted(COMMON)))
    for i, t in enumerate(texts):
        want = brute(t or "") if (t or "").strip() else {k: 0 for k in ("words", "lines", "common", "symbols")}
        for k, v in want.items():
            assert abs(x[i, AT[k]] - v) < 1e-9, (k, t, x[i, AT[k]], v)


PROSE = "시장은 매년 시행계획을 세우고 그 결과를 지체 없이 알려야 한다. 위원회는 이를 검토하여 필요한 조치를 명할 수 있다. "
CASES = {
    "prose": [PROSE * 3, "○위원장 네, 답변드리겠습니다. " + PROSE * 2, PROSE + "\n| 가 | 1 | 나 |\n| 다 | 2 | 라 |", "1. " + PROSE + "\n2. " + PROSE],
    "list": ["\n".join(f"- {w} {i}부" for i, w in enumerate("안내도 회의록 수료증 평가표 신청서 협약서 공고문 자재".split())), "붙임\n" + "; ".join(f"{w} (제{i}조)" for i, w in enumerate("안내도 회의록 수료증 평가표 신청서 협약서 공고문".split()))],
    "table": ["\n".join(["부서,금액,구분", *(f"도로과,{i * 37},{w}" for i, w in enumerate("안내도 회의록 수료증 평가표 신청서".split()))]), "\n".join(f"{k} : {v}" for i in range(5) for k, v in (("부서", "도로과"), ("금액", i * 97), ("비고", "신규"))), "\n".join(f"| {i} | 도로과 | {i * 11} |" for i in range(8))],
    "junk": ["ㅁㄴㅇㄹ ㅂㅈㄷㄱ ㅋㅌㅊ " * 20, "êµ°ì ë§¤ë ì¹ ì§ ì¬ì " * 20, "광고 클릭\n" * 30, "로그인\n검색\n목록\n닫기\n메뉴 열기\n이전글\n다음글\n인쇄\n목록\n로그인\n검색", "^^^^ ****\n++++ ====\n" * 10, "a9F3kQz8" * 40],
}


def sample(n=240):
    r = random.Random(1)
    out = []
    for i in range(n):
        form = r.choice(list(CASES))
        out.append((i, r.choice(CASES[form]).replace("안내도", r.choice(["전시물", "안내도", "증빙서류"])), form))
    return out


def test_weak_labels_and_trees():
    rows = sample()
    x = Q.statistics(pa.array([t for _, t, _ in rows]), Q.word_hashes(["한다"]))
    y = np.array([Q.FORMS.index(f) for _, _, f in rows])
    weak = Q.weak_forms(x)
    assert (weak[weak >= 0] == y[weak >= 0]).mean() > 0.97 and (weak >= 0).mean() > 0.8
    model = Q.train_boosted(x[:120], y[:120])
    p = model.probabilities(x[120:])
    assert (p.argmax(1) == y[120:]).mean() > 0.95 and np.allclose(p.sum(1), 1)
    wrong = y[:120].copy()
    wrong[:12] = 0
    before = -np.log(model.probabilities(x[:120])[np.arange(120), wrong] + 1e-12).mean()
    Q.calibrate(model, x[:120], wrong)
    assert -np.log(model.probabilities(x[:120])[np.arange(120), wrong] + 1e-12).mean() <= before + 1e-9


def long_prose():
    """Sentences of one pattern whose words change, as long as a book chapter."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("가나다라마바사아자차카타파하고노도로모보소오조초") for _ in range(3))
    return " ".join(f"{word()}은 {word()}를 {word()}에 {word()}하여 {word()}을 지체 없이 {word()}하여야 한다." for _ in range(1500))


def test_frames(spark, got):
    rows = sample()
    again = "".join(PROSE.replace("결과", f"{w}{v} 결과") for w in "가나다라마바사아자차" for v in "거너더러머버서어저처커터퍼허" for _ in range(20))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, long_prose(), "x"), (904, again, "x"), (905, PROSE * 20, "x"), (903, PROSE * 3000, "x")], "doc_id long, text string, form string")
    labels = spark.createDataFrame([(i, f, "a") for i, _, f in rows[:80]] + [(0, "junk", "b"), (5, None, "c")], "doc_id long, form string, annotator string")
    words = spark.createDataFrame([("ko", "한다"), (None, None)], "lang string, word string")
    out = {r[0]: r[1] for r in got(Q.document_forms(docs, labels, words))}
    assert len(out) == 246 and out[902] == "prose" and out[900] == "prose"
    assert out[903] == out[904] == out[905] == "junk"  # the same sentences over and over, at any length
    assert np.mean([out[i] == f for i, _, f in rows]) > 0.95
    assert got(Q.document_statistics(docs.limit(0), words)) == []
    assert got(Q.document_forms(docs.limit(0), labels, words)) == []
