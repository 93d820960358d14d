"""Per-document text statistics and the form of a document (prose, list, table, junk).

The statistics are taken over the code points of a whole Arrow batch: words, lines and
sentences are spans, sums over spans are differences of running totals, and words are
compared by a polynomial hash of their span. Gradient-boosted trees are trained on the
statistics of a bounded sample whose labels come from structural rules that are sure of
their case; their scores are calibrated on the hand-labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.leak import gathered
from lexmill.llm.normalize import SIZE, code_points

FORMS = ("prose", "list", "table", "junk")
STATISTICS = (
    "words", "mean_word", "symbols", "digits", "hangul", "latin", "foreign", "rare", "lines", "ended_lines", "mean_line", "common",
    "tabs", "bars", "commas", "semicolons", "colons", "gaps", "bullets", "even_lines", "field_lines", "distinct_words", "distinct_lines",
    "sentences", "endings", "codes", "numbers", "listed", "slashes", "long_words", "broken",
)
#: Rows of the training sample at most, and labelled rows used for calibration at most.
MAX_TRAIN, MAX_LABELLED = 20_000, 20_000

# Syllables that Korean predicates and particles end in, marks that open a list entry.
ENDINGS = "을를은는고며여다까임함음나요록면서"
FINALS = "다까요임음함"
BULLETS = "-*•▷○●■□▪◆◇※·▶►–—+◦‣"
BARS = "|│┃║"
DRAWN = (0x2500, 0x2580)
INSIDE = "·-./,:()「」『』%~&@_+'’" + '"'  # signs that stand inside a word in sound text

LETTERS = 600_000  # taken at once, which bounds the arrays held
MENU = 0.7  # share of new lines below which short lines are page furniture
WINDOW = 300  # words or lines within which a repetition counts, so that a long text is measured like a short one

_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def classes() -> dict[str, np.ndarray]:
    c = {k: np.zeros(SIZE, bool) for k in ("space", "digit", "hangul", "latin", "foreign", "rare", "letter", "ending", "bullet", "bar", "stop", "closing", "final", "odd")}
    c["space"][[9, 10, 11, 12, 13, 32, 0xA0, 0x3000, *range(0x2000, 0x200C)]] = True
    c["digit"][48:58] = True
    c["hangul"][0xAC00:0xD7A4] = True
    c["latin"][65:91] = c["latin"][97:123] = True
    c["foreign"][0x80:0xB7] = c["foreign"][0xB8:0x300] = c["foreign"][0xFFFD] = True
    c["foreign"][0x3131:0x318F] = True
    c["hangul"][0x1100:0x1200] = True  # decomposed syllables are text
    c["foreign"][:9] = c["foreign"][14:32] = True
    known = np.zeros(SIZE, bool)
    for i in range(0xAC00, 0xD7A4):
        known[i] = len(chr(i).encode("euc_kr")) == 2  # the other syllables take eight bytes
    c["rare"] = c["hangul"] & ~known
    c["rare"][0x1100:0x1200] = False
    c["letter"] = c["hangul"] | c["latin"]
    c["letter"][0x3040:0x3100] = c["letter"][0x4E00:0xA000] = True
    c["ending"][[ord(x) for x in ENDINGS]] = True
    c["bullet"][[ord(x) for x in BULLETS]] = True
    c["bar"][[ord(x) for x in BARS]] = True
    c["stop"][[ord(x) for x in ".?!。"]] = True
    c["final"][[ord(x) for x in FINALS]] = True
    c["odd"][33:0x3000] = True
    c["odd"][0xFF00:0x10000] = True
    c["odd"] &= ~(c["letter"] | c["digit"] | c["space"])
    c["odd"][DRAWN[0] : DRAWN[1]] = False
    c["odd"][[ord(x) for x in INSIDE]] = False
    c["closing"][[ord(x) for x in ".,?!:;)]」』\"'。"]] = True
    return c


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n + 1, inverse, np.uint64))


class Hasher:
    """Hashes of spans of one array of code points."""

    def __init__(self, points: np.ndarray) -> None:
        n = 1 << max(4, (len(points)).bit_length())
        up, self.down = _powers(n)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * up[: len(points)], dtype=np.uint64)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.down[a]


def word_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        p = np.array([ord(c) for c in w], np.uint64)
        out.append(Hasher(p).of(np.array([0]), np.array([len(p)]))[0])
    return np.sort(np.array(out, np.uint64))


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _spans(mask: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross the cuts (positions where a new text begins)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | cut[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _novelty(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Share of values that are new to each owner: 1 for a first one, for a repetition its distance from the last, as a part of WINDOW."""
    if not len(owner):
        return np.zeros(n)
    order = np.lexsort((np.arange(len(owner)), value, owner))
    again = (owner[order[1:]] == owner[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    new = np.ones(len(owner))
    new[order[1:][again]] = np.minimum(WINDOW, np.diff(order)[again]) / WINDOW
    return np.bincount(owner, new, minlength=n) / np.maximum(1, np.bincount(owner, minlength=n))


def statistics(texts: pa.Array, common: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; an empty or null text has zeros throughout."""
    c = classes()
    points, offsets = code_points(texts)
    n = len(offsets) - 1
    small = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint32)
    cut = np.zeros(len(points) + 1, bool)
    cut[offsets] = True
    chars = np.diff(offsets).astype(float)
    per = lambda x, by: np.divide(x, by, out=np.zeros(n), where=by > 0)

    def total(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate(([0], np.cumsum(mask)))
        return (s[offsets[1:]] - s[offsets[:-1]]).astype(float)

    space = c["space"][points]
    shown = chars - total(space)
    owner_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    counted = lambda at, weight=None: np.bincount(owner_of(at), weight, minlength=n).astype(float) if len(at) else np.zeros(n)
    out: dict[str, np.ndarray] = {}
    kinds = {k: c[k][points] for k in ("digit", "hangul", "latin", "foreign", "rare", "letter")}
    drawn = (points >= DRAWN[0]) & (points < DRAWN[1])
    out["symbols"] = per(shown - total(kinds["letter"]) - total(kinds["digit"]), shown)
    for name, k in (("digits", "digit"), ("hangul", "hangul"), ("latin", "latin"), ("foreign", "foreign")):
        out[name] = per(total(kinds[k]), shown)
    out["rare"] = per(total(kinds["rare"]), total(kinds["hangul"]))

    a, b = _spans(~space, cut)
    owner = owner_of(a)
    words = np.bincount(owner, minlength=n).astype(float) if len(a) else np.zeros(n)
    word_sum = lambda x: np.bincount(owner, x, minlength=n).astype(float) if len(a) else np.zeros(n)
    end = b.copy()
    for _ in range(3):
        end = np.where((end > a + 1) & c["closing"][points[np.maximum(end - 1, 0)]], end - 1, end)
    hasher = Hasher(small)
    hashes = hasher.of(a, end)
    out["words"], out["mean_word"] = words, per(word_sum((b - a).astype(float)), words)
    out["common"] = per(word_sum(_member(hashes, common).astype(float)), words)
    out["distinct_words"] = _novelty(owner, hashes, n)
    last = points[np.maximum(end - 1, 0)] if len(a) else points[:0]
    out["endings"] = per(word_sum((c["ending"][last] & (end - a >= 2)).astype(float)), words)
    running = np.concatenate(([0], np.cumsum(kinds["digit"]))), np.concatenate(([0], np.cumsum(kinds["latin"])))
    digits, latin = running[0][end] - running[0][a], running[1][end] - running[1][a]
    out["codes"] = per(word_sum(((end - a >= 6) & (digits >= 2) & (digits + latin == end - a)).astype(float)), words)
    out["numbers"] = per(word_sum((digits * 2 > end - a).astype(float)), words)

    out["long_words"] = per(word_sum(((b - a >= 25) & ((running[0][b] - running[0][a] + running[1][b] - running[1][a]) * 5 > (b - a) * 4)) * (b - a).astype(float)), shown)

    odd = np.concatenate(([0], np.cumsum(c["odd"][points])))
    out["broken"] = per(word_sum(((end - a >= 2) & (odd[np.maximum(end - 1, a)] > odd[np.minimum(a + 1, end)]) & (odd[np.maximum(end - 1, a)] - odd[np.minimum(a + 1, end)] > 0)).astype(float)), words)

    # Lines: runs between line ends that hold something other than blanks.
    la, lb = _spans(points != 10, cut)
    visible = np.concatenate(([0], np.cumsum(~space)))
    some = visible[lb] > visible[la]
    la, lb = la[some], lb[some]
    trail = np.maximum.accumulate(np.where(~space, np.arange(len(points)), -1)) if len(points) else np.zeros(0, np.int64)
    lead = np.minimum.accumulate(np.where(~space, np.arange(len(points)), len(points))[::-1])[::-1] if len(points) else trail
    first, final = lead[la] if len(la) else la, trail[lb - 1] if len(la) else la
    line_owner = owner_of(la)
    lines = np.bincount(line_owner, minlength=n).astype(float) if len(la) else np.zeros(n)
    line_sum = lambda x: np.bincount(line_owner, x, minlength=n).astype(float) if len(la) else np.zeros(n)
    ran = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    in_lines = lambda mask: (lambda s: s[lb] - s[la])(ran(mask))
    length = (final - first + 1).astype(float)
    out["lines"], out["mean_line"] = lines, per(line_sum(length), lines)
    out["ended_lines"] = per(line_sum(c["stop"][points[final]].astype(float)), lines)
    out["distinct_lines"] = _novelty(line_owner, hasher.of(first, final + 1), n)
    tab, bar, comma, semicolon = points == 9, c["bar"][points], (points == 44) | (points == 0x3001), points == 59
    gap_a, gap_b = _spans(points == 32, cut)
    gap = np.zeros(len(points), bool)
    gap[gap_a[gap_b - gap_a >= 2]] = True
    colon = np.zeros(len(points), bool)
    if len(points) > 1:
        colon[:-1] = (points[:-1] == 58) & space[1:]
    by_line = {k: in_lines(m) for k, m in (("tabs", tab), ("bars", bar), ("commas", comma), ("semicolons", semicolon), ("colons", colon), ("gaps", gap))}
    for k, v in by_line.items():
        out[k] = per(line_sum(v.astype(float)), lines)
    slash = np.isin(points, (47, 0xB7, 124))
    if len(points) > 2:
        slash[1:-1] &= space[:-2] & space[2:]
    slashes = in_lines(slash)
    out["slashes"] = per(line_sum(slashes.astype(float)), lines)
    long = np.maximum(length, 1)
    opening = points[first] if len(la) else points[:0]
    second = points[np.minimum(first + 1, len(points) - 1)] if len(la) else opening
    third = points[np.minimum(first + 2, len(points) - 1)] if len(la) else opening
    closes = lambda x: np.isin(x, (46, 41))
    numbered = (c["digit"][opening] | c["hangul"][opening]) & (closes(second) | (c["digit"][second] & closes(third)))
    ended = c["stop"][points[final]] if len(la) else np.zeros(0, bool)
    out["bullets"] = per(line_sum(((c["bullet"][opening] | numbered) & ~ended) * long), line_sum(long))

    # Sentences: from a line's begin or a sentence's end up to a full stop after a letter.
    stop = c["stop"][points]
    if len(points):
        before = kinds["letter"].copy()
        before[1:] |= space[1:] & kinds["letter"][:-1]  # a blank may precede the stop
        stop[1:] &= before[:-1]
        stop[0] = False
        following = np.concatenate((space[1:], [True])) | cut[1:]
        stop &= following
    sa, sb = _spans((points != 10) & ~np.concatenate(([False], stop[:-1])) if len(points) else stop, cut)
    # A span begins anew after each stop; the letter after a stop is a blank or the next text.
    ends_well = stop[sb - 1] if len(sa) else np.zeros(0, bool)
    wordy = ran(space)[sb] - ran(space)[sa] >= 3 if len(sa) else ends_well
    s_owner, s_len = owner_of(sa), (visible[sb] - visible[sa]).astype(float)
    if len(sa):  # a line may end in a predicate without a stop
        tail = np.maximum(trail[sb - 1], sa)
        ends_well = ends_well | (c["final"][points[tail]] & (s_len >= 20))
    good = ends_well & wordy & (s_len >= 12)
    s_sum = lambda x: np.bincount(s_owner, x, minlength=n).astype(float) if len(sa) else np.zeros(n)
    out["sentences"] = np.minimum(1.0, per(s_sum(s_len * good), shown))
    in_sentence = np.zeros(len(points) + 1, np.int64)
    if len(sa):
        np.add.at(in_sentence, sa[good], 1)
        np.add.at(in_sentence, sb[good], -1)
    loose = np.cumsum(in_sentence[:-1]) == 0
    loose_in = in_lines(loose & ~space)
    # Rows of a table hold the same number of separators as the line before or after.
    cells = by_line["tabs"] + by_line["bars"] + by_line["gaps"]
    even = np.zeros(len(la), bool)
    for v in (cells, by_line["commas"]):
        if len(la) > 1:
            same = (v[1:] == v[:-1]) & (v[1:] > 0) & (line_owner[1:] == line_owner[:-1])
            even[1:] |= same
            even[:-1] |= same
    even &= loose_in * 2 > in_lines(~space)
    out["even_lines"] = per(line_sum(even * long), line_sum(long))
    fields = (by_line["colons"] == 1) & (length <= 80) & ~ended
    out["field_lines"] = per(line_sum(fields * long), line_sum(long))
    parts = (by_line["commas"] + by_line["semicolons"] + slashes >= 4) & (loose_in * 2 > in_lines(~space)) & ~even
    plain = (length <= 60) & ~ended & ~even & ~fields
    out["listed"] = per(line_sum((parts | plain) * long), line_sum(long))
    out["foreign"] = np.maximum(out["foreign"], 0.0)
    out["symbols"] = out["symbols"] - 0.5 * per(total(drawn), shown)
    return np.column_stack([out[k] for k in STATISTICS]) if n else np.zeros((0, len(STATISTICS)))


def weak_forms(x: np.ndarray) -> np.ndarray:
    """Form by structural rules that are sure of their case, as an index into FORMS; -1 if none is."""
    s = {k: x[:, i] for i, k in enumerate(STATISTICS)}
    out = np.full(len(x), -1)
    loose = s["sentences"] < 0.4
    out[(s["sentences"] >= 0.55) & (s["foreign"] < 0.1) & (s["broken"] < 0.1)] = 0
    out[(s["endings"] >= 0.3) & (s["foreign"] < 0.1) & (s["distinct_words"] > 0.25) & (s["words"] >= 8) & (s["even_lines"] < 0.2) & (s["field_lines"] < 0.2) & (s["bullets"] < 0.2) & (s["broken"] < 0.1)] = 0
    listed = loose & (s["bullets"] + s["listed"] >= 0.6) & (s["endings"] < 0.15) & (s["distinct_lines"] > 0.4)
    out[listed & (s["even_lines"] < 0.3) & (s["field_lines"] < 0.3)] = 1
    out[loose & (s["even_lines"] >= 0.5) & (s["lines"] >= 3)] = 2
    out[loose & (s["field_lines"] >= 0.5) & (s["lines"] >= 3)] = 2
    noise = (s["foreign"] > 0.3) | (s["symbols"] > 0.6) | (s["rare"] > 0.1) | ((s["codes"] > 0.25) & (s["endings"] < 0.1)) | (s["long_words"] > 0.5) | ((s["broken"] > 0.25) & (s["even_lines"] < 0.3))
    over = (s["distinct_words"] < 0.15) & (s["words"] >= 12) & (s["numbers"] < 0.2) & (s["even_lines"] < 0.3) & (s["field_lines"] < 0.3)
    # Entries of a list are named once; the same few short lines again and again are page furniture.
    menu = loose & (s["listed"] >= 0.6) & (s["bullets"] < 0.3) & (s["endings"] < 0.15) & (s["lines"] >= 8) & (s["distinct_lines"] < MENU) & (s["even_lines"] < 0.3) & (s["field_lines"] < 0.3)
    out[noise | over | menu] = 3
    out[s["words"] == 0] = -1
    return out


@dataclass
class Boosted:
    """Gradient-boosted trees for several classes, as flat arrays, with calibrated scores."""

    edges: list[np.ndarray]
    trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # class, feature, bin, value of each node
    depth: int
    prior: np.ndarray
    scale: float = 1.0
    shift: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.int32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.tile(self.prior, (len(x), 1))
        rows = np.arange(len(x))
        for k, feature, at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > at[node])
            out[:, k] += value[node]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x) * self.scale + (0 if self.shift is None else self.shift)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 1.0, n_bins: int = 32) -> Boosted:
    """Second-order boosting of complete trees of one depth on binned statistics (softmax loss)."""
    n, m = x.shape
    classes_ = len(FORMS)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(m)]
    count = np.bincount(y, minlength=classes_)
    model = Boosted(edges, [], depth, np.log((count + 1) / (n + classes_)))
    b = model.bins(x)
    weight = (n / (classes_ * np.maximum(count, 1)))[y] ** 0.5  # rare forms count more
    z = np.tile(model.prior, (n, 1))
    flat = (b + np.arange(m) * n_bins).ravel()
    for _ in range(rounds):
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k in range(classes_):
            if not count[k]:
                continue
            g, h = weight * (p[:, k] - (y == k)), weight * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            node = np.zeros(n, np.int64)
            size = 2 ** (depth + 1) - 1
            feature, at, value = np.zeros(size, np.int64), np.full(size, n_bins, np.int64), np.zeros(size)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                key = np.repeat((node - first) * (m * n_bins), m) + flat
                gs = np.bincount(key, np.repeat(g, m), minlength=width * m * n_bins).reshape(width, m, n_bins).cumsum(axis=2)
                hs = np.bincount(key, np.repeat(h, m), minlength=width * m * n_bins).reshape(width, m, n_bins).cumsum(axis=2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                best = gain.reshape(width, -1).argmax(axis=1)
                use = gain.reshape(width, -1).max(axis=1) > 1e-6
                feature[first : first + width] = np.where(use, best // n_bins, 0)
                at[first : first + width] = np.where(use, best % n_bins, n_bins)
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > at[node])
            first = 2**depth - 1
            gs, hs = np.bincount(node - first, g, minlength=2**depth), np.bincount(node - first, h, minlength=2**depth)
            value[first:] = -rate * gs / (hs + penalty)
            z[:, k] += value[node]
            model.trees.append((k, feature, at, value))
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
    """One scale and one shift per class by log loss on hand-labelled documents (a few wrong labels are expected)."""
    if not len(y):
        return model
    z = model.scores(x)
    scale, shift, one = 1.0, np.zeros(len(FORMS)), np.eye(len(FORMS))[y]
    for _ in range(steps):
        p = np.exp(z * scale + shift - (z * scale + shift).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - one) / len(y)
        scale = max(0.05, scale - 0.05 * float((d * z).sum()))
        shift -= 0.5 * (d.sum(axis=0) + 0.01 * shift / len(FORMS))
    model.scale, model.shift = scale, shift
    return model


def _common(words: DataFrame) -> np.ndarray:
    """Hashes of the common words, a table of fixed size."""
    return word_hashes(sorted({r[0].lower() for r in words.select("word").where("word IS NOT NULL AND word != ''").distinct().collect()}))


def document_statistics(documents: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one double column per statistic; one row per row of ``documents``.

    A null or empty text gives zeros. The whole text is read. Narrow; no shuffle.
    """
    common = _common(words)
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"{k} double" for k in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in gathered(batches, LETTERS):
            x = statistics(texts, common)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", *STATISTICS])

    return documents.select(doc_id, text).mapInArrow(run, schema)


def fit_forms(documents: DataFrame, labels: DataFrame, words: DataFrame, max_train: int = MAX_TRAIN, max_labelled: int = MAX_LABELLED) -> Boosted:
    """Trees trained on a bounded hash sample with weak labels, calibrated on hand labels held out from it.

    At most about ``max_train`` documents are sampled by hash of doc_id, and at most
    ``max_labelled`` labelled ones; both come to the driver as rows of statistics. No
    labelled document is in the sample. A document labelled in several ways counts once
    for each.
    """
    total = documents.count()
    every = max(1, -(-total // max_train))
    known = labels.where(F.col("form").isin(*FORMS)).select("doc_id", "form").distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "form").limit(max_labelled)
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) if every > 1 else documents
    sample = sample.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_anti")  # max_labelled ids at most
    stats = document_statistics(sample, words)
    got = stats.limit(2 * max_train).toPandas()
    x = got[list(STATISTICS)].to_numpy(float)
    y = weak_forms(x)
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")  # the same model whatever the order of rows
    x, y = x[order], y[order]
    model = train_boosted(x[y >= 0], y[y >= 0]) if (y >= 0).any() else Boosted([np.zeros(0)] * len(STATISTICS), [], 3, np.zeros(len(FORMS)))
    held = document_statistics(documents.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi"), words).join(F.broadcast(known), "doc_id").orderBy("doc_id", "form").toPandas()
    return calibrate(model, held[list(STATISTICS)].to_numpy(float), np.array([FORMS.index(f) for f in held["form"]], int))


def document_forms(documents: DataFrame, labels: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, form, probability) of every document; a document without any word is prose by default of the trees' prior."""
    model = fit_forms(documents, labels, words)
    common = _common(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in gathered(batches, LETTERS):
            x = statistics(texts, common)
            p = model.probabilities(x)
            best = p.argmax(axis=1)
            best[x[:, 0] == 0] = 0
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([FORMS[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best])], ["doc_id", "form", "probability"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, form string, probability double")
