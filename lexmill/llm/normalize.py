"""One consistent form for text that looks the same but is made of other characters.

A whole Arrow batch is copied into one array of code points. Lookup tables are
gathered over it (class, replacement, length of the expansion), deletions and
expansions move the row offsets, and Hangul and accents are put in order and composed by
array arithmetic on neighbouring code points. No string function is called per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ԍ": "G", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ԁ": "D", "Ь": "b",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ι": "i", "Տ": "S", "Ս": "U", "Օ": "O", "օ": "o", "ս": "u", "ց": "g", "հ": "h",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z", "Ꭰ": "D", "Ꮢ": "R", "Ꭵ": "i",
    "ɡ": "g", "ı": "i", "ɑ": "a", "ǀ": "l", "ℓ": "l",
}
# The blocks of the scripts whose letters may look like Latin ones.
SCRIPTS = {"Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F)), "Armenian": ((0x530, 0x58F),), "Cherokee": ((0x13A0, 0x13FF),)}
# Dots that stand in for the middle dot, strokes and points that stand in for an ASCII sign.
MIDDLE_DOTS = "ㆍ・･•‧ᆞ∙⋅·ᐧ⸱⸳ꞏ𐄁᛫⦁"
SIGNS = {"‐": "-", "‑": "-", "−": "-", "˗": "-", "⁃": "-", "․": ".", "∕": "/", "⁄": "/", "∶": ":", "ː": ":", "꞉": ":", "‚": ",", "∼": "~", "˜": "~", "ʼ": "'", "ʹ": "'", "′": "'", "❘": "|", "∣": "|", "；": ";", "ǃ": "!"}
# Code points that are drawn as a blank, and ranges that are not drawn at all.
FILLERS = (0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800, 0x0085, 0x2028, 0x2029)
INVISIBLE = ((0xAD, 0xAD), (0x034F, 0x034F), (0x061C, 0x061C), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF))
# Ranges of compatibility forms whose plain form Unicode's own tables give.
COMPATIBLE = ((0xF900, 0xFAFF), (0x2F800, 0x2FA1F), (0x2F00, 0x2FD5), (0xFF01, 0xFF9F), (0xFFA1, 0xFFEE), (0xFE30, 0xFE6F), (0x1D400, 0x1D7FF), (0xFB00, 0xFB06), (0x2126, 0x2126), (0x212A, 0x212B))

L, V, T = 0x1100, 0x1161, 0x11A7  # first consonant, first vowel, one before the first final
SYLLABLE = 0xAC00
CONJOINING = ((0x1100, 0x11FF), (0xA960, 0xA97C), (0xD7B0, 0xD7FB))
MARKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0), (0xFE20, 0xFE2F), (0x3099, 0x309A))
SIZE = 0x110000


class Tables:
    """Lookup tables over all code points, built from the fixed values and Unicode's data."""

    def __init__(self) -> None:
        self.odd = np.zeros(SIZE, bool)  # not the plain form
        self.to = np.arange(SIZE, dtype=np.uint32)
        self.length = np.ones(SIZE, np.uint8)
        extra: list[int] = []
        self.extra_at = np.zeros(SIZE, np.uint32)
        for a, b in (*CONJOINING, *MARKS):
            self.odd[a : b + 1] = True
        for a, b in INVISIBLE:
            self.odd[a : b + 1] = True
            self.length[a : b + 1] = 0
        replaced = {ord(a): b for a, b in (LOOKALIKES | SIGNS).items()} | {ord(c): "·" for c in MIDDLE_DOTS if c != "·"} | {c: " " for c in FILLERS}
        for c in range(0x80, 0x3001):
            if unicodedata.category(chr(c)) == "Zs":
                replaced[c] = " "
        for a, b in COMPATIBLE:
            for c in range(a, b + 1):
                plain = unicodedata.normalize("NFKC", chr(c))
                if c not in replaced and plain != chr(c):
                    replaced[c] = plain
        replaced |= {ord("･"): "·", ord("・"): "·"}
        self.mark_class = np.zeros(SIZE, np.uint8)  # canonical order of marks
        full: dict[int, str] = {}
        pairs: dict[int, int] = {}
        for c in range(0xC0, 0x30000):
            if SYLLABLE <= c < SYLLABLE + 11172 or 0xD800 <= c < 0xE000:
                continue
            char = chr(c)
            self.mark_class[c] = unicodedata.combining(char)
            apart = unicodedata.decomposition(char)
            if not apart or apart[0] == "<":
                continue
            full[c] = unicodedata.normalize("NFD", char)
            composed = unicodedata.normalize("NFC", char)
            if composed == char:
                if len(d := apart.split()) == 2:
                    pairs[int(d[0], 16) << 32 | int(d[1], 16)] = c
            elif c not in replaced:
                replaced[c] = composed
        for c, plain in replaced.items():
            self.odd[c] = True
            self.length[c] = len(plain)
            if len(plain) == 1:
                self.to[c] = ord(plain)
            else:
                self.extra_at[c] = len(extra)
                extra += map(ord, plain)
        self.extra = np.array(extra or [0], np.uint32)
        self.pair_keys = np.array(sorted(pairs), np.uint64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.follows = self.mark_class > 0  # may be composed with what precedes it
        self.follows[[k & 0xFFFFFFFF for k in pairs]] = True
        for a, b in CONJOINING:
            self.follows[a : b + 1] = False  # composed by arithmetic
        self.apart = np.ones(SIZE, np.uint8)  # length of the full decomposition
        self.apart_at = np.zeros(SIZE, np.uint32)
        parts: list[int] = []
        for c, text in full.items():
            self.apart[c], self.apart_at[c] = len(text), len(parts)
            parts += map(ord, text)
        self.parts = np.array(parts, np.uint32)
        self.script = np.zeros(SIZE, np.uint8)  # of letters that may stand in for Latin ones, 1 for Latin and digits
        for k, name in enumerate(SCRIPTS, 2):
            for a, b in SCRIPTS[name]:
                for c in range(a, b + 1):
                    if unicodedata.category(chr(c))[0] == "L":
                        self.script[c] = k
        for a, b in ((48, 57), (65, 90), (97, 122), (0xC0, 0x24F)):
            self.script[a : b + 1] = 1
        self.letter = self.script > 0
        for a, b in ((0x300, 0x36F), (0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97C), (0x3400, 0x9FFF), (0xAC00, 0xD7FB), (0x3040, 0x30FF)):
            self.letter[a : b + 1] = True
        self.look = np.zeros(SIZE, bool)
        self.look[[ord(c) for c in LOOKALIKES]] = True


@cache
def tables() -> Tables:
    return Tables()


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array and the offset of each row (nulls are empty)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = (memoryview(data)[offsets[0] : offsets[-1]] if data is not None and len(texts) else memoryview(b"")).tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return points, lead[offsets - offsets[0]] if len(texts) else np.zeros(1, np.int64)


def to_strings(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    raw = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))[offsets]
    bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(valid), [bits, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)])


def _shifted(offsets: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(keep)))[offsets]


def _inside(points: np.ndarray, offsets: np.ndarray, opening: str, closing: str) -> np.ndarray:
    """Whether each position lies after an opening string and before the next closing one or the end of its row."""
    def at(s: str) -> np.ndarray:
        n = len(points) - len(s) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        first = np.flatnonzero(points[:n] == ord(s[0]))
        for k, c in enumerate(s[1:], 1):
            first = first[points[first + k] == ord(c)]
        return first

    depth = np.zeros(len(points) + 1, np.int64)
    opened, closed = at(opening), at(closing)
    row_end = offsets[np.searchsorted(offsets, opened, "right")]
    opened, row_end = opened[opened + len(opening) <= row_end], row_end[opened + len(opening) <= row_end]
    if not len(opened):
        return depth[:-1].astype(bool)
    following = np.searchsorted(closed, opened)
    ends = np.where(following < len(closed), closed[np.minimum(following, len(closed) - 1)] if len(closed) else len(points), len(points))
    np.add.at(depth, opened, 1)
    np.add.at(depth, np.minimum(ends, row_end), -1)
    return np.cumsum(depth[:-1]) > 0


def resolve_references(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numeric character references as the characters they stand for, outside CDATA.

    References to markup and ASCII control characters stay, so XML stays XML.
    """
    at = np.flatnonzero(points[:-1] == 38) if len(points) > 1 else np.zeros(0, np.int64)
    at = at[points[at + 1] == 35]
    if not len(at):
        return points, offsets
    padded = np.concatenate((points, np.zeros(12, np.uint32)))
    at = at[~_inside(points, offsets, "<![CDATA[", "]]>")[at]]
    is_hex = (padded[at + 2] | 32) == 120
    from_ = at + 2 + is_hex
    # Where digits end and where zeros end, looked up among the characters that are none.
    low = padded | 32
    no_digit = np.flatnonzero((padded < 48) | (padded > 57))
    no_hex = np.flatnonzero(((padded < 48) | (padded > 57)) & ((low < 97) | (low > 102)))
    no_zero = np.flatnonzero(padded != 48)
    end = np.where(is_hex, no_hex[np.searchsorted(no_hex, from_)], no_digit[np.searchsorted(no_digit, from_)])
    significant = np.minimum(no_zero[np.searchsorted(no_zero, from_)], end)
    value = np.zeros(len(at), np.int64)
    for step in range(7):  # no character needs more digits
        pos = significant + step
        c = padded[np.minimum(pos, len(padded) - 1)].astype(np.int64)
        digit = np.where(c <= 57, c - 48, (c | 32) - 87)
        value = np.where(pos < end, value * np.where(is_hex, 16, 10) + digit, value)
    row_end = offsets[np.searchsorted(offsets, at, "right")]
    fine = (padded[end] == 59) & (end > from_) & (end - significant <= 7) & (end < row_end) & (value > 62) & (value < SIZE) & ((value < 0xD800) | (value > 0xDFFF))
    if not fine.any():
        return points, offsets
    at, end, value = at[fine], end[fine], value[fine]
    points = points.copy()
    points[at] = value
    cut = np.zeros(len(points) + 1, np.int64)
    np.add.at(cut, at + 1, 1)
    np.add.at(cut, end + 1, -1)
    keep = np.cumsum(cut[:-1]) == 0
    return points[keep], _shifted(offsets, keep)


def _merge(points: np.ndarray, offsets: np.ndarray, along: list[np.ndarray], hit: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``new`` at the places ``hit``, without what follows them."""
    points = points.copy()
    points[hit] = new
    keep = np.ones(len(points), bool)
    keep[hit + 1] = False
    return points[keep], _shifted(offsets, keep), [x[keep] for x in along]


def compose(points: np.ndarray, offsets: np.ndarray, t: Tables, *along: np.ndarray) -> tuple[np.ndarray, ...]:
    """Conjoining Hangul and bases with their marks as one code point each; arrays given ``along`` keep the entry of the first part."""
    rest = list(along)

    def neighbours(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        same_row = np.ones(max(len(points) - 1, 0), bool)
        inner = offsets[(offsets > 0) & (offsets < len(points))]
        same_row[inner - 1] = False
        return points[:-1], points[1:], same_row

    if ((points >= L) & (points < L + 19)).any():
        a, b, same = neighbours(points, offsets)
        hit = np.flatnonzero(same & (a - np.uint32(L) < 19) & (b - np.uint32(V) < 21))
        points, offsets, rest = _merge(points, offsets, rest, hit, SYLLABLE + ((points[hit] - L) * 21 + points[hit + 1] - V) * 28)
    if ((points > T) & (points <= T + 27)).any():
        a, b, same = neighbours(points, offsets)
        hit = np.flatnonzero(same & (a - np.uint32(SYLLABLE) < 11172) & ((a - np.uint32(SYLLABLE)) % 28 == 0) & (b - np.uint32(T + 1) < 27))
        points, offsets, rest = _merge(points, offsets, rest, hit, points[hit] + points[hit + 1] - T)
    if t.follows[points].any():
        points, offsets, rest = _compose_marks(points, offsets, rest, t)
    return points, offsets, *rest


def _compose_marks(points: np.ndarray, offsets: np.ndarray, rest: list[np.ndarray], t: Tables) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bases with any number of marks: taken apart, marks ordered by class, composed again mark by mark over all sequences at once."""
    # What is touched: characters that follow, and the one before the first of them in its row.
    begins = np.zeros(len(points) + 1, bool)
    begins[offsets] = True
    follows = t.follows[points]
    touched = follows.copy()
    touched[:-1] |= follows[1:] & ~begins[1:-1]
    length = np.where(touched, t.apart[points], 1).astype(np.int64)
    source = np.repeat(np.arange(len(points)), length)
    within = np.arange(len(source)) - np.repeat(np.cumsum(length) - length, length)
    split = (length > 1)[source]
    out = points[source]
    out[split] = t.parts[t.apart_at[points[source[split]]] + within[split]]
    offsets = np.concatenate(([0], np.cumsum(length)))[offsets]
    rest = [x[source] for x in rest]
    begins = np.zeros(len(out) + 1, bool)
    begins[offsets] = True
    mark = t.mark_class[out]
    # Marks of one run are put in the order of their classes; the order of equal ones stays.
    run = np.cumsum((mark == 0) | begins[:-1])
    loose = np.flatnonzero(mark > 0)
    if len(loose):
        by = np.lexsort((loose, mark[loose], run[loose]))
        out[loose], rest = out[loose[by]], [_moved(x, loose, loose[by]) for x in rest]
        mark = t.mark_class[out]
    follows = t.follows[out] & ~begins[:-1]
    head = np.flatnonzero(~follows)
    size = np.diff(np.concatenate((head, [len(out)])))
    head, size = head[size > 1], size[size > 1]
    base, last = head.copy(), np.full(len(head), -1)  # where the base stands; class of the last mark left, -1 for none
    keep = np.ones(len(out), bool)
    k = 1
    while len(head):
        at = head + k
        c = mark[at].astype(np.int64)
        keys = out[base].astype(np.uint64) << np.uint64(32) | out[at].astype(np.uint64)
        where = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
        joins = (t.pair_keys[where] == keys) & ((last < c) | (last == -1)) & (mark[base] == 0)
        out[base[joins]] = t.pair_to[where[joins]]
        keep[at[joins]] = False
        new = ~joins & (c == 0)
        base[new], last[new] = at[new], -1
        left = ~joins & (c > 0)
        last[left] = c[left]
        k += 1
        on = size > k
        head, size, base, last = head[on], size[on], base[on], last[on]
    return out[keep], _shifted(offsets, keep), [x[keep] for x in rest]


def _moved(x: np.ndarray, to: np.ndarray, from_: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[to] = x[from_]
    return x


def foreign_words(points: np.ndarray, offsets: np.ndarray, t: Tables) -> np.ndarray:
    """Whether each letter is one that looks Latin but stands in a word of its own script.

    A word is a run of letters and digits. Its letters of a script are taken as they are if
    one of them looks like no Latin letter and the word holds no Latin letter or digit.
    """
    like = t.look[points] & (t.script[points] > 1)
    out = np.zeros(len(points), bool)
    if not like.any():
        return out
    letter = t.letter[points]
    begins = np.zeros(len(points) + 1, bool)
    begins[offsets] = True
    first = letter & (np.concatenate(([True], ~letter[:-1])) | begins[:-1])
    word = np.cumsum(first) * letter
    n, script = int(word.max()) + 1, t.script[points]
    latin = np.bincount(word[script == 1], minlength=n)[:n] > 0
    for k in range(2, 2 + len(SCRIPTS)):
        own = np.bincount(word[(script == k) & ~like], minlength=n)[:n] > 0
        own[0] = False
        out |= like & (script == k) & (own & ~latin)[word]
    return out


def stand_ins(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ASCII signs that stand in for another of the same look, and what they stand for.

    l, I, | and O, o among digits, or between 제 and a unit (조, 항, 호), are digits; l and |
    beside a capital letter, 1 and 0 between two, are I and O. A number behind a letter (B1,
    G20) is a number.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    one = np.isin(points, (108, 73, 124))
    nought = np.isin(points, (79, 111))
    digit_one, digit_nought = points == 49, points == 48
    maybe = np.flatnonzero(one | nought | digit_one | digit_nought)
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    before = np.where(start[maybe], 0, points[np.maximum(maybe - 1, 0)])
    after = np.where(start[maybe + 1], 0, points[np.minimum(maybe + 1, n - 1)])
    digit = lambda c: (c >= 48) & (c <= 57)
    capital = lambda c: (c >= 65) & (c <= 90)
    letter = lambda c: capital(c) | ((c >= 97) & (c <= 122))
    ordinal = ord("제")
    unit = np.isin(after, [ord(c) for c in "조항호"])
    first, last = (before == ordinal) | digit(before), unit | digit(after) | (after == ord("의"))
    numeric = (digit(before) & ~letter(after)) | (digit(after) & ~letter(before)) | ((before == ordinal) & unit)
    is_one, is_nought = one[maybe], nought[maybe]
    as_digit = (is_one | is_nought) & numeric & first & last
    sure = lambda c: capital(c) & (c != 73) & (c != 79)
    low_l = (points[maybe] == 108) | (points[maybe] == 124)
    beside = (sure(before) & ~digit(after) & ~letter(after)) | (sure(after) & ~digit(before) & ~letter(before)) | (sure(before) & capital(after)) | (capital(before) & sure(after))
    between = (sure(before) & capital(after)) | (capital(before) & sure(after))
    as_capital = ~as_digit & ((low_l & beside) | ((digit_one[maybe] | digit_nought[maybe]) & between))
    to = np.where(as_digit, np.where(is_one, 49, 48), np.where(digit_nought[maybe], 79, 73)).astype(np.uint32)
    hit = as_digit | as_capital
    return maybe[hit], to[hit]


def normalize_batch(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts in one consistent form, and whether each held a character other than the plain form."""
    t, valid = tables(), np.asarray(texts.is_valid())
    points, offsets = code_points(texts)
    points, offsets = resolve_references(points, offsets)
    own = foreign_words(points, offsets, t)
    odd = np.concatenate(([0], np.cumsum(t.odd[points] & ~own)))
    found = odd[offsets[1:]] > odd[offsets[:-1]]
    if (t.follows[points] | ((points >= L) & (points < L + 256))).any():  # before letters are replaced, which a mark may tell apart
        points, offsets = compose(points, offsets, t)
        own = foreign_words(points, offsets, t)
    length = np.where(own, 1, t.length[points])
    if (length != 1).any():
        ends = np.cumsum(length, dtype=np.int64)
        source = np.repeat(np.arange(len(points)), length)
        within = np.arange(len(source)) - (ends - length)[source]
        long = length[source] > 1
        out = np.where(own[source], points[source], t.to[points[source]])
        out[long] = t.extra[t.extra_at[points[source[long]]] + within[long]]
        points, offsets = out, np.concatenate(([0], ends))[offsets]
    else:
        points = np.where(own, points, t.to[points])
    points, offsets = compose(points, offsets, t)
    at, to = stand_ins(points, offsets)
    if len(at):
        points = points.copy()
        points[at] = to
        found[np.searchsorted(offsets, at, "right") - 1] = True
    return to_strings(points, offsets, valid), found


def normalize_text(df: DataFrame, text: str, keep: list[str], out: str = "plain", flag: str = "altered") -> DataFrame:
    """``keep`` columns, the text in one consistent form, and whether anything but plain forms was in it.

    Invisible characters go, blanks of any kind become a space, full-width,
    compatibility and look-alike characters become what they look like (letters of other
    scripts not in words of their own), conjoining Hangul and combining accents of any
    script are composed, numeric XML references are resolved.
    Signs with a look of their own (brackets, unit signs, circled numbers) stay. A
    null stays null and is not flagged; an empty text stays empty. Narrow; no shuffle.
    """
    fields = [df.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` string, `{flag}` boolean"
    bytes_at_once = 4_000_000  # of text; bounds the arrays held at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, b.num_rows * bytes_at_once // max(b.column(b.num_columns - 1).nbytes, bytes_at_once))
            for s in range(0, b.num_rows, step):
                part = b.slice(s, step)
                plain, found = normalize_batch(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], plain.cast(pa.string()), pa.array(found)], [*keep, out, flag])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)
