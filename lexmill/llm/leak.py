"""Evaluation texts inside training text: an FM-index per shard of documents.

A task turns the documents it reads, shard by shard, into one array of plain letters
(form, case, spacing and punctuation taken out by a table lookup), sorts its suffixes by
prefix doubling, and keeps the Burrows-Wheeler column as a wavelet matrix over bit-packed
words with every few suffix positions. All phrases of the evaluation items are searched
at once, backwards, letter by letter, by rank queries, and located by walking to the next
sampled position. Located phrases on one diagonal of a document and an item are a run,
runs that follow each other are a passage, and merged passages are the spans to remove.
Documents whose spans reproduce enough of an item are those that leak it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.normalize import SIZE, code_points, compose, tables
from lexmill.session import shared_path

PHRASE = 12  # letters of a search phrase; a shorter item is one phrase
SHARD = 2_000_000  # letters of one index, a longer text is cut into overlapping windows
RATE = 8  # every which suffix position is kept
BLOCK = 20_000  # evaluation items held at once
REPRODUCED = 0.48  # share of an item's letters in merged spans
GAP = 16  # letters that an exchanged word may take between two spans of one passage
PASSAGE = 24  # letters of the shortest passage, in items of 50 letters and more; shorter runs are stock phrases
DENSE = 0.75  # share of a passage that is common, letter by letter


@cache
def letters() -> np.ndarray:
    """What each code point counts as: a plain lower-case letter or digit, or 0 for nothing."""
    t = tables()
    to = t.to.copy()
    to[t.length != 1] = 0
    plain = np.zeros(SIZE, np.uint32)
    for a, b in ((0x30, 0x250), (0x370, 0x590), (0x1100, 0x1200), (0x1E00, 0x2000), (0x3040, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2FA20)):
        if a in (0x3040, 0xAC00, 0x20000):
            plain[a:b] = np.arange(a, b)
            continue
        for c in range(a, b):
            if unicodedata.category(chr(c))[0] in "LN":
                low = chr(c).lower()
                plain[c] = ord(low) if len(low) == 1 else c
    for c in (*range(0x3040, 0x3042), *range(0x3099, 0x30A1), 0x30FB, *range(0x3200, 0x3400)):
        plain[c] = 0
    for c in range(0x300, 0x370):  # marks stay for composition
        plain[c] = c
    return plain[to]


def placed_letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain letters of all texts, the offset of each text, and the code point of its text each letter stands at."""
    points, offsets = code_points(texts)
    place = np.arange(len(points)) - np.repeat(offsets[:-1], np.diff(offsets))
    points = letters()[points]
    keep = points != 0
    offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    points, place = points[keep], place[keep]
    if len(points) and (((points >= 0x1100) & (points < 0x1200)) | ((points >= 0x300) & (points < 0x370))).any():
        points, offsets, place = compose(points, offsets, tables(), place)
    return points, offsets, place


def plain_letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return placed_letters(texts)[:2]


class Wavelet:
    """Wavelet matrix: rank of a code in a prefix, for arrays of queries."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(codes)
        self.words, self.ones, self.zeros = [], [], []
        words = (self.n >> 6) + 1
        for b in range(bits - 1, -1, -1):
            bit = (codes >> b) & 1 != 0
            packed = np.zeros(words * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            w = packed.view(np.uint64)
            self.words.append(w)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(w), dtype=np.int64))))
            codes = np.concatenate((codes[~bit], codes[bit]))
            self.zeros.append(self.n - int(self.ones[-1][-1]))

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code occurs before position ``at``."""
        low = np.zeros(len(code), np.int64)
        for level in range(self.bits):
            w, ones, zeros = self.words[level], self.ones[level], self.zeros[level]
            up = (code >> (self.bits - 1 - level)) & 1 != 0
            a, b = self._ones(w, ones, low), self._ones(w, ones, at)
            low = np.where(up, zeros + a, low - a)
            at = np.where(up, zeros + b, at - b)
        return at - low

    @staticmethod
    def _ones(w: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[word] + np.bitwise_count(w[word] & mask)

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at each position and how often it occurs before."""
        code, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            w, ones, zeros = self.words[level], self.ones[level], self.zeros[level]
            up = (w[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            a, b = self._ones(w, ones, low), self._ones(w, ones, at)
            code = code << 1 | up
            low = np.where(up, zeros + a, low - a)
            at = np.where(up, zeros + b, at - b)
        return code, at - low


def suffix_order(codes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the suffixes in their order, by prefix doubling over those still alike; an end sorts before any code."""
    n = len(codes)
    width = max(1, 63 // bits)
    padded = np.concatenate((codes, np.zeros(width, codes.dtype)))
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(bits)) | padded[k : k + n].astype(np.uint64)
    order = np.argsort(key, kind="quicksort")
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))  # begins a group of suffixes alike so far
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        alike = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
        if not len(alike):
            return order
        some = order[alike]
        # A suffix that ends within the width sorts before those that go on, the shorter first.
        follow = np.where(some + width < n, rank[np.minimum(some + width, n - 1)] + n, n - 1 - some)
        key = rank[some].astype(np.uint64) << np.uint64(32) | follow.astype(np.uint64)
        by = np.argsort(key, kind="quicksort")
        some, key = some[by], key[by]
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        order[alike], first[alike] = some, begins
        rank[some] = alike[np.maximum.accumulate(np.where(begins, np.arange(len(alike)), 0))]
        width *= 2


class FMIndex:
    """Index of one shard; ``codes`` are 1..m, 0 separates and ends the texts.

    Positions are kept of every ``rate``-th letter and of each first letter of a text, so
    a walk to a kept position never leaves its text.
    """

    def __init__(self, codes: np.ndarray, rate: int = RATE) -> None:
        top = int(codes.max(initial=0))
        bits = max(1, top.bit_length())
        order = suffix_order(codes, bits)
        before = codes[order - 1]  # the row of position 0 is preceded by the last separator
        self.tree = Wavelet(before, bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=top + 2))))
        self.kept = (order % rate == 0) | (before == 0)
        self.number = np.concatenate(([0], np.cumsum(self.kept)))
        self.positions = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks [lo, hi) of rows that begin with each phrase (rows of codes, 0 = matches nothing)."""
        live = np.flatnonzero((phrases > 0).all(axis=1))
        lo_all, hi_all = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        last = phrases[live, -1].astype(np.int64)
        lo, hi = self.first[last], self.first[last + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            if not len(live):
                break
            c = phrases[live, k].astype(np.int64)
            ranks = self.tree.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
            lo, hi = self.first[c] + ranks[: len(c)], self.first[c] + ranks[len(c) :]
        lo_all[live], hi_all[live] = lo, hi
        return lo_all, hi_all

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the phrase, position) of all occurrences, walked backwards to the next kept position."""
        found = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(lo)), found)
        row = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(lo, found)
        walked = np.zeros(len(row), np.int64)
        going = np.flatnonzero(~self.kept[row])
        while len(going):
            code, before = self.tree.step(row[going])
            row[going] = self.first[code] + before
            walked[going] += 1
            going = going[~self.kept[row[going]]]
        return which, self.positions[self.number[row]] + walked


@dataclass
class Phrases:
    """Distinct phrases of one length, and the items and places each occurs at."""

    size: int
    phrases: np.ndarray  # one row of code points each
    start: np.ndarray  # item[start[p]:start[p+1]] are the items phrase p occurs in
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, size: int, texts: dict[int, np.ndarray]) -> Phrases:
        rows = [np.lib.stride_tricks.sliding_window_view(t, size) for t in texts.values()]
        owner = np.repeat(np.array(list(texts)), [len(r) for r in rows])
        place = np.concatenate([np.arange(len(r)) for r in rows])
        phrases, number = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        order = np.argsort(number.ravel(), kind="stable")
        return cls(size, phrases, np.concatenate(([0], np.cumsum(np.bincount(number.ravel(), minlength=len(phrases))))), owner[order], place[order])

    def uses(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For occurrences of phrases: (number of the occurrence, item, place in the item) of every use."""
        n = self.start[which + 1] - self.start[which]
        at = np.repeat(self.start[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(which)), n), self.item[at], self.place[at]


@dataclass
class Items:
    """Evaluation items as plain letters and their phrases by length; an item shorter than a phrase is a phrase of its own."""

    ids: list
    lengths: np.ndarray
    sets: list[Phrases]

    @classmethod
    def of(cls, ids: list, texts: list[str | None], size: int = PHRASE) -> Items:
        points, offsets = plain_letters(pa.array(texts, pa.string()))
        lengths = np.diff(offsets)
        by_size: dict[int, dict[int, np.ndarray]] = {}
        for i, n in enumerate(lengths.tolist()):
            if n:
                by_size.setdefault(min(n, size), {})[i] = points[offsets[i] : offsets[i + 1]]
        return cls(ids, lengths, [Phrases.of(k, v) for k, v in sorted(by_size.items())])


def shortest_passage(letters_: int) -> int:
    """Of an item of so many letters: PASSAGE, or less where half an item is less."""
    return min(PASSAGE, max(min(PHRASE, letters_), ceil(REPRODUCED * letters_)))


@dataclass
class Runs:
    """Stretches common to a text and an item: text, item, begin in both, length; sorted by text, item and place in the item."""

    text: np.ndarray
    item: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n: np.ndarray

    @classmethod
    def joined(cls, size: int, text: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> Runs:
        """Located phrases that follow each other on one diagonal as one run."""
        by = np.lexsort((a, b - a, item, text))
        text, item, a, b = text[by], item[by], a[by], b[by]
        same = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (b[1:] - a[1:] == b[:-1] - a[:-1]) & (a[1:] - a[:-1] == 1)
        begin = np.flatnonzero(np.concatenate(([True], ~same))) if len(a) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((begin, [len(a)]))) + size - 1
        return cls(text[begin], item[begin], a[begin], b[begin], n).ordered()

    def ordered(self) -> Runs:
        by = np.lexsort((self.n, self.b, self.a, self.item, self.text))
        return Runs(*(x[by] for x in (self.text, self.item, self.a, self.b, self.n)))

    @classmethod
    def united(cls, runs: list[Runs]) -> Runs:
        return cls(*(np.concatenate([getattr(r, k) for r in runs]) for k in ("text", "item", "a", "b", "n"))).ordered()

    def groups(self, lengths: np.ndarray) -> list[tuple[int, int]]:
        """[from, to) of the runs of each text and item whose letters can make up the share asked for: passages hold DENSE of their letters at least."""
        if not len(self.text):
            return []
        begin = np.flatnonzero(np.concatenate(([True], (self.text[1:] != self.text[:-1]) | (self.item[1:] != self.item[:-1]))))
        group = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [len(self.text)]))))
        far = int((self.a + self.n).max()) + 1
        ends = np.maximum.accumulate(self.a + self.n + group * far)
        reached = np.concatenate(([0], ends[:-1]))
        new = np.maximum(0, self.a + self.n + group * far - np.maximum(reached, self.a + group * far))
        enough = np.bincount(group, new) >= DENSE * REPRODUCED * lengths[self.item[begin]] - 1e-9
        stop = np.concatenate((begin[1:], [len(self.text)]))
        return list(zip(begin[enough].tolist(), stop[enough].tolist()))


def passages(runs: list[tuple[int, int, int]], shortest: int, size: int, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """(begin, end) in the item and in the text of passages, from runs in the order of the item.

    Runs that follow each other in both within ``gap`` letters are one passage, an exchanged
    word between them included. A single short run, as stock phrases give, is none.
    """
    out = []
    used = [False] * len(runs)
    for i, (a, b, n) in enumerate(runs):
        if used[i]:
            continue
        end_a, end_b, common = a + n, b + n, n
        for j in range(i + 1, len(runs)):
            c, d, m = runs[j]
            if c > end_a + gap:
                break
            if not used[j] and c + m > end_a and -size < c - end_a <= gap and -size < d - end_b <= gap and abs((c - end_a) - (d - end_b)) <= gap // 2:
                used[j] = True
                common += c + m - max(c, end_a)
                end_a, end_b = c + m, d + m
        if end_a - a >= shortest and common >= DENSE * (end_a - a):
            out.append((a, end_a, b, end_b))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Shard:
    """Texts indexed together; ``points`` holds 0 after each text."""

    def __init__(self, points: np.ndarray) -> None:
        present = np.zeros(SIZE, bool)
        present[points] = True
        present[0] = False
        alphabet = np.flatnonzero(present)
        self.code = np.zeros(SIZE, np.uint32)
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.index = FMIndex(self.code[points])

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        return self.index.locate(*self.index.search(self.code[phrases.phrases]))


def _runs(shard: Shard, starts: np.ndarray, items: Items, limit: int | None = None, shift: int = 0) -> list[Runs]:
    """Runs of all texts of a shard that begin before ``limit``."""
    out = []
    for p in items.sets:
        which, at = shard.occurrences(p)
        if limit is not None:
            which, at = which[at < limit], at[at < limit]
        number, item, place = p.uses(which)
        text = np.searchsorted(starts, at, "right") - 1
        out.append(Runs.joined(p.size, text[number], item, place, (at - starts[text])[number] + shift))
    return out


def _judged(runs: Runs, items: Items) -> Iterator[tuple[int, int, float, list[tuple[int, int]]]]:
    """(text, item, share of the item's letters, merged spans in the text) where the share is enough."""
    for s, e in runs.groups(items.lengths):
        i = int(runs.item[s])
        length = int(items.lengths[i])
        found = passages(list(zip(runs.a[s:e].tolist(), runs.b[s:e].tolist(), runs.n[s:e].tolist())), shortest_passage(length), min(PHRASE, length))
        share = sum(b - a for a, b in merged([(a, b) for a, b, _, _ in found])) / length
        if share >= REPRODUCED:
            yield int(runs.text[s]), i, share, merged([(c, d) for _, _, c, d in found])


def reproduced(item: np.ndarray, doc: np.ndarray) -> float:
    """Share of the item's letters that the passages of one document reproduce."""
    if not len(item) or not len(doc):
        return 0.0
    size = min(PHRASE, len(item))
    known = Items([0], np.array([len(item)]), [Phrases.of(size, {0: item})])
    runs = Runs.united(_runs(Shard(np.concatenate((doc, [0])).astype(np.uint32)), np.zeros(1, np.int64), known))
    found = passages(list(zip(runs.a.tolist(), runs.b.tolist(), runs.n.tolist())), shortest_passage(len(item)), size)
    return sum(b - a for a, b in merged([(a, b) for a, b, _, _ in found])) / len(item)


def spans_in(points: np.ndarray, offsets: np.ndarray, blocks: Callable[[], Iterable[Items]], shard: int = SHARD) -> Iterator[tuple[int, object, float, list[tuple[int, int]]]]:
    """(number of the text, item_id, share, spans in letters) of texts that reproduce an item; each shard of ``shard`` letters is indexed once for all blocks of items."""
    lengths = np.diff(offsets)
    first = 0
    while first < len(lengths):
        if lengths[first] > shard:  # windows that overlap by a phrase; their runs are joined again by the passages
            text = points[offsets[first] : offsets[first + 1]]
            windows = [(s, Shard(np.concatenate((text[s : s + shard + PHRASE - 1], [0])).astype(np.uint32))) for s in range(0, len(text), shard)]
            for items in blocks():
                parts = [r for s, w in windows for r in _runs(w, np.zeros(1, np.int64), items, shard, s)]
                for _, i, share, spans in _judged(Runs.united(parts), items):
                    yield first, items.ids[i], share, spans
            first += 1
            continue
        last = int(np.searchsorted(offsets, offsets[first] + shard, "right")) - 1
        last = min(max(last, first + 1), len(lengths))
        too_long = np.flatnonzero(lengths[first:last] > shard)
        last = first + int(too_long[0]) if len(too_long) else last
        ends = offsets[first + 1 : last + 1] - offsets[first]
        indexed = Shard(np.insert(points[offsets[first] : offsets[last]], ends, 0))
        starts = offsets[first:last] - offsets[first] + np.arange(last - first)
        for items in blocks():
            parts = _runs(indexed, starts, items)
            if parts:
                for t, i, share, spans in _judged(Runs.united(parts), items):
                    yield first + t, items.ids[i], share, spans
        first = last


def leaks_in(doc_ids: list, points: np.ndarray, offsets: np.ndarray, items: Items, shard: int = SHARD) -> list[tuple]:
    """(doc_id, item_id) of the documents that reproduce an item."""
    return [(doc_ids[t], i) for t, i, _, _ in spans_in(points, offsets, lambda: [items], shard)]


@lru_cache(maxsize=1)
def _only_block(path: str, rows: int) -> Items | None:
    """The items if they are one block, read once per process."""
    found = list(_read_blocks(path, rows, 2))
    return found[0] if len(found) == 1 else None


def _read_blocks(path: str, rows: int, most: int | None = None) -> Iterator[Items]:
    """Items of the shared table in blocks of ``rows``, whatever its files."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    plain = path.removeprefix("file:")
    files, plain = fs.FileSystem.from_uri(path) if "://" in path and not path.startswith("file:") else (fs.LocalFileSystem(), "/" + plain.lstrip("/"))
    ids: list = []
    texts: list = []
    sent = 0
    for b in ds.dataset(plain, format="parquet", filesystem=files).to_batches(batch_size=rows):
        ids += b.column(0).to_pylist()
        texts += b.column(1).to_pylist()
        while len(ids) >= rows and sent != most:
            yield Items.of(ids[:rows], texts[:rows])
            ids, texts, sent = ids[rows:], texts[rows:], sent + 1
    if ids and sent != most:
        yield Items.of(ids, texts)


def leak_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, part, start, end, share): the spans of documents that reproduce about half of an item's text or more.

    Spans are half-open ranges of code points of the document, merged, numbered from 0
    within document and item; share is the item's share that all of them reproduce.

    The held-out items are written to the shared folder once and read there by the tasks,
    at most ``block`` at a time; documents are read once, indexed where they are read, and
    never shuffled. A null or empty text matches nothing; an item of fewer letters than a
    phrase must occur whole; a repeated row of a document comes out as often.
    """
    rows = items.where(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    path = shared_path(documents.sparkSession, "items")
    rows.write.option("maxRecordsPerFile", block).parquet(path)
    types = pa.schema([("doc_id", _arrow(documents, doc_id)), ("item_id", _arrow(items, item_id)), ("part", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())])
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, part int, start int, end int, share double"

    def blocks() -> Iterable[Items]:
        one = _only_block(path, block)
        return [one] if one is not None else _read_blocks(path, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in gathered(batches):
            points, offsets, place = placed_letters(texts)
            found = []
            for t, item, share, spans in spans_in(points, offsets, blocks):
                at = place[offsets[t] : offsets[t + 1]]
                found += [(ids[t], item, k, int(at[a]), int(at[b - 1]) + 1, share) for k, (a, b) in enumerate(spans)]
            columns = list(zip(*found)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    return documents.where(F.col(text).isNotNull()).select(doc_id, text).mapInArrow(run, schema)


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id) of documents that hold spans of an item, see ``leak_spans``."""
    return leak_spans(documents, items, doc_id, text, item_id, item_text, block).where("part = 0").select("doc_id", "item_id")


def gathered(batches: Iterator[pa.RecordBatch], letters_: int = SHARD) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of a few million bytes at a time, whatever the size of the Arrow batches."""
    ids: list = []
    held: list[pa.Array] = []
    size = 0
    for b in batches:
        step = max(1, min(b.num_rows, int(letters_ * max(b.num_rows, 1) / max(b.column(1).nbytes // 3, 1)) or 1))
        for s in range(0, b.num_rows, step):
            p = b.slice(s, step)
            ids += p.column(0).to_pylist()
            held.append(p.column(1).cast(pa.large_string()))
            size += len(pa.compute.binary_length(held[-1])) and int(pa.compute.sum(pa.compute.binary_length(held[-1])).as_py() or 0)
            if size >= 3 * letters_:
                yield ids, pa.concat_arrays(held)
                ids, held, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(held)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
