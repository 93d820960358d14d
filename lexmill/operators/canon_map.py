"""Freely entered values mapped to the closest entry of a reference list, in SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexmill.functions.plain_sql import jamo, run_sql
from lexmill.session import spread, write_shared

SLIPS = ((10, 2), (6, 1))  # from so many characters on, so many slips; shorter texts must be met exactly


def _only_in(a: str, b: str) -> str:
    """Characters of ``a`` that ``b`` has fewer of, as an array (one for each missing copy's kind)."""
    count = lambda s: f"(length({s}) - length(replace({s}, x, '')))"
    return f"flatten(transform(array_distinct(split({a}, '')), x -> array_repeat(x, greatest(0, {count(a)} - {count(b)}))))"


def closest_entries(readings: DataFrame, entries: DataFrame, places: DataFrame | None = None, slips: tuple[tuple[int, int], ...] = SLIPS) -> DataFrame:
    """For each entered value the entry it means, by a partition-based pigeonhole join.

    readings(value, reading): one or more ways to read an entered value, already in
    plain form. entries(entry_id, text): the reference list, several texts per entry
    allowed. ``slips`` says how many a text of a length may hold; a slip takes two edits at
    most, so a text is cut into k + 1 segments, k being twice its slips, and a reading
    within k edits holds at least one segment unchanged. Where it can lie follows from the
    number of edits left and right of it, so the join is an equality on (length of the
    text, number of the segment, substring), and the built-in levenshtein verifies. A slip
    is a syllable left out or doubled, neighbours exchanged, or one letter of a syllable
    changed; other edits make another name. Slips are counted from the characters that
    differ and the edits beyond them, of which an exchange takes two.

    places(entry_id, word): the place an entry is named after, two syllables and the rest.
    A reading that begins with another place the list's own parts can form names something
    else, however close; exact readings are not held against this.

    Result: (value, entry_id) with the fewest slips, then the fewest letters changed, then
    the smallest id; values that mean no entry are left out. Nulls match nothing; an
    empty list or no values give no rows.
    """
    spark = readings.sparkSession
    ordered = sorted(slips, reverse=True)
    most, least = max((n for _, n in ordered), default=0), min((size for size, n in ordered if n), default=1)
    allowed = lambda size, each: "CASE " + " ".join(f"WHEN {size} >= {k} THEN {each * n}" for k, n in ordered) + " ELSE 0 END"
    edits = 2 * most
    exact = run_sql(spark, "SELECT DISTINCT r.value, e.entry_id FROM {r} r JOIN {e} e ON r.reading = e.text", r=readings, e=entries)
    # Many values read alike: each reading is compared once.
    open_ = write_shared(run_sql(spark, "SELECT r.value, r.reading FROM {r} r LEFT ANTI JOIN {x} x ON r.value = x.value", r=readings, x=exact), "open")
    segments = run_sql(
        spark,
        f"""SELECT entry_id, text, len, seg,
                   CASE WHEN seg < k THEN substr(text, seg * (len DIV (k + 1)) + 1, len DIV (k + 1)) ELSE substr(text, seg * (len DIV (k + 1)) + 1) END AS part
            FROM (SELECT entry_id, text, length(text) AS len, {allowed("length(text)", 2)} AS k FROM {{e}})
            LATERAL VIEW explode(sequence(0, k)) s AS seg WHERE k > 0 AND len > k""",
        e=entries,
    )
    # With seg segments to its left and k - seg to its right, a segment is shifted by at most seg
    # from the left end and at most k - seg from the right end of the reading.
    probes = run_sql(
        spark,
        f"""SELECT reading, len, seg, substr(reading, at, CASE WHEN seg < k THEN len DIV (k + 1) ELSE len - seg * (len DIV (k + 1)) END) AS part
            FROM (SELECT reading, len, k, seg, seg * (len DIV (k + 1)) + 1 + shift AS at
                  FROM (SELECT reading, len, k, seg, greatest(-seg, length(reading) - len - k + seg) AS lo, least(seg, length(reading) - len + k - seg) AS hi
                        FROM (SELECT reading, len, {allowed("len", 2)} AS k FROM {{r}}
                              LATERAL VIEW explode(sequence(greatest({least}, length(reading) - {edits}), greatest({least}, length(reading) + {edits}))) l AS len)
                        LATERAL VIEW explode(sequence(0, k)) s AS seg WHERE k > 0 AND abs(length(reading) - len) <= k)
                  LATERAL VIEW explode(CASE WHEN lo <= hi THEN sequence(lo, hi) END) d AS shift)
            WHERE at >= 1 AND at <= length(reading)""",
        # Written before they are spread, or the few tasks of the distinct would do for all that follows; spread by
        # the reading, so that nothing below moves the pairs again.
        r=spread(write_shared(open_.select("reading").distinct(), "asked"), "reading"),
    )
    pairs = run_sql(spark, "SELECT DISTINCT p.reading, s.entry_id, s.text FROM {p} p JOIN {s} s ON p.len = s.len AND p.seg = s.seg AND p.part = s.part", p=probes, s=segments)
    # Grouped, because a plain filter would be moved before the distinct and verify every repetition of a pair.
    near = run_sql(
        spark,
        f"""SELECT reading, entry_id, text, min(levenshtein(reading, text, {edits})) AS edits FROM {{p}} GROUP BY reading, entry_id, text
            HAVING min(levenshtein(reading, text, {edits})) BETWEEN 0 AND {allowed("length(text)", 2)}""",
        p=pairs,
    )
    # The candidates are written once: the plan stays small and levenshtein runs once per pair.
    near = write_shared(near, "near")
    letters = run_sql(
        spark,
        f"""SELECT *, {_only_in("reading", "text")} AS added, {_only_in("text", "reading")} AS missing, levenshtein({jamo("reading")}, {jamo("text")}) AS changed FROM {{n}}
            WHERE size(array_except(split(reading, ''), split(text, ''))) <= {most} AND size(array_except(split(text, ''), split(reading, ''))) <= {most}""",
        n=spread(near, "reading"),
    )
    # Written, because a filter on what follows would be pushed down and compute all this once per mention.
    letters = write_shared(letters, "letters")
    parts = ("DIV 588", "% 588 DIV 28", "% 28")  # of a syllable: first consonant, vowel, last consonant
    alike = "ascii(c) BETWEEN 44032 AND 55203 AND ascii(d) BETWEEN 44032 AND 55203 AND " + " + ".join(f"int((ascii(c) - 44032) {p} = (ascii(d) - 44032) {p})" for p in parts) + " >= 2"
    judged = run_sql(
        spark,
        f"""SELECT *, size(filter(added, c -> exists(missing, d -> {alike}))) AS swapped,
                   size(filter(missing, c -> exists(added, d -> {alike}))) AS swapped_back,
                   forall(added, c -> instr(text, c) > 0) AS doubled,
                   greatest(size(added), size(missing)) AS most, least(size(added), size(missing)) AS least_, size(added) + size(missing) AS all_
            FROM {{l}}""",
        l=letters,
    )
    counted = run_sql(
        spark,
        """SELECT reading, entry_id, text, edits, changed,
                  CASE WHEN edits >= most AND swapped >= least_ AND swapped_back >= least_
                            AND (size(added) <= size(missing) OR forall(added, c -> instr(text, c) > 0 OR exists(missing, d -> true))) THEN most + (edits - most + 1) DIV 2
                       WHEN edits >= all_ AND doubled THEN all_ + (edits - all_ + 1) DIV 2
                       WHEN edits = 1 AND changed = 2 THEN 2 END AS slips
           FROM {j}""",
        j=judged,
    )
    meant = run_sql(spark, f"""SELECT * FROM {{c}} WHERE slips <= {allowed("length(text)", 1)}""", c=counted)
    cases = run_sql(spark, "SELECT o.value, k.entry_id, k.slips, k.changed FROM {o} o JOIN {k} k ON o.reading = k.reading", o=open_, k=meant)
    cases = write_shared(cases, "cases")
    if places is not None:
        # Any way to read a value that begins with another place speaks against the entry. Parts meet by
        # equality: the first two characters with the heads, what follows with the tails.
        begun = run_sql(
            spark,
            """SELECT DISTINCT o.value, o.reading, left(o.reading, 2) AS head, substr(o.reading, 3, n.size) AS tail
               FROM {o} o LEFT SEMI JOIN {c} c ON o.value = c.value LATERAL VIEW explode(sequence(1, greatest(1, length(o.reading) - 2))) n AS size""",
            o=open_, c=cases,
        )
        formed = run_sql(
            spark,
            """SELECT b.value, b.reading, concat(b.head, b.tail) AS place FROM {b} b
               LEFT SEMI JOIN (SELECT left(word, 2) AS head FROM {p} WHERE length(word) > 3) h ON b.head = h.head
               LEFT SEMI JOIN (SELECT substr(word, 3) AS tail FROM {p} WHERE length(word) > 3) t ON b.tail = t.tail""",
            b=begun, p=places,
        )
        cases = run_sql(
            spark,
            """SELECT c.* FROM {c} c LEFT ANTI JOIN (
                   SELECT k.value, k.entry_id FROM {c} k JOIN {f} f ON k.value = f.value JOIN {p} p ON k.entry_id = p.entry_id
                   WHERE NOT startswith(p.word, f.place) AND NOT startswith(f.reading, p.word)) x
               ON c.value = x.value AND c.entry_id = x.entry_id""",
            c=cases, f=formed, p=places,
        )
    best = run_sql(spark, "SELECT value, min_by(entry_id, struct(slips, changed, entry_id)) AS entry_id FROM {c} GROUP BY value", c=cases)
    return run_sql(spark, "SELECT value, min(entry_id) AS entry_id FROM {x} GROUP BY value UNION ALL SELECT value, entry_id FROM {b}", x=exact, b=best)
