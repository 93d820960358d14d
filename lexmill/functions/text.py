"""Scalar text functions as native columns (NFC alone needs Arrow)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and marks that results depend on.
GENERIC_NAMES = ("법령", "다른 법령", "법령이나 조례", "법령이나 다른 조례", "법령 등")
RULE_SUFFIXES = ("훈령", "예규", "고시", "지침", "요령", "규정", "기준")
DEPARTMENT_MARKS = r"\s*[,，、/;]\s*"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def normalize_text(c: Column) -> Column:
    """NFC, one middle dot for its variant U+30FB, a plain space for U+3000; '' for null."""
    return F.translate(nfc(F.coalesce(c, F.lit(""))), "・　", "· ")


def name_key(c: Column) -> Column:
    """A name without spaces."""
    return F.replace(c, F.lit(" "), F.lit(""))


def loose_name_key(c: Column) -> Column:
    """A name without blanks and middle dots."""
    return F.regexp_replace(c, r"[\s·ㆍ・]", "")


def primary_department(c: Column) -> Column:
    """The first of several departments; the whole text if the first is blank."""
    whole = F.trim(F.coalesce(c, F.lit("")))
    first = F.trim(F.get(F.split(whole, DEPARTMENT_MARKS), F.lit(0)))
    return F.when(first != "", first).otherwise(whole)


def primary_article(c: Column) -> Column:
    first = F.trim(F.substring_index(F.coalesce(c, F.lit("")), ",", 1))
    return F.when(first != "", first).otherwise(F.lit("(위치 미상)"))


def format_day(c: Column) -> Column:
    """``YYYYMMDD`` with dashes, another label as it is, a dash for nothing."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    digits = F.substring(F.regexp_replace(raw, r"\D", ""), 1, 8)
    dashed = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(F.length(digits) == 8, dashed).when(raw != "", raw).otherwise(F.lit("—"))


def escape_html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def particle(word: Column, after_final: str, after_vowel: str) -> Column:
    """The particle that fits the last syllable; words that end in no Hangul take the vowel form."""
    code = F.ascii(F.right(word, F.lit(1)))
    final = code.between(44032, 55203) & ((code - 44032) % 28 != 0)
    return F.when(final, F.lit(after_final)).otherwise(F.lit(after_vowel))


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def article_code(c: Column) -> Column:
    """Label of a six-digit article code; '' if it is none."""
    code = F.trim(F.coalesce(c, F.lit("")))
    jo, ga = F.substring(code, 1, 4).try_cast("int"), F.substring(code, 5, 2).try_cast("int")
    return F.when(code.rlike(r"^\d{6,}$") & (jo > 0), make_label(jo, ga)).otherwise(F.lit(""))


def make_label(jo: Column, ga: Column) -> Column:
    base = F.concat(F.lit("제"), jo.cast("string"), F.lit("조"))
    return F.when(F.coalesce(ga, F.lit(0)) == 0, base).otherwise(F.concat(base, F.lit("의"), ga.cast("string")))


def label_numbers(c: Column) -> Column:
    """struct(jo, ga) of a label; 9999 without an article number."""
    jo, ga = F.regexp_extract(c, r"제(\d+)조", 1), F.regexp_extract(c, r"의(\d+)", 1)
    return F.struct(F.when(jo != "", jo.cast("int")).otherwise(F.lit(9999)).alias("jo"), F.when(ga != "", ga.cast("int")).otherwise(F.lit(0)).alias("ga"))


def unit_label(hang: Column, ho: Column, mok: Column) -> Column:
    part = lambda c, a, b: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(a), c, F.lit(b))).otherwise(F.lit(""))
    return F.concat(part(hang.cast("string"), "제", "항"), part(ho, "제", "호"), part(mok, "", "목"))


def cited_kind(c: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Kind of a cited name: generic word (기타), local rule (자치법규) or law (법령)."""
    local = F.lit(False)
    for p in prefixes:
        local = local | F.startswith(c, F.lit(p))
    rule = F.lit(False)
    for s in RULE_SUFFIXES:
        rule = rule | F.endswith(c, F.lit(s))
    return (
        F.when(c.isNull() | (c == "") | c.isin(*GENERIC_NAMES), "기타")
        .when(F.endswith(c, F.lit("조례")), "자치법규")
        .when(F.endswith(c, F.lit("규칙")) & ~F.contains(c, F.lit("시행규칙")), "자치법규")
        .when(local & ~rule, "자치법규")
        .otherwise("법령")
    )


def is_local_rule(c: Column, prefixes: tuple[str, ...]) -> Column:
    return c.rlike("(?:" + "|".join(RULE_SUFFIXES) + ")$") & c.rlike("^(?:" + "|".join(prefixes or ("\\b\\B",)) + ")")


def eight_digits(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""), 1, 8)


def day_of(c: Column) -> Column:
    """Calendar day of the first eight digits, else null."""
    return F.try_to_timestamp(F.when(F.length(eight_digits(c)) == 8, eight_digits(c)), F.lit("yyyyMMdd")).cast("date")


def amend_days(c: Column) -> Column:
    """Days named in amendment tags of a text, ascending and once each."""
    text = F.coalesce(c, F.lit(""))
    inside = F.regexp_extract_all(text, F.lit(r"<(?:개정|신설|전문개정)([^>]*)>"), F.lit(1))
    days = F.flatten(F.transform(inside, lambda t: F.regexp_extract_all(t, F.lit(r"(\d{4}\.\s*\d{1,2}\.\s*\d{1,2})"), F.lit(1))))
    number = lambda d, i, n: F.lpad(F.regexp_extract(d, r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})", i), n, "0")
    return F.array_sort(F.array_distinct(F.transform(days, lambda d: F.concat(number(d, 1, 4), number(d, 2, 2), number(d, 3, 2)))))


ORIGINAL = "원제정"  # fixed value: no amendment precedes the ordinance


def basis_days(text: Column, own_day: Column) -> Column:
    """struct(was, now, amended_after): the amendment valid at the ordinance's day, the latest, and whether it is later."""
    own = eight_digits(own_day)

    def of(days: Column) -> Column:
        now = F.try_element_at(days, F.lit(-1))
        was = F.try_element_at(F.filter(days, lambda d: (own != "") & (d <= own)), F.lit(-1))
        return F.when(F.size(days) > 0, F.struct(F.coalesce(was, F.lit(ORIGINAL)).alias("was"), now.alias("now"), ((own != "") & (now > own)).alias("amended_after")))

    return let(amend_days(text), of)


def split_evidence(c: Column) -> Column:
    """struct(was, now) of a two-sided evidence text; null if it has another form."""
    form = r"(?s)^\[당시\]\s*(.*?)\n\[현행\]\s*(.*)"
    return F.when(c.rlike(form), F.struct(F.trim(F.regexp_extract(c, form, 1)).alias("was"), F.trim(F.regexp_extract(c, form, 2)).alias("now")))


GRADES = ("mechanical", "review", "check", "format", "current")


def finding_grade(severity: Column, change: Column, naked: Column, spacing: Column) -> Column:
    """Grade of a finding; a current one that is cited out of form is of grade format."""
    out_of_form = (F.coalesce(naked, F.lit(0)) != 0) | (F.coalesce(spacing, F.lit(0)) != 0)
    return (
        F.when((severity == "current") & out_of_form, "format")
        .when(severity == "current", "current")
        .when((severity == "mechanical") | (F.coalesce(change, F.lit("")) == "번호이동"), "mechanical")
        .when(severity == "review", "review")
        .otherwise("check")
    )


def narrow_unit(content: Column, hang: Column, ho: Column, mok: Column) -> Column:
    """The lines of one 항, 호 or 목 of an article's text, from the outside in; null if any step misses.

    A unit ends where a unit of its own or an outer kind begins.
    """
    starts_hang, starts_ho, starts_mok = f"^\\s*[{CIRCLED}]", r"^\s*\d+(?:의\d+)?\.", r"^\s*[가-힣]\."

    def step(lines: Column, wanted: Column, key, stops: list[str]) -> Column:
        def at(hit: Column) -> Column:
            def rest(after: Column) -> Column:
                stop = F.array_position(F.transform(after, lambda x: x.rlike("|".join(stops))), True).cast("int")
                return F.slice(lines, hit, F.when(stop > 0, stop).otherwise(F.size(lines)))

            return F.when(hit > 0, let(F.slice(lines, hit + 1, F.greatest(F.size(lines), F.lit(1))), rest))

        found = let(F.array_position(F.transform(lines, lambda x: F.coalesce(key(x) == wanted, F.lit(False))), True).cast("int"), at)
        return F.when(wanted.isNull() | (wanted == ""), lines).otherwise(found)

    circle = F.when(hang.between(1, 20), F.substring(F.lit(CIRCLED), hang.cast("int"), F.lit(1))).otherwise(F.when(hang.isNotNull() & (hang != 0), F.lit("-")))
    by_hang = lambda lines: step(lines, circle, lambda x: F.regexp_extract(x, f"^\\s*([{CIRCLED}])", 1), [starts_hang])
    by_ho = lambda lines: step(lines, ho, lambda x: F.regexp_extract(x, r"^\s*(\d+(?:의\d+)?)\.", 1), [starts_ho, starts_hang])
    by_mok = lambda lines: step(lines, mok, lambda x: F.regexp_extract(x, r"^\s*([가-힣])\.", 1), [starts_mok, starts_ho, starts_hang])
    joined = lambda lines: F.nullif(F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", ""), F.lit(""))
    asked = (F.coalesce(hang, F.lit(0)) != 0) | (F.coalesce(ho, F.lit("")) != "") | (F.coalesce(mok, F.lit("")) != "")
    return F.when(asked, let(F.split(content, "\n"), lambda a: let(by_hang(a), lambda b: let(by_ho(b), lambda c: joined(by_mok(c))))))
