"""Plain form of names as SQL expressions: look-alike and invisible characters, Hangul parts, jamo."""

from __future__ import annotations

# Characters and what they look like, position by position.
LOOKS = "АВЕЅІЈКМНОРСТУХԌѴаеѕіјорсухԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵ"
LIKE = "ABESIJKMHOPCTYXGVaesijopcyxdABEZHIKMNOPTYXov"
FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94))
ASCII = "".join(chr(0x21 + i) for i in range(94))
HANJA, HANGUL = "法律令規則施行條例", "법률령규칙시행조례"
INVISIBLE = r"[­͏؜᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]"
BLANK = r"[\s\u0085 ᅟᅠ  -     ⠀　ㅤﾠ]"
DOTS = r"[·ᆞ•‧∙⋅・ㆍ･·ᐧ⸱]"
FIRSTS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
LASTS = "-ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
_PARTS = r"[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]|(?s:.)"


def literal(s: str) -> str:
    """A raw SQL string; the text must hold no double quote."""
    return 'r"' + s + '"'


def composed(x: str) -> str:
    """Conjoining Hangul parts of ``x`` as syllables."""
    code = """CASE WHEN ascii(p) >= 44032 THEN ascii(p) + ascii(substr(p, 2, 1)) - 4519
        ELSE 44032 + ((ascii(p) - 4352) * 21 + ascii(substr(p, 2, 1)) - 4449) * 28
             + CASE WHEN length(p) = 3 THEN ascii(substr(p, 3, 1)) - 4519 ELSE 0 END END"""
    return f"""CASE WHEN {x} RLIKE {literal(r"[ᄀ-ᇿ]")}
        THEN array_join(transform(regexp_extract_all({x}, {literal(_PARTS)}, 0),
             p -> CASE WHEN length(p) = 1 THEN p ELSE decode(unhex(hex(CAST({code} AS BIGINT))), 'UTF-16BE') END), '')
        ELSE {x} END"""


def plain_name(x: str) -> str:
    """``x`` without invisible characters, with ASCII for what looks like it, one space for blanks, · for dots."""
    s = f"regexp_replace({x}, {literal(INVISIBLE)}, '')"
    quote = ASCII.replace("'", "''").replace("\\", "\\\\")
    s = f"translate({s}, '{FULL_WIDTH}', '{quote}')"
    s = f"translate({s}, '{LOOKS}{HANJA}', '{LIKE}{HANGUL}')"
    s = f"regexp_replace(regexp_replace({s}, {literal(DOTS)}, '·'), {literal(BLANK + '+')}, ' ')"
    return f"trim({s})"


def jamo(x: str) -> str:
    """Three letters for each Hangul syllable of ``x`` ('-' for no final), other characters as they are."""
    return f"""array_join(transform(split({x}, ''), c -> CASE WHEN ascii(c) BETWEEN 44032 AND 55203 THEN
        concat(substr('{FIRSTS}', CAST((ascii(c) - 44032) DIV 588 AS INT) + 1, 1),
               substr('{VOWELS}', CAST(((ascii(c) - 44032) % 588) DIV 28 AS INT) + 1, 1),
               substr('{LASTS}', CAST((ascii(c) - 44032) % 28 AS INT) + 1, 1)) ELSE c END), '')"""


def run_sql(spark, text: str, **tables):
    """``spark.sql`` with {name} for tables; all other braces (of patterns) stay as they are."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(text, **tables)
