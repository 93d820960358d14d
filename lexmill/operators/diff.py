"""Token diffs and highlighted spans."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import escape_html

TOKENS = re.compile(r"\w+|\s+|[^\w\s]")


def changes(old: str | None, new: str | None) -> list[tuple[str, str]]:
    """(kind, text) in reading order: ``=`` kept, ``-`` gone, ``+`` new; words, blanks and signs are the tokens."""
    a, b = TOKENS.findall(old or ""), TOKENS.findall(new or "")
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out.append(("=", "".join(a[i:j])))
            continue
        out += [(s, t) for s, t in (("-", "".join(a[i:j])), ("+", "".join(b[k:m]))) if t]
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def token_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "text": t} for k, t in changes(a, b)] for a, b in zip(old, new)])


def unified_html(diff: Column) -> Column:
    """A diff in one flow: gone text marked d, new text marked i; blanks alone are not marked."""
    mark = lambda x, c: F.concat(F.lit(f'<mark class="{c}">'), escape_html(x["text"]), F.lit("</mark>"))
    piece = lambda x: F.when((x["kind"] == "=") | (F.trim(x["text"]) == ""), escape_html(x["text"])).when(x["kind"] == "-", mark(x, "d")).otherwise(mark(x, "i"))
    return F.array_join(F.transform(diff, piece), "")


SHOWN = 40  # letters of a change shown at the place it has on the other side


def sided_html(diff: Column) -> Column:
    """struct(was, now): the diff as two texts, each change marked on both sides; where one side has nothing, a caret stands and says what the other has."""
    blank = lambda x: F.trim(x["text"]) == ""
    mark = lambda x, c: F.when(blank(x), escape_html(x["text"])).otherwise(F.concat(F.lit(f'<mark class="{c}">'), escape_html(x["text"]), F.lit("</mark>")))
    caret = lambda x, said: F.when(blank(x), F.lit("")).otherwise(F.concat(F.lit('<mark class="pt" title="'), escape_html(F.substring(F.trim(x["text"]), 1, SHOWN)), F.lit(f' {said}">‸</mark>')))
    at = lambda i: F.coalesce(F.get(diff, i)["kind"], F.lit("="))

    def side(own: str, css: str, said: str) -> Column:
        # A gone and a new text side by side are an exchange, which needs no caret.
        other = "+" if own == "-" else "-"
        beside = lambda i: at(i + 1) if own == "+" else at(i - 1)
        piece = lambda x, i: F.when(x["kind"] == "=", escape_html(x["text"])).when(x["kind"] == own, mark(x, css)).when((x["kind"] == other) & (beside(i) != own), caret(x, said)).otherwise(F.lit(""))
        return F.array_join(F.transform(diff, piece), "")

    return F.struct(side("-", "d", "추가됨").alias("was"), side("+", "i", "삭제됨").alias("now"))


def highlight(text: Column, spans: Column) -> Column:
    """HTML of a text with marked spans array<struct<start,end,css>>; overlapping, empty and outside spans are skipped."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))
    size = F.length(text)
    slice_ = lambda a, b: escape_html(F.substring(text, a + 1, b - a))

    def step(acc: Column, s: Column) -> Column:
        fits = (s["start"] >= acc["at"]) & (s["end"] <= size) & (s["start"] < s["end"])
        html = F.concat(acc["html"], slice_(acc["at"], s["start"]), F.lit('<mark class="'), s["css"], F.lit('">'), slice_(s["start"], s["end"]), F.lit("</mark>"))
        return F.when(fits, F.struct(s["end"].alias("at"), html.alias("html"))).otherwise(acc)

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["html"], slice_(acc["at"], size)))
