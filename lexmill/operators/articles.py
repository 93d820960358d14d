"""Articles of laws, ordinances and administrative rules as rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import primary_department
from lexmill.operators.clauses import label
from lexmill.operators.shred import article_label, parse_record

# Tags of sub-units and their content, the head of an article, marks of a comparison table.
CONTENT = {"항": "항내용", "호": "호내용", "목": "목내용"}
HEAD = re.compile(r"제(\d+)조(?:의(\d+))?")
SAME_MARKS = r"\(\s*(?:현행과\s*같음|좌\s*동|생\s*략)\s*\)"

FIELDS = ("pos", "label", "is_article", "title", "enforce_date", "moved_from", "moved_to", "changed", "content")
SCHEMA = "pos int, label string, is_article boolean, title string, enforce_date string, moved_from string, moved_to string, changed boolean, content string"
_ARROW = [pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]


def _leaf(u, tag: str) -> str:
    return (u.findtext(tag) or "").strip()


def unit_text(u) -> str:
    """Head and all sub-units of an article in document order, a line each, blank ones left out."""
    lines = [_leaf(u, "조문내용")]
    stack = [iter(u)]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif c.tag in CONTENT:
            lines.append(_leaf(c, CONTENT[c.tag]))
            stack.append(iter(c))
    return "\n".join(x for x in lines if x)


def law_rows(root) -> list[tuple]:
    """Articles of a law; a unit that is none or has no number is left out, of a repeated label the last stays."""
    rows: dict[str, tuple] = {}
    for pos, u in enumerate(root.iter("조문단위")):
        number = _leaf(u, "조문번호")
        if _leaf(u, "조문여부") != "조문" or not number:
            continue
        name = article_label("조문단위", number, u.findtext("조문가지번호"), u.findtext("조문키"))
        code = lambda tag: article_label("조", u.findtext(tag), None, None)  # noqa: E731, B023
        rows.pop(name, None)
        rows[name] = (pos, name, True, _leaf(u, "조문제목"), _leaf(u, "조문시행일자"), code("조문이동이전"), code("조문이동이후"), _leaf(u, "조문변경여부") == "Y", unit_text(u))
    return list(rows.values())


def ordinance_rows(root) -> list[tuple]:
    """All units of an ordinance in order, with whether each is an article."""
    units = [u for c in root.iter("조문") for u in c if u.tag == "조"]
    return [(pos, article_label("조", u.findtext("조문번호"), None, None), _leaf(u, "조문여부") == "Y", _leaf(u, "조제목"), "", "", "", False, _leaf(u, "조내용")) for pos, u in enumerate(units)]


# Leaves of an ordinance's head, and the texts that follow its articles.
ORDINANCE_HEAD = {"mst": "자치법규일련번호", "name": "자치법규명", "enforce_date": "시행일자", "promulg_date": "공포일자", "dept": "담당부서명", "phone": "전화번호"}
APPENDED = ("개정문내용", "제개정이유내용")


def ordinance_meta(df: DataFrame, key: str = "mst", xml: str = "body_xml") -> DataFrame:
    """The head of each ordinance and its full text: bodies of all units, then of amendments and reasons, a line each.

    ``key`` is kept as rec_id; the department is the first of several. A missing or damaged
    text, or one without a head, gives no row.
    """
    fields = [*ORDINANCE_HEAD, "full_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                root = parse_record(x.as_py())
                head = root.find("자치법규기본정보") if root is not None else None
                if head is None:
                    continue
                texts = [_leaf(u, "조내용") for c in root.iter("조문") for u in c if u.tag == "조"]
                texts += ["\n".join(t for y in e.itertext() if (t := y.strip())) for tag in APPENDED if (e := root.find(f".//{tag}")) is not None]
                ids.append(i)
                rows.append((*[_leaf(head, tag) for tag in ORDINANCE_HEAD.values()], "\n".join(t for t in texts if t)))
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *[pa.array(c, pa.string()) for c in columns]], ["rec_id", *fields])

    out = df.select(df[key].cast("string"), df[xml]).mapInArrow(run, "rec_id string, " + ", ".join(f"{f} string" for f in fields))
    return out.withColumn("dept", primary_department(F.col("dept")))


def _headed(lines: list[str]) -> dict[str, list[str]]:
    """Lines below the article head that precedes them; lines before any head drop out."""
    heads = [label(int(m[1]), int(m[2] or 0)) if (m := HEAD.match(x.strip())) else None for x in lines]
    out: dict[str, list[str]] = {}
    for owner, line in zip(accumulate(heads, lambda a, b: b or a), lines):
        if owner:
            out.setdefault(owner, []).append(line)
    return out


def rule_rows(root) -> list[tuple]:
    """Articles of an administrative rule: of law style, else of ordinance style, else cut from flat text at article heads."""
    found = law_rows(root)
    if found:
        return found
    rows: dict[str, tuple] = {}
    for pos, u in enumerate(u for c in root.iter("조문") for u in c if u.tag == "조"):
        if _leaf(u, "조문여부") not in ("", "Y"):
            continue
        name = article_label("조", u.findtext("조문번호"), None, None)
        head = HEAD.match(_leaf(u, "조내용"))
        name = name or (label(int(head[1]), int(head[2] or 0)) if head else "")
        if name:
            rows[name] = (pos, name, True, _leaf(u, "조제목"), "", "", "", False, _leaf(u, "조내용"))
    if rows:
        return list(rows.values())
    texts = [x for e in root.iter("조문내용") if (x := (e.text or "").strip())]
    texts = texts or ["\n".join(x for t in root.itertext() if (x := t.strip()))]
    lines = [line for t in texts for line in t.split("\n")]
    return [(pos, name, True, "", "", "", "", False, "\n".join(x).strip()) for pos, (name, x) in enumerate(_headed(lines).items())]


def parsed_articles(df: DataFrame, key: str, xml: str = "body_xml", rows: Callable = law_rows) -> DataFrame:
    """One row per article of each record; a missing or damaged text gives none. Narrow; parse distinct bodies once."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                root = parse_record(x.as_py())
                found = rows(root) if root is not None else []
                ids += [i] * len(found)
                out += found
            columns = list(zip(*out)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *[pa.array(c, t) for c, t in zip(columns, _ARROW)]], [key, *FIELDS])

    return df.select(key, xml).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


def head_field(xml: Column, *tags: str) -> Column:
    """The first non-blank of some leaves, read in the JVM; '' if none. CDATA is unwrapped, named references resolved."""
    found = [F.nullif(F.trim(F.regexp_extract(xml, rf"<{t}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</{t}>", 1)), F.lit("")) for t in tags]
    text = F.coalesce(*found, F.lit(""))
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def law_meta(df: DataFrame, key: str = "law_id", xml: str = "body_xml") -> DataFrame:
    """Name, promulgation, day in force, kind of revision and version signature; null signature if both parts are blank."""
    body = F.coalesce(F.col(xml), F.lit(""))
    day, number = head_field(body, "공포일자"), head_field(body, "공포번호")
    signature = F.when((day != "") | (number != ""), F.concat(day, F.lit("|"), number))
    return df.select(key, head_field(body, "법령명_한글").alias("name"), head_field(body, "행정규칙명", "법령명_한글").alias("rule_name"), head_field(body, "시행일자").alias("enforce_date"), head_field(body, "제개정구분").alias("revise_type"), signature.alias("signature"))


def comparison_rows(root) -> list[tuple]:
    """(label, old, new, day in force) of an old/new comparison document; none if it says that there is none."""
    if (root.findtext(".//신구법존재여부") or "").strip().upper() == "N" or root.find(".//신조문목록") is None:
        return []
    day = re.sub(r"\D", "", root.findtext(".//신조문_기본정보/시행일자") or "")
    side = []
    for tag in ("구조문목록", "신조문목록"):
        lines = [x for e in root.findall(f".//{tag}/조문") if (x := (e.text or "").strip())]
        side.append({k: "\n".join(v) for k, v in _headed(lines).items()})
    old, new = side
    return [(k, old.get(k), new.get(k), day) for k in dict.fromkeys((*old, *new))]


def comparisons(df: DataFrame, key: str, xml: str) -> DataFrame:
    """label, old, new and day of each article of comparison documents."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                root = parse_record(x.as_py())
                found = comparison_rows(root) if root is not None else []
                ids += [i] * len(found)
                out += found
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *[pa.array(c, pa.string()) for c in columns]], [key, "label", "old", "new", "day"])

    return df.select(key, xml).mapInArrow(run, f"{key} {kind}, label string, old string, new string, day string")


def comparison_changed(old: Column, new: Column) -> Column:
    """Whether an article changed, marks of sameness, tags and blanks aside; absent in the new list is no change."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), SAME_MARKS, ""), r"<[^>]+>", ""), r"(?U)\s+", "")
    return F.when(new.isNull(), False).otherwise(plain(old) != plain(new))


def came_from(articles: DataFrame) -> DataFrame:
    """(law_id, label, moved_to, enforce_date, content): the first article that says it moved from a label."""
    came = articles.where("moved_from != ''").groupBy("law_id", F.col("moved_from").alias("label")).agg(F.min(F.struct("pos", F.col("label").alias("to"), "enforce_date", "content")).alias("m"))
    return came.select("law_id", "label", F.col("m.to").alias("moved_to"), F.col("m.enforce_date").alias("enforce_date"), F.col("m.content").alias("content"))


def moved_to(cited: DataFrame, articles: DataFrame) -> DataFrame:
    """For cited (law_id, label) without such an article: the first article that says it moved from there."""
    missing = cited.join(articles.select("law_id", "label"), ["law_id", "label"], "left_anti")
    return missing.join(came_from(articles), ["law_id", "label"], "left").select("law_id", "label", "moved_to", "enforce_date")


def renumbered(missing: DataFrame, articles: DataFrame, by: tuple[str, ...] = ("law_id", "label")) -> DataFrame:
    """(*by, content) rows, law_id among ``by``, matched to the first current article of the same text, blanks aside. Met by hash, then text."""
    plain = F.regexp_replace("content", r"(?U)\s+", "")
    keyed = lambda df: df.withColumn("plain", plain).withColumn("digest", F.xxhash64("plain"))
    now = keyed(articles).select("law_id", "digest", F.col("plain").alias("text"), "pos", F.col("label").alias("to"))
    m = keyed(missing).join(now, ["law_id", "digest"]).where("plain = text")
    return m.groupBy(*by).agg(F.min(F.struct("pos", "to")).alias("m")).select(*by, F.col("m.to").alias("moved_to"))
