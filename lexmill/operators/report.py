"""Findings as the items of a report: what to do, in which order, below which ordinance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import escape_html, finding_grade, label_numbers, let, particle
from lexmill.functions.wording import ACTION, ANY_PLACE, NO_LAW_NAME, NO_NAME, PLACE, say

#: Columns a finding is read from; a frame may lack some, which then count as empty.
READ = ("law_name", "law_id", "clause_label", "clause_detail", "severity", "change_type", "ord_clause", "detail", "evidence", "ord_enforce", "old_enforce", "clause_enforce")
LAST = 999_999  # place of a finding without one


def _or(c: Column, other: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.lit(other))


def _slots() -> dict[str, Column]:
    """The columns a sentence may name; blank columns are ''."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    law, clause, here = _or(F.col("law_name"), NO_LAW_NAME), blank("clause_label"), blank("ord_clause")
    place = F.when(here != "", say(PLACE, article=here)).otherwise(F.lit(ANY_PLACE))
    behind = F.when(clause != "", F.concat(F.lit(" "), clause)).otherwise("")
    bare, quoted = F.concat(law, behind), F.concat(F.lit("「"), law, F.lit("」"), behind)
    return {
        "law": law, "clause": clause, "place": place, "detail": blank("detail"), "unit": blank("clause_detail"), "which": _or(F.col("clause_detail"), "해당 호"),
        "bare": bare, "quoted": quoted, "bare_particle": particle(bare, "을", "를"), "quoted_particle": particle(quoted, "으로", "로"),
    }


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("int"), F.lit(0)) != 0


def action() -> Column:
    """One sentence that says what to do about a finding; columns as in ``READ`` with cite_naked and cite_spacing."""
    slots = _slots()
    line = {k: say(v, **slots) for k, v in ACTION.items()}
    change, current = F.coalesce(F.col("change_type"), F.lit("")), F.col("severity") == "current"
    grade = finding_grade(F.col("severity"), F.col("change_type"), F.lit(0), F.lit(0))
    base = F.when(grade == "mechanical", line["mechanical"])
    for kind in ("내용변경", "삭제"):
        base = base.when((grade == "review") & (change == kind), line[kind])
    base = base.when(grade == "review", line["review"])
    for kind in ("지자체행정규칙", "법령미해결", "당시부재", "호미확인"):
        base = base.when(change == kind, line[kind])
    also = F.concat(F.when(_flag("cite_naked"), line["also_naked"]).otherwise(""), F.when(_flag("cite_spacing"), line["also_spacing"]).otherwise(""))
    return (
        F.when(change == "제명변경", F.when(slots["detail"] != "", slots["detail"]).otherwise(line["renamed"]))
        .when(current & _flag("cite_naked"), line["naked_only"])
        .when(current & _flag("cite_spacing"), line["spacing_only"])
        .otherwise(F.concat(base.otherwise(line["check"]), also))
    )


def action_html() -> Column:
    """The same sentence with the former and the new wording marked where a name or a form is to be mended."""
    slots, change = _slots(), F.coalesce(F.col("change_type"), F.lit(""))
    esc = escape_html
    mark = lambda css, c: F.concat(F.lit(f'<span class="{css}">'), c, F.lit("</span>"))
    first = lambda text, what, by: F.when(F.instr(text, what) > 0, F.concat(F.substr(text, F.lit(1), F.instr(text, what) - 1), by, F.substr(text, F.instr(text, what) + F.length(what)))).otherwise(text)
    new = F.regexp_extract(slots["detail"], r"현행\s*「([^」]+)」", 1)
    quoted = lambda c: F.concat(F.lit("「"), esc(c), F.lit("」"))
    renamed = let(first(esc(slots["detail"]), quoted(slots["law"]), mark("fx-old", quoted(slots["law"]))), lambda t: first(t, quoted(new), mark("fx-new", quoted(new))))
    clause = F.when(slots["clause"] != "", F.concat(F.lit(" "), slots["clause"])).otherwise("")
    added = F.concat(F.lit('<ins class="fx-brk">「</ins>'), esc(slots["law"]), F.lit('<ins class="fx-brk">」</ins>'), esc(clause))
    form = F.concat(
        F.lit('(서식만 정비) "'), mark("fx-old", esc(slots["bare"])), F.lit('"'), slots["bare_particle"], F.lit(' "'), mark("fx-new", added), F.lit('"'), slots["quoted_particle"],
        F.lit(" 정정 — <b>내용 변경은 없음</b> ("), esc(slots["place"]), F.lit(")"),
    )
    return F.when((change == "제명변경") & (new != ""), renamed).when((change != "제명변경") & (F.col("severity") == "current") & _flag("cite_naked"), form).otherwise(esc(action()))


def report_items(findings: DataFrame, ordinances: DataFrame, mst: str | None = None, dept: str | None = None, include_current: bool = False) -> DataFrame:
    """The items of a report, one row each, with the ordinance's name, department, day and the keys of the order.

    ``mst`` or ``dept`` restrict it to an ordinance or a department (blank ones are of no
    department, asked for as ''); findings that need nothing are items only with
    ``include_current``, with a fixed sentence and no evidence. Columns that a frame lacks
    count as empty. Sort by priority DESC, ord_name, mst, article_jo, seq, clause_jo,
    clause_ga, id for the order of the report.
    """
    f = findings
    for c in (*READ, "ord_seq", "cite_naked", "cite_spacing"):
        f = f if c in f.columns else f.withColumn(c, F.lit(None).cast("int" if c.startswith(("ord_seq", "cite")) else "string"))
    o = ordinances.select("mst", F.col("name").alias("ord_name"), F.col("dept").alias("ord_dept"), F.col("enforce_date").alias("ord_day"))
    f = f.where(F.col("mst") == mst) if mst is not None else f
    o = o.where(F.coalesce("ord_dept", F.lit("")) == dept) if dept is not None else o
    f = f.join(o, "mst", "inner" if dept is not None else "left")
    f = f.withColumn("grade", finding_grade(F.col("severity"), F.col("change_type"), F.col("cite_naked").cast("int"), F.col("cite_spacing").cast("int")))
    n = lambda g: F.count_if(F.col("grade") == g)
    weights = f.groupBy("mst").agg((n("mechanical") * 100 + n("review") * 10 + n("check")).alias("priority"))
    f = f if include_current else f.where("grade != 'current'")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    current = F.col("grade") == "current"
    article, clause = label_numbers(blank("ord_clause")), label_numbers(blank("clause_label"))
    day = _or(F.col("ord_day"), "")
    return f.join(weights, "mst").select(
        "id", "mst", _or(F.col("ord_name"), NO_NAME).alias("ord_name"), blank("ord_dept").alias("ord_dept"), F.when(day != "", day).otherwise(blank("ord_enforce")).alias("ord_day"), "priority", "grade",
        blank("law_name").alias("law_name"), blank("law_id").alias("law_id"), blank("clause_label").alias("clause_label"), blank("clause_detail").alias("clause_detail"),
        F.when(current, "동일").otherwise(blank("change_type")).alias("change_type"), blank("ord_clause").alias("ord_clause"),
        F.when(current, F.lit(ACTION["nothing"])).otherwise(action()).alias("action"), F.when(current, F.lit("")).otherwise(action_html()).alias("action_html"), F.when(current, F.lit("")).otherwise(blank("evidence")).alias("evidence"),
        F.when(blank("ord_enforce") != "", F.col("ord_enforce")).otherwise(day).alias("ord_enforce"), blank("old_enforce").alias("old_enforce"), blank("clause_enforce").alias("clause_enforce"),
        article["jo"].alias("article_jo"), F.coalesce("ord_seq", F.lit(LAST)).alias("seq"), clause["jo"].alias("clause_jo"), clause["ga"].alias("clause_ga"),
    )


ORDER = (F.desc, "priority"), (F.asc, "ord_name"), (F.asc, "mst"), (F.asc, "article_jo"), (F.asc, "seq"), (F.asc, "clause_jo"), (F.asc, "clause_ga"), (F.asc, "id")


def in_order(items: DataFrame) -> DataFrame:
    return items.orderBy(*[by(c) for by, c in ORDER])
