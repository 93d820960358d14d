"""Decision tables for a cited clause, as one native expression each.

A verdict is a struct: category, severity, change_type, detail (a sentence), evidence (the
texts it rests on), clause_enforce and old_enforce (the day of the clause now and then),
clause_detail (the unit the texts were narrowed to).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import basis_days, day_of, eight_digits, let, narrow_unit, unit_label, without_blanks
from lexmill.functions.wording import DETAIL, say
from lexmill.operators.articles import comparison_changed

# How much of a text is shown as evidence, of a whole one, of one that is gone, of two compared.
SHOWN, GONE, COMPARED = 200, 160, 3000
FIELDS = ("category", "severity", "change_type", "detail", "evidence", "clause_enforce", "old_enforce", "clause_detail")


def verdict(category: str, severity: str, change: str, detail: Column, evidence: Column | None = None, now: Column | None = None, was: Column | None = None, unit: Column | None = None) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    values = (F.lit(category), F.lit(severity), F.lit(change), detail, text(evidence), text(now), text(was), text(unit))
    return F.struct(*[v.alias(n) for n, v in zip(FIELDS, values)])


def _gap(was: Column, now: Column, two: str, one: str) -> Column:
    return F.when(was != now, say(two, was=was, now=now)).otherwise(say(one, now=now))


def check_clause(article: Column, moved: Column, own_day: Column, hang: Column, ho: Column, mok: Column, label: Column | None = None, moved_day: Column | None = None, moved_text: Column | None = None) -> Column:
    """Judge a clause against the current law alone.

    article: struct(content, enforce_date) or null if the label is missing; moved: the
    label it went to or null, with the day and text of that article; own_day: the
    ordinance's day. First match counts.
    """
    content, clause = article["content"], label if label is not None else F.lit("")
    cut = lambda c: F.substring(c, 1, SHOWN)

    def judged(unit: Column, days: Column, whole: Column) -> Column:
        name = F.when(unit.isNotNull(), unit_label(hang, ho, mok)).otherwise("")
        shown = cut(F.coalesce(unit, content))
        apart = F.coalesce(F.datediff(day_of(days["now"]), day_of(own_day)), F.lit(0))
        amended = say(DETAIL["amended"], what=F.when(name != "", F.concat(F.lit("인용한 "), name)).otherwise("인용 조항"), own=own_day, gap=_gap(days["was"], days["now"], "개정 {was}→{now}", "개정일 {now}"), days=apart)
        later = day_of(article["enforce_date"]) > day_of(own_day)
        return (
            F.when(article.isNull() & moved.isNotNull(), verdict("status", "mechanical", "", say(DETAIL["moved_here"], clause=clause, to=moved), cut(moved_text) if moved_text is not None else None, moved_day))
            .when(article.isNull(), verdict("status", "check", "", say(DETAIL["missing"], clause=clause)))
            .when(day_of(own_day).isNull(), verdict("timing", "check", "", F.lit(DETAIL["no_day"]), cut(content), article["enforce_date"]))
            .when(days["amended_after"], verdict("timing", "review", "", amended, shown, days["now"], days["was"], name))
            .when(days.isNotNull(), verdict("current", "current", "", say(DETAIL["not_amended"], unit=F.when(name != "", name).otherwise("조항"), now=days["now"]), shown, days["now"], days["was"], name))
            .when(unit.isNotNull() & F.coalesce(whole["amended_after"], F.lit(False)), verdict("timing", "check", "호미확인", say(DETAIL["unit_unsure"], clause=clause, now=whole["now"], unit=name), shown, whole["now"], None, name))
            .when(later, verdict("timing", "check", "", say(DETAIL["later_article"], day=article["enforce_date"]), shown, article["enforce_date"], None, name))
            .otherwise(verdict("current", "current", "", F.lit(DETAIL["no_history"]), shown, article["enforce_date"], None, name))
        )

    by_days = lambda unit: let(basis_days(F.coalesce(unit, content), own_day), lambda days: let(basis_days(content, own_day), lambda whole: judged(unit, days, whole)))
    return let(narrow_unit(content, hang, ho, mok), by_days)


def diff_clause(now: Column, then: Column, moved: Column, own_day: Column, hang: Column, ho: Column, mok: Column, label: Column | None = None, old_day: Column | None = None, now_day: Column | None = None) -> Column:
    """Judge a clause by the text then and now (null if the label is missing).

    moved: the current article of the old text; old_day: the day of the version then;
    now_day: the day of the current article.
    """
    clause, own = label if label is not None else F.lit(""), eight_digits(own_day)
    blank = F.lit("")
    then_day, today = old_day if old_day is not None else blank, now_day if now_day is not None else blank
    both = lambda a, b: F.concat(F.when(a.isNotNull() & (a != ""), F.concat(F.lit("[당시] "), F.substring(a, 1, COMPARED), F.lit("\n"))).otherwise(""), F.lit("[현행] "), F.substring(b, 1, COMPARED))

    def judged(days: Column, part_now: Column, part_then: Column) -> Column:
        narrowed = part_now.isNotNull() & part_then.isNotNull()
        name = unit_label(hang, ho, mok)
        unit = F.concat(clause, name)
        clause_day, was = F.coalesce(days["now"], today), F.coalesce(days["was"], then_day)
        same = lambda detail, evidence=None, part=None: verdict("current", "current", "동일", detail, evidence, clause_day, was, part)
        changed = lambda detail, evidence, part=None: verdict("timing", "review", "내용변경", detail, evidence, clause_day, was, part)
        gone = F.substring(then, 1, GONE)
        return (
            F.when(now.isNull() & then.isNotNull() & moved.isNotNull(), verdict("status", "review", "번호이동", say(DETAIL["renumbered"], clause=clause, to=moved), gone, None, then_day))
            .when(now.isNull() & then.isNotNull(), verdict("status", "review", "삭제", say(DETAIL["deleted"], clause=clause), gone, None, then_day))
            .when(now.isNull(), verdict("status", "check", "미확인", say(DETAIL["nowhere"], clause=clause), None, None, then_day))
            .when(narrowed & (without_blanks(part_now) == without_blanks(part_then)), same(say(DETAIL["unit_same"], clause=unit), None, name))
            .when(narrowed, changed(say(DETAIL["unit_changed"], clause=unit, own=own), both(part_then, part_now), name))
            .when(days["amended_after"], changed(say(DETAIL["tag_changed"], clause=clause, own=own, gap=_gap(days["was"], days["now"], " (개정 {was}→{now})", "")), both(then, now)))
            .when(days.isNotNull(), same(say(DETAIL["tag_same"], clause=clause, now=days["now"])))
            .when(then.isNotNull() & (without_blanks(now) != without_blanks(then)), changed(say(DETAIL["text_changed"], clause=clause), both(then, now)))
            .when(then.isNotNull(), same(F.lit(DETAIL["text_same"])))
            .otherwise(same(say(DETAIL["new_since"], clause=clause)))
        )

    unit = lambda text: narrow_unit(text, hang, ho, mok)
    return let(basis_days(now, own_day), lambda d: let(unit(now), lambda a: let(unit(then), lambda b: judged(d, a, b))))


def rule_changed(old: Column, new: Column, pair_day: Column, own_day: Column) -> Column:
    """Whether a comparison newer than the ordinance changes the clause."""
    later = (F.length(eight_digits(pair_day)) == 8) & (eight_digits(own_day) != "") & (eight_digits(pair_day) > eight_digits(own_day))
    return F.coalesce(later & comparison_changed(old, new), F.lit(False))


def judge_rule(old: Column, new: Column, pair_day: Column, own_day: Column, otherwise: Column) -> Column:
    """Judge a clause of an administrative rule: changed by a comparison newer than the ordinance, else the verdict ``otherwise``, both marked as of a rule."""
    dashed = F.concat_ws("-", F.substring(pair_day, 1, 4), F.substring(pair_day, 5, 2), F.substring(pair_day, 7, 2))
    changed = verdict("timing", "review", "내용변경", say(DETAIL["rule_changed"], own=own_day, day=dashed), F.substring(old, 1, SHOWN), pair_day)
    marked = lambda v: F.struct(*[(say(DETAIL["rule"], detail=v[f]) if f == "detail" else v[f]).alias(f) for f in FIELDS])
    return F.when(rule_changed(old, new, pair_day, own_day), changed).otherwise(let(otherwise, marked))
