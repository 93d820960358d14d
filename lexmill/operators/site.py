"""Reports for people and a static site: one file per ordinance and department, lists for the rest.

The large part, a file per ordinance, is written by the executors; what passes through the
driver is one department or one list, bounded like every report file.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import escape_html, format_day
from lexmill.operators.report import in_order
from lexmill.operators.sinks import REPORT_ROWS, write_csv, write_json, write_site

FORBIDDEN = r'[\\/:*?"<>|]'  # fixed value: signs no file name may hold


def safe_name(name: str) -> str:
    """A name as a file name."""
    return re.sub(FORBIDDEN, "_", name)


def basis_line() -> Column:
    """The days a judgement rests on: the ordinance's, the law's then, the clause's now."""
    day = lambda c: F.concat(F.lit("<b>"), escape_html(format_day(F.col(c))), F.lit("</b>"))
    return F.concat(F.lit('<div class="basis">'), day("ord_enforce"), F.lit(" · "), day("old_enforce"), F.lit(" → "), day("clause_enforce"), F.lit("</div>"))


def item_blocks(items: DataFrame) -> DataFrame:
    """A block of HTML per item: grade, law and clause, what to do, days and evidence."""
    text = lambda c: escape_html(F.coalesce(F.col(c), F.lit("")))
    evidence = F.when(F.col("evidence") != "", F.concat(F.lit('<pre class="evidence">'), text("evidence"), F.lit("</pre>"))).otherwise("")
    body = F.concat(
        F.lit('<div class="item g-'), F.col("grade"), F.lit('"><h3>「'), text("law_name"), F.lit("」 "), text("clause_label"), text("clause_detail"), F.lit("</h3><p>"),
        F.coalesce(F.col("action_html"), text("action")), F.lit("</p>"), basis_line(), evidence, F.lit("</div>"),
    )
    return items.withColumn("html", body)


def fragments(items: DataFrame) -> DataFrame:
    """(mst, ord_name, html): the items of each ordinance in their order, below headings of consecutive articles; an ordinance is one row, as its report is one file."""
    order = ["article_jo", "seq", "clause_jo", "clause_ga", "id"]
    rows = item_blocks(items).groupBy("mst", "ord_name").agg(F.array_sort(F.collect_list(F.struct(*order, "ord_clause", "html"))).alias("x"))
    head = lambda c: F.concat(F.lit("<h2>"), escape_html(c), F.lit("</h2>"))
    same = lambda i: F.get(F.col("x"), i - 1)["ord_clause"]
    piece = F.transform("x", lambda e, i: F.concat(F.when((i == 0) | (e["ord_clause"] != same(i)), head(e["ord_clause"])).otherwise(""), e["html"]))
    return rows.select("mst", "ord_name", F.array_join(piece, "").alias("html"))


def page(title: str, body: str) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1>{body}"


def write_report(items: DataFrame, path: str, title: str, footer: str = "", rows: int = REPORT_ROWS) -> str:
    """One HTML report of all items, ordinances of most weight first."""
    import html

    order = items.groupBy("mst").agg(F.max("priority").alias("priority"))
    parts = fragments(items).join(order, "mst").orderBy(F.desc("priority"), "ord_name", "mst").limit(rows + 1).collect()
    if len(parts) > rows:
        raise ValueError(f"a report file holds at most {rows} ordinances; write a site instead")
    body = "".join(f"<section><h1>{html.escape(r.ord_name)}</h1>{r.html}</section>" for r in parts)
    with open(path, "w", encoding="utf-8") as f:
        f.write(page(html.escape(title), body + f"<footer>{html.escape(footer)}</footer>"))
    return path


CSV_COLUMNS = ("ord_dept", "ord_name", "ord_day", "ord_clause", "grade", "law_name", "clause_label", "change_type", "action", "old_enforce", "clause_enforce")


def write_grade(items: DataFrame, grade: str, path: str, footer: str | None = None) -> str:
    """The items of one grade as a CSV file, by department."""
    chosen = items.where(F.col("grade") == grade).orderBy("ord_dept", "ord_name", "seq", "id")
    return write_csv(chosen.select(*CSV_COLUMNS), path, footer)


def write_static(folder: str, items: DataFrame, articles: DataFrame, lists: dict[str, DataFrame], departments: list[str], footer: str | None = None) -> list[str]:
    """A site: the lists as JSON, the articles and fragments of every ordinance in a folder of its own, CSV and HTML per department and grade with something to do."""
    out = write_site(lists, folder)
    write_json(articles, os.path.join(folder, "ordinance"), "mst")
    write_json(fragments(items), os.path.join(folder, "fragment"), "mst")
    for k, d in enumerate(departments):  # a list of departments, numbered as in the list
        of_dept = in_order(items.where(F.col("ord_dept") == d))
        if of_dept.isEmpty():
            continue
        out.append(write_csv(of_dept.select(*CSV_COLUMNS), os.path.join(folder, f"dept_{k}.csv"), footer))
        out.append(write_report(of_dept, os.path.join(folder, f"dept_{k}.html"), d, footer or ""))
    for grade in ("mechanical", "review", "check", "format"):
        out.append(write_grade(items, grade, os.path.join(folder, f"grade_{grade}.csv"), footer))
    return out
