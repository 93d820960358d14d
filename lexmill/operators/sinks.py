"""Writing results: report files, a site of JSON files, a slim copy of the tables.

Large results are written by the executors. Only report files for people, which are
small by their nature, pass through the driver, and only up to a stated number of rows.
"""

from __future__ import annotations

import csv
import html
import json
import os
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import delete, exists, rename

REPORT_ROWS = 100_000


def _bounded(df: DataFrame, rows: int) -> list:
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report file holds at most {rows} rows; write the frame with write_json instead")
    return got


def write_csv(df: DataFrame, path: str, footer: str | None = None, rows: int = REPORT_ROWS) -> str:
    """One CSV file for spreadsheets: UTF-8 with a byte order mark, a footer line at the end."""
    got = _bounded(df, rows)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(["" if v is None else v for v in r] for r in got)
        if footer:
            out.writerows([[], [footer]])
    return path


def write_html(df: DataFrame, path: str, title: str, rows: int = REPORT_ROWS, markup: Iterable[str] = ()) -> str:
    """One HTML table; columns named in ``markup`` hold HTML already, all others are escaped."""
    raw = set(markup)
    cell = lambda c, v: "" if v is None else str(v) if c in raw else html.escape(str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(c, v)}</td>" for c, v in zip(df.columns, r)) + "</tr>" for r in _bounded(df, rows))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>")
    return path


def write_json(df: DataFrame, path: str, by: str | None = None) -> str:
    """JSON lines written by the executors, in a folder per value of ``by``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)
    return path


def write_site(frames: dict[str, DataFrame], folder: str, rows: int = REPORT_ROWS) -> list[str]:
    """One JSON file per named view for a static site."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for name, df in frames.items():
        path = os.path.join(folder, f"{name}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump([r.asDict(recursive=True) for r in _bounded(df, rows)], f, ensure_ascii=False, default=str)
        out.append(path)
    return out


def slim_copy(tables: dict[str, DataFrame], folder: str, without: Iterable[str] = ("body_xml",), leave_out: Iterable[str] = ("laws", "law_versions", "law_articles")) -> list[str]:
    """The tables a viewer needs, without bodies and without the tables of law texts."""
    skip, drop = set(leave_out), set(without)
    kept = []
    for name, df in tables.items():
        if name not in skip:
            df.select(*[c for c in df.columns if c not in drop]).write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))
            kept.append(name)
    return kept


def zip_folder(folder: str, path: str) -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(folder):
            for f in sorted(files):
                full = os.path.join(base, f)
                z.write(full, os.path.relpath(full, folder))
    return path


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether a table stands at ``path``; a state that a crash left aside is put back first."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        rename(spark, f"{path}.old", path)
    return exists(spark, path)


def swap(df: DataFrame, path: str) -> DataFrame:
    """Put a new state of a table in place of the old, on any file system.

    The new state is written beside the old one, which is set aside and removed last, so
    a table that is read is never overwritten and at every moment one whole state exists.
    """
    spark = df.sparkSession
    there = recovered(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    delete(spark, f"{path}.old")
    if there:
        rename(spark, path, f"{path}.old")
    rename(spark, f"{path}.new", path)
    delete(spark, f"{path}.old")
    return spark.read.parquet(path)


def persist_tables(frames: dict[str, DataFrame], folder: str, evidence: int = 8000) -> None:
    """Derived tables of an analysis, rebuilt as a whole; generic names are no citations, evidence is cut for display."""
    for name, df in frames.items():
        if name == "citations":
            df = df.where("cite_type IS DISTINCT FROM '기타'")
        if "evidence" in df.columns:
            df = df.withColumn("evidence", F.substring("evidence", 1, evidence))
        swap(df, os.path.join(folder, f"{name}.parquet"))
