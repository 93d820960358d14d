"""Jobs by name: ``python -m lexmill VERB --tables FOLDER [--out FOLDER] ...``."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession

from lexmill import config, jobs
from lexmill.operators.report import in_order, report_items
from lexmill.operators.site import write_report, write_static
from lexmill.plans import documents, reports, views
from lexmill.session import let_workers_import
from lexmill.sources.source import TableSource
from lexmill.sources.tables import table


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    p.add_argument("verb", choices=("batch", "reparse", "report", "site", "changes", "ordinance"))
    p.add_argument("--tables", required=True, help="folder of the stored tables")
    p.add_argument("--out", default=".", help="folder written to")
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("--mst", help="one ordinance")
    p.add_argument("--shallow", action="store_true", help="without versions of the day")
    p.add_argument("--limit", type=int, help="first ordinances of a trial run")
    a = p.parse_args(argv)
    known = config.load(a.config)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    let_workers_import(spark)
    now = datetime.datetime.now().isoformat(" ", "seconds")
    if a.verb == "batch":
        jobs.run_batch(spark, TableSource(spark, a.tables), a.out, jobs.Settings(known.local_prefix, not a.shallow, "ok", now, a.limit))
    elif a.verb == "reparse":
        jobs.reparse(spark, a.tables, a.out, known.local_prefix, False if a.shallow else None, now)
    elif a.verb == "changes":
        reports.change_list(spark, a.tables, spark.createDataFrame([], "law_id string, new_key string, acked boolean, at timestamp_ntz")).show(50, truncate=60)
    elif a.verb == "ordinance":
        for name, df in documents.ordinance_detail(spark, a.tables, a.mst or "").items():
            print(name)
            df.show(20, truncate=60)
    else:
        items = report_items(table(spark, a.tables, "findings"), views.ordinances(spark, a.tables), a.mst)
        if a.verb == "report":
            print(write_report(items, f"{a.out}/report.html", known.region or "report"))
        else:
            lists = {"overview": views.overview_depts(spark, a.tables), "ordinances": views.list_sorted_by_date(spark, a.tables)}
            depts = [r[0] for r in views.departments(spark, a.tables).select("dept").orderBy("dept").collect()]  # one row per department
            print(*write_static(a.out, in_order(items), documents.ordinance_detail_articles(spark, a.tables), lists, depts), sep="\n")


if __name__ == "__main__":
    main()
