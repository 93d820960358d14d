"""The registered queries against their SQL on the smallest tables, where these are present."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
FAST = ("p2_found", "p2_runs", "p6_found", "primary_dept", "basis_dates", "clause_token_items", "scan_grades", "dept_groups", "resolve_names", "affected_by_change", "version_delta", "law_cards", "actionable_citations", "section_islands", "ordinance_upsert", "law_articles_roundtrip", "extract_roundtrip", "highlight_spans")


def test_every_oracle_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert all(f"p{n}_found" in driver.queries() for n in (1, 2, 4, 5, 6))


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(driver.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert Counter(tuple(map(str, r)) for r in df.select(*columns).collect()) == Counter(tuple(str(r[at[c]]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in driver.queries() if n not in getattr(driver.llm, "QUERIES", {})])
def test_empty_tables(spark, name, tmp_path_factory):
    import pyarrow.parquet as pq

    folder = tmp_path_factory.getbasetemp() / "empty"
    if not folder.exists():
        folder.mkdir()
        for f in os.listdir(SF):
            pq.write_table(pq.read_table(f"{SF}/{f}").slice(0, 0), folder / f)
    assert driver.queries()[name](spark, str(folder)).count() == (name in ("overview_totals", "report_summary", "batch_meta"))
