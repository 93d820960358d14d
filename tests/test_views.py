import os

import duckdb
import pytest

from lexmill.plans import views as P

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_dated_list_is_whole(spark, tmp_path):
    for f in ("ordinances", "findings"):
        os.symlink(f"{SF}/{f}.parquet", tmp_path / f"{f}.parquet")
    con = duckdb.connect()
    for f in ("ordinances", "findings"):
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{tmp_path}/{f}.parquet'")
    rows = [tuple(r) for r in P.list_all_by_date(spark, str(tmp_path)).select("mst", "day").collect()]
    assert len(rows) > 100 and rows == con.execute(P.R.oracles["list_all_by_date"]).fetchall()
