"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others give rows of a stable schema."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quorumlake.plans import all_queries, all_sql

DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, str(DIR))
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if sql := all_sql().get(name):
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in got.fetchall())
    else:
        assert df.schema == all_queries()[name](spark, str(DIR)).schema
