"""The SQL of the registered queries gives their rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quorumlake.llm import queries

DIR = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DIR.exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, str(DIR))
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, want.fetchall()))
