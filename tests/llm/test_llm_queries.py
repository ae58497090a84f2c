import os

import duckdb
import pytest

from oddsloom.llm import queries as q

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.mark.parametrize("name", list(q.queries()))
def test_runs_and_agrees(spark, name):
    df = q.queries()[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if sql := q.oracle_sql().get(name):
        con = duckdb.connect()
        for f in os.listdir(D):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(rows) == sorted(want)
