"""Every query that has SQL against DuckDB on the smallest tables, and that all others run."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def value(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(x))
    return x


def rows(df: pd.DataFrame) -> Counter:
    return Counter(tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    return con


CORE = [n for n in entry.queries() if not n.startswith(("p4_", "p5_", "p6_", "p7_", "p8_", "p9_"))]


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, D).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in CORE if n not in entry.oracle_sql()])
def test_runs(spark, name):
    df = entry.queries()[name](spark, D)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    out = df.toPandas()
    if name.endswith("_found"):
        assert not out.duplicated().any()
