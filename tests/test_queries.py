"""Every query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import math
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tracewright import queries as Q

SF = "/root/testdata/sf0.001"
Q.load()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    found = duck.execute(Q.ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    assert sorted(df.columns) == columns
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.ORACLE_SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() >= 0
