"""Every registered query of the library against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from reportlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(round(v + 0.0, 6))
    if hasattr(v, "isoformat"):
        return str(v)[:10] if str(v)[10:] == ' 00:00:00' else str(v)
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_its_twin(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, want.fetchall())
