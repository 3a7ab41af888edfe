"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from notelake.plans import queries, steps  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def form(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if name in queries.ORACLE_SQL:
        found = sql.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(names)
        want = sorted(tuple(form(dict(zip(names, r))[c]) for c in sorted(names)) for r in found.fetchall())
        assert sorted(tuple(form(r[c]) for c in sorted(names)) for r in rows) == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
