"""Every query against its SQL, run by DuckDB on the same tables."""

import decimal
import os

import duckdb
import pytest

from sluicework.plans import MODULES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {n: (f, m.SQL.get(n)) for m in MODULES for n, f in m.QUERIES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF_DIR)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if sql is None:
        assert rows
        return
    expected = duck.sql(sql)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted([plain(r[i]) for i in at] for r in expected.fetchall())
