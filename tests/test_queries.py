"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from hushdex.plans import contract
from hushdex.plans import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


QUERIES, SQL = core.queries() | contract.queries(), core.oracle_sql() | contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.execute(SQL[name])
    names = [d[0] for d in want.description]
    rows = sorted(tuple(map(str, r)) for r in want.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["entry_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
