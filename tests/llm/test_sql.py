"""Queries of this subpackage against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from hushdex.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = llm.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_names_are_complete():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in llm.queries()} == {f"op{k}" for k in range(1, 11)}
    assert {*llm.queries(), "pipeline"} <= set(entry.queries())
