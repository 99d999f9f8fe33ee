"""The driver's contract, and every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexispark import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return found


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, name):
    found = engine.queries()[name](spark, SF)
    rows = found.collect()
    sql = engine.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    expected = duck.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(found.columns)
    assert plain([[r[n] for n in names] for r in rows]) == plain(expected.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
