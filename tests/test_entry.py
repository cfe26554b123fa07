import os

import duckdb
import pytest

import __spark_entry__ as entry
from wayfare.plans import problems, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            c.execute(f"create view {name[:-8]} as select * from '{FOLDER}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES | problems.ORACLES))
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(map(show, r)) for r in df.select(*names).collect()) == sorted(tuple(map(show, r)) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
