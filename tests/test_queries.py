"""Queries against their SQL on a small table set, where it is there."""

import os

import pytest

from parlance.oracle import ORACLE_SQL
from parlance.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "nation customer orders lineitem documents benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the table set")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([round(r[k], 6) if isinstance(r[k], float) else str(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, map(tuple, got.collect())) == canonical(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
