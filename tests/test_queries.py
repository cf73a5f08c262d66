"""Every point-cloud query against its SQL."""

import os

import duckdb
import pytest

from cloudloom.jobs import registry

FOLDER = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(columns)
    clean = lambda v: round(v, 8) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(clean(v[columns.index(c)]) for c in order)) for v in values)


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, database, name):
    got = registry.queries()[name](spark, FOLDER)
    want = database.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
