"""Every registered query against its SQL, on the smallest tables where they are present."""

import math
import os

import duckdb
import pytest

from revlake import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    found = duck.sql(queries.ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns)
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_rows_only_queries(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        assert queries.QUERIES[name](spark, DATA).count() > 0
