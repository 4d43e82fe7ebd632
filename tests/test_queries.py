"""Registered queries against their SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow to start or covered at a larger size elsewhere.
QUICK = sorted(set(catalog.ORACLES) - {"shortest_path", "duplicate_groups"})

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=str)
    theirs = sorted((tuple(map(plain, r)) for r in want.select(*columns).fetchall()), key=str)
    assert ours == theirs


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
