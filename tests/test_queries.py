"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from rondelle.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    assert got
    if name in catalog.oracle_sql():
        want = con.sql(catalog.oracle_sql()[name])
        columns = sorted(want.columns)
        assert columns == sorted(df.columns)
        at = [want.columns.index(c) for c in columns]
        assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() and set(entry.oracle_sql()) <= set(entry.queries())
