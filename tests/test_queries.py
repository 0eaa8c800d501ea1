"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from leafmill.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (bool,)) or not isinstance(v, (int, float)) and not (hasattr(v, "dtype") and v.dtype.kind in "iuf"):
        return str(v)
    return repr(round(float(v), 6))


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        wanted = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        assert rows(got) == rows(wanted)
    else:
        assert len(got)


def test_every_oracle_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
