"""Every query of the library against its SQL on the small tables."""

import collections
import datetime
import os

import duckdb
import pytest

from palimpsest.plans import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = collections.Counter(tuple(map(plain, r)) for r in df.collect())
    assert got
    if name in ORACLE_SQL:
        out = duck.sql(ORACLE_SQL[name])
        assert sorted(out.columns) == sorted(df.columns)
        at = [out.columns.index(c) for c in df.columns]
        assert got == collections.Counter(tuple(plain(r[i]) for i in at) for r in out.fetchall())
