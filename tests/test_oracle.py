"""Every registered chain query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from blockframe.plans import landing  # noqa: F401
from blockframe.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, datetime.date):
        return str(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return int(v) if v == int(v) else round(float(v), 9)
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert got == want
