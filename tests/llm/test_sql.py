"""Operators that SQL can express, against their SQL over the given tables."""

from __future__ import annotations

import duckdb
import pytest

from blockframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_fim"])
def test_query_equals_its_sql(spark, sf, name):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    types = [str(c[1]) for c in want.description]
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    same = {"BIGINT": "bigint", "INTEGER": "int", "STRING": "string", "NUMBER": None, "VARCHAR": "string"}
    assert all(same.get(t) in (None, dict(df.dtypes)[c]) for c, t in zip(columns, types, strict=True))
    rows = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows and rows == sorted(want.fetchall(), key=repr)
