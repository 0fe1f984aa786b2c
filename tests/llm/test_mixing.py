from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from blockframe.llm import mixing


def times(doc_id, rate, seed=42):
    u = int(hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 16**13
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p = p * rate / k
        c += p
        if k > rate + 12 * math.sqrt(rate) + 30:
            break
    return k


def test_counts_follow_the_distribution(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(3000)] + [(None, None), (7, "big")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("copy", F.lit("clash"))
    out = mixing.replicate(df, alpha=0.5, epochs=2.0)
    assert out.columns == ["doc_id", "source", "copy"]
    n = Counter(s for _, s in rows)
    root = sum(math.sqrt(x) for x in n.values())
    rate = {s: math.sqrt(x) / root * len(rows) * 2 / x for s, x in n.items()}
    want = Counter()
    for i, s in rows:
        for k in range(times(i, rate[s])):
            want[i, s, k] += 1
    assert Counter((r.doc_id, r.source, r.copy) for r in out.collect()) == want
    per = Counter(s for _, s, _ in want.elements())
    assert abs(per["small"] / per["big"] - math.sqrt(n["small"] / n["big"])) < 0.1


def test_given_weights_and_edges(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "t"), (3, None, "t")], "doc_id long, source string, text string")
    got = {r.source for r in mixing.replicate(df, weights={"a": 1.0}, epochs=20.0).collect()}
    assert got == {"a"}
    assert {r.source for r in mixing.replicate(df, weights={None: 2.0, "zz": 1.0}, epochs=20.0).collect()} == {None}
    assert mixing.replicate(df, weights={}).collect() == []
    assert mixing.replicate(df.limit(0)).collect() == []


def test_query_against_sql(spark, sf):
    import duckdb

    from blockframe.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(ORACLE_SQL["op7_mixing"])
    names = [d[0] for d in cur.description]
    want = sorted(repr(dict(sorted(zip(names, r)))) for r in cur.fetchall())
    got = sorted(repr(dict(sorted(r.asDict().items()))) for r in QUERIES["op7_mixing"](spark, sf).collect())
    assert got == want


def test_plan_is_native(spark, sf):
    plan = mixing.replicate(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
