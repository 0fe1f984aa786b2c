"""What a family of totals doesn't have is neither decoded nor added up."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from blockframe.operators import backfill, decode
from blockframe.plans.chain import SPAN, Chain
from blockframe.plans.landing import bundles
from blockframe.sources import raw


@pytest.fixture(scope="module")
def dump(spark, sf):
    text = bundles(Chain(spark, sf)).persist()
    yield raw.bundle_rows(text)
    text.unpersist()


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_addresses_are_added_up_by_hash_without_amounts(dump):
    plan = plan_of(backfill.totals(dump, SPAN, ("address",)))
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert "1000000000000000000000000000" not in plan and "10000000000000000000000000)" not in plan  # bases of 256-bit amounts
    assert "100000000000000000000000000" in plan_of(backfill.totals(dump, SPAN, ("span_token",)))


def test_a_family_alone_has_the_columns_and_rows_of_the_whole(dump):
    whole = backfill.totals(dump, SPAN).persist()
    for family in backfill.FAMILIES:
        some = backfill.totals(dump, SPAN, (family,))
        assert [(f.name, f.dataType) for f in some.schema] == [(f.name, f.dataType) for f in whole.schema], family
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.where(F.col("family") == family).collect())), family
    whole.unpersist()


def test_frames_are_found_below_any_bound(spark):
    leaf = {"type": "CALL", "from": "0x1", "to": "0x2", "error": 'a "[[" in a text ]'}
    chain = dict(leaf)
    for _ in range(30):
        chain = {**leaf, "calls": [chain]}
    trees = [leaf, chain, {**leaf, "calls": [leaf, {**leaf, "calls": []}, chain]}]
    df = spark.createDataFrame([(json.dumps(t).replace('"calls"', '"\\u0063alls"'),) for t in trees], "r string")
    nodes = lambda lists: F.transform(decode.frame_nodes(F.parse_json("r"), root=True, lists=lists), lambda n: n["path"])
    rows = df.select(nodes(None).alias("a"), nodes(decode.lists_in(F.col("r"))).alias("b")).collect()
    assert [len(r.a) for r in rows] == [1, 31, 34] and all(r.a == r.b for r in rows)
