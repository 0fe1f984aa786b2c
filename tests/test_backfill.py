"""A raw range in one pass: its plan, and that ranges add up."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from blockframe.operators import backfill, daily, decode, rollups
from blockframe.plans.chain import SPAN, Chain
from blockframe.plans.landing import write_bundles
from blockframe.sources import raw


@pytest.fixture(scope="module")
def dump(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dump") / "blocks")
    write_bundles(Chain(spark, sf), folder)
    return raw.bundle_scan(spark, folder)


def test_one_scan_and_one_exchange(dump):
    plan = backfill.totals(dump, SPAN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_two_ranges_add_up_to_the_whole(dump):
    number = F.conv(F.expr("substr(number, 3)"), 16, 10).cast("long")
    whole = backfill.totals(dump, SPAN).persist()
    low, high = (backfill.totals(dump.where((number < 150) == below), SPAN).persist() for below in (True, False))
    merged = rollups.address_stats_merge(backfill.address_deltas(low), backfill.address_deltas(high))
    want = backfill.address_deltas(whole)
    assert sorted(map(str, merged.select(want.columns).collect())) == sorted(map(str, want.collect()))
    # the pair of blocks across the border is in neither part
    edge = {r.number: r.timestamp for r in decode.blocks_from_raw(dump.where(number.isin(149, 150))).select("number", "timestamp").collect()}
    gap = dump.sparkSession.createDataFrame([(edge[150] - edge[149], 1)], "gap_sum long, gap_n long").select(daily.day_of(F.lit(edge[150])).alias("day"), "*")
    days = daily.daily_parts_merge(backfill.day_parts(low), backfill.day_parts(high), gap)
    want = backfill.day_parts(whole).select(days.columns)
    assert sorted(map(str, days.collect())) == sorted(map(str, want.collect()))


def test_odd_bundles(spark, tmp_path):
    rows = [
        {"number": "0x1", "timestamp": "0x10"},
        {"number": "0x2", "timestamp": "0x16", "gasUsed": "0x5", "transactions": [{"hash": "0xT", "from": "0xA", "to": None, "type": "0x7e"}], "receipts": [{"transactionHash": "0xT", "status": "0x0", "logs": None}, {"transactionHash": "0xU"}]},
        {"number": "0x3", "timestamp": "0x1c", "transactions": [{"hash": "0xV", "from": "0xA", "to": "0xA"}], "traces": [{"txHash": "0xV", "result": "not json"}, {"txHash": "0xV", "error": "lost", "result": "{}"}]},
    ]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows)))
    sums = backfill.totals(raw.bundle_scan(spark, str(tmp_path / "b.json")), 10).persist()
    assert [tuple(r) for r in backfill.spans(sums).collect()] == [(0, 3, 2, 0)]
    assert [tuple(r) for r in backfill.address_deltas(sums).collect()] == [("0xa", 2, 0, 0, 1, 2, 3, False)]
    day = backfill.day_parts(sums).first()
    assert (day.blocks, day.gas_used, day.size_n, day.gap_sum, day.gap_n, day.success, day.failed, day.active_addresses) == (3, 5, 0, 12, 2, 0, 1, 1)
    assert backfill.tokens_seen(sums).count() == backfill.balance_keys(sums).count() == 0
    assert backfill.totals(raw.bundle_scan(spark, str(tmp_path / "b.json")).limit(0), 10).count() == 0


def test_wide_and_deep_traces_are_walked_in_seconds(spark):
    import time

    leaf = {"type": "CALL", "from": "0x1", "to": "0x2", "error": 'a "[[" in a text ]'}
    chain = dict(leaf)
    for _ in range(60):
        chain = {**leaf, "calls": [chain]}
    tree = {**leaf, "calls": [*({**leaf, "calls": [leaf]} for _ in range(20_000)), chain]}
    df = spark.createDataFrame([("0xT", 1, 2, json.dumps(tree), None)], "txHash string, blockNumber long, timestamp long, result string, error string")
    decode.flatten_frames(raw.tidy_traces(df.limit(0))).collect()
    start = time.perf_counter()
    found = decode.flatten_frames(raw.tidy_traces(df)).agg(F.count("*"), F.max(F.size(F.split("trace_address", ",")))).first()
    assert tuple(found) == (40_061, 61) and time.perf_counter() - start < 30
