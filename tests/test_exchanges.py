"""What is exchanged where joins shuffle, as those of larger tables do."""

from __future__ import annotations

import re

import pytest

from blockframe.operators import backfill, rollups
from blockframe.plans import landing, queries
from blockframe.plans.chain import SPAN, Chain
from blockframe.sources import fixtures, raw


@pytest.fixture()
def shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_lines_are_exchanged_once(shuffled, sf):
    assert exchanges(fixtures.view(shuffled, sf, "f_lines")) == 2  # lines and orders


def dealt_by(df) -> list[str]:
    """The keys of each exchange by hash."""
    return re.findall(r"Exchange hashpartitioning\((.*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_transactions_are_grouped_where_their_block_lies(shuffled, sf):
    c = Chain(shuffled, sf)
    assert not [keys for keys in dealt_by(c.stats) if "tx" in keys or "hash" in keys]
    assert c.stats.exceptAll(rollups.address_stats(c.contributions)).isEmpty() and c.stats.count() == c.contributions.select("address").distinct().count()
    assert sum("address" in keys for keys in dealt_by(c.span_addresses)) == 2  # creations, and then spans
    assert len(dealt_by(c.contracts)) == 3  # lines, orders, and the contracts' addresses


def test_counting_addresses_looks_for_no_creations(shuffled, sf):
    c = Chain(shuffled, sf)
    some = rollups.addresses(c.txs, c.transfers, c.frames)
    assert some.exceptAll(c.stats.select("address")).isEmpty() and some.count() == c.stats.count()
    plan = c.counters._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "row_number" not in plan


def test_balances_are_added_up_once(shuffled, sf):
    c = Chain(shuffled, sf)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert text(c.balances).count("HashAggregate(") == 2  # within tasks, and after the exchange
    last = rollups.current_balances(c.history).select(c.balances.columns)
    assert c.balances.exceptAll(last).isEmpty() and c.balances.count() == last.count()
    assert "row_number" not in text(queries.QUERIES["holder_count_wide"](shuffled, sf))  # no place of a log is looked for


def test_supplies_are_added_up_once(shuffled, sf):
    plan = queries.QUERIES["check_supply"](shuffled, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_dump_exchanges_tables_and_no_text(shuffled, sf):
    assert exchanges(landing.bundles(Chain(shuffled, sf))) <= 7


def test_dump_exchanges_lines_once(shuffled, sf):
    """Logs and traces come from the same rows: lines once, orders for them, for their own bodies, and heads."""
    dump = landing.bundles(Chain(shuffled, sf))
    assert exchanges(dump) == 4
    assert len(re.findall(r"FileScan parquet .*lineitem", dump._jdf.queryExecution().executedPlan().toString())) == 1


def test_totals_leave_no_dump_on_disk(spark, sf, tmp_path, monkeypatch):
    c = Chain(spark, sf)
    monkeypatch.setattr(landing, "_folder", lambda _: f"{tmp_path}/own")
    sums = landing._sums(c, *backfill.FAMILIES)
    assert [p.name for p in (tmp_path / "own").iterdir()] == ["totals"]
    landing.write_bundles(c, f"{tmp_path}/landed")
    backfill.write_totals(raw.bundle_scan(spark, f"{tmp_path}/landed"), f"{tmp_path}/want", SPAN)
    want = spark.read.parquet(f"{tmp_path}/want")
    assert sorted(map(str, sums.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_families_that_are_not_wanted_are_not_made(spark, sf, tmp_path):
    landing.write_bundles(Chain(spark, sf), f"{tmp_path}/dump")
    dump = raw.bundle_scan(spark, f"{tmp_path}/dump")
    whole = backfill.totals(dump, SPAN).persist()
    assert {r[0] for r in whole.select("family").distinct().collect()} == set(backfill.FAMILIES)
    for wanted in (("span",), ("balance",), backfill.DAY_FAMILIES):
        some = backfill.totals(dump, SPAN, wanted)
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.where(whole.family.isin(*wanted)).collect()))
    whole.unpersist()


def test_feed_numbers_blocks_within_ranges(spark):
    from blockframe.streaming import feed

    blocks = spark.range(0, 60_000, 7).selectExpr("id as number", "concat('0x', id) as hash", "id as timestamp", "null as txs", "null as transfers")
    blocks = blocks.select("number", "hash", "timestamp", *(blocks[n].cast(t) for n, t in (("txs", "array<struct<hash:string,tx_index:int,from_address:string,to_address:string>>"), ("transfers", "array<struct<token_address:string,from_address:string,to_address:string>>"))))
    events = feed.numbered(blocks, 5)
    assert [tuple(r) for r in events.select("sequence", "block_number").orderBy("sequence").collect()] == [(5 + i, 7 * i) for i in range(8572)]
    # windows without a partition are over a row per range: no block's own row comes to one task
    plan = events._jdf.queryExecution().executedPlan().toString()
    lone = plan[plan.index("Exchange SinglePartition") :].split("\n")[1]
    assert "HashAggregate(keys=[range" in lone


def test_landed_files_are_not_written_by_two_tasks(spark, sf, tmp_path):
    c = Chain(spark, sf)
    landing._land(spark.range(0, 1000, 1, 8), f"{tmp_path}/in")
    assert len(spark.read.parquet(f"{tmp_path}/in").inputFiles()) == 8 and landing._per_batch(c, f"{tmp_path}/in") == 3
