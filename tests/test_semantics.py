"""Hand-made frames for rules that the large tables don't single out."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from blockframe.functions import u256
from blockframe.functions.chain import ZERO_ADDRESS
from blockframe.operators import daily, decode, feeds, gaps, ledger, reorg, rollups

TX = "hash string, block_number long, block_timestamp long, tx_index int, from_address string, to_address string, value decimal(38,0), tx_type int, input_data string, status int"
MOVE = "tx_hash string, log_index int, block_number long, timestamp long, token_address string, from_address string, to_address string, value decimal(38,0), token_type string, token_id long"
FRAME = "tx_hash string, block_number long, timestamp long, trace_address string, from_address string, to_address string, call_type string, error string, output string"


def tx(h, block, index, a, b, kind=2):
    return (h, block, block * 10, index, a, b, Decimal(0), kind, "0x", 1)


def move(h, index, block, a, b, token="T", value=1, kind="ERC20", token_id=None):
    return (h, index, block, block * 10, token, a, b, Decimal(value), kind, token_id)


def test_keyset_walk_returns_each_row_once(spark):
    rows = [tx(f"h{b}{i}", b, i, "A", "B") for b, n in ((100, 2), (101, 4), (102, 1)) for i in range(n)]
    df, moves = spark.createDataFrame(rows, TX), spark.createDataFrame([], MOVE)
    seen, bound = [], None
    while True:
        page = feeds.txs_by_address(df, moves, "A", bound, 2).collect()
        if not page:
            break
        seen += [r.hash for r in page]
        bound = (page[-1].block_number, page[-1].tx_index)
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[3]))]


def test_keyset_reaches_the_scan(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = lines.where(feeds.before(["l_orderkey", "l_linenumber"], (50, 3)))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(l_orderkey,50)" in plan


def self_chain(spark):
    txs = spark.createDataFrame([tx("t1", 5, 0, "A", "A"), tx("t2", 5, 1, "A", "B")], TX)
    moves = spark.createDataFrame([move("t1", 0, 5, "A", "A"), move("t1", 1, 5, "B", "C"), move("t2", 2, 5, "C", "A")], MOVE)
    frames = spark.createDataFrame([("t1", 5, 50, "0", "A", "A", "call", None, None), ("t2", 5, 50, "0", "A", "B", "call", None, None)], FRAME)
    return txs, moves, frames, spark.createDataFrame([("C", 5)], "address string, block_number long")


def test_self_transfers_count_once(spark):
    txs, moves, frames, contracts = self_chain(spark)
    stats = {r.address: r for r in rollups.address_stats(rollups.address_contributions(txs, moves, frames, contracts)).collect()}
    a, c = stats["A"], stats["C"]
    assert (a.tx_count, a.internal_tx_count, a.token_transfer_count, a.sent_count) == (2, 2, 2, 2)
    assert (c.tx_count, c.token_transfer_count, c.is_contract, a.is_contract) == (2, 2, True, False)
    listed = feeds.transfers_by_address(moves, "A", None, 10).collect()
    assert len(listed) == listed[0].total == a.token_transfer_count


def test_zero_address_takes_no_transfer_part(spark):
    txs = spark.createDataFrame([tx("t", 1, 0, "A", None)], TX)
    moves = spark.createDataFrame([move("t", 0, 1, ZERO_ADDRESS, "A", value=7), move("t", 1, 1, "A", ZERO_ADDRESS, value=2), move("t", 2, 1, ZERO_ADDRESS, ZERO_ADDRESS, value=9)], MOVE)
    none = spark.createDataFrame([], FRAME)
    stats = rollups.address_stats(rollups.address_contributions(txs, moves, none, spark.createDataFrame([], "address string, block_number long"))).collect()
    assert [(r.address, r.token_transfer_count) for r in stats] == [("A", 2)]
    total = rollups.token_totals(moves).first()
    assert (total.transfer_count, total.supply) == (3, 5)
    assert {(r.address, r.balance) for r in rollups.balances_from_transfers(moves).collect()} == {("A", 5)}


def test_reverted_and_indexed_again_equals_never_reverted(spark):
    txs = spark.createDataFrame([tx(f"t{b}", b, 0, "AB"[b % 2], "C") for b in range(1, 9)], TX)
    moves = spark.createDataFrame([move(f"t{b}", 0, b, ZERO_ADDRESS if b == 1 else "C", "D", value=b) for b in range(1, 9)] + [move(f"t{b}", 1, b, ZERO_ADDRESS if b in (2, 7) else "D", "E", "N", 1, "ERC721", b if b in (2, 7) else 2) for b in (2, 5, 7)], MOVE)
    frames, contracts = spark.createDataFrame([], FRAME), spark.createDataFrame([("E", 6)], "address string, block_number long")
    whole = rollups.address_contributions(txs, moves, frames, contracts)
    stats = rollups.address_stats(whole)
    cut = reorg.revert_address_stats(stats, whole, 5, 8)
    below = rollups.address_stats(whole.where("block_number < 5"))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, below.select(cut.columns).collect()))
    again = rollups.address_stats_merge(cut, rollups.address_stats(whole.where("block_number >= 5")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stats.select(again.columns).collect()))
    nfts = {r.token_id: r.owner for r in reorg.revert_nft(rollups.nft_owners(moves), moves, 5, 8).collect()}
    assert nfts == {2: "E"}  # id 7 was minted in what is gone
    history = rollups.balances_from_transfers(moves, history=True)
    restored = reorg.revert_balances(history, rollups.current_balances(history), 5, 8)
    want = rollups.current_balances(history.where("block_number < 5"))
    assert sorted(map(tuple, restored.collect())) == sorted(map(tuple, want.collect()))


def test_creations_below_a_failed_frame(spark):
    rows = [
        ("t", 1, 1, "", "A", "F", "call", None, None), ("t", 1, 1, "0", "F", "X", "create2", None, "0x60"), ("t", 1, 1, "1", "F", "G", "call", "reverted", None),
        ("t", 1, 1, "1,0", "G", "Y", "create", None, "0x60"), ("t", 1, 1, "2", "F", "Z", "create", "failed", None), ("t", 1, 1, "10", "F", "W", "create", None, None),
        ("u", 1, 1, "", "A", "F", "call", "out of gas", None), ("u", 1, 1, "0", "F", "V", "create2", None, "0x60"),
    ]
    frames = spark.createDataFrame(rows, FRAME)
    assert {r.to_address for r in decode.internal_creations(frames).collect()} == {"X", "W"}
    assert {r.address for r in decode.contracts_from_frames(frames, spark.createDataFrame([], "address string")).collect()} == {"X"}


def test_incremental_days_equal_one_day_recounts(spark, sf):
    from blockframe.plans.chain import Chain

    c = Chain(spark, sf)
    table = {str(r.day): r for r in daily.daily_stats(c.blocks, c.txs, c.transfers, c.stats).collect()}
    for day in sorted(table)[:2]:
        one = daily.daily_recompute(c.blocks, c.txs, c.transfers, c.stats, day).first().asDict()
        mine = table[day].asDict()
        assert {k: mine[k] for k in one if k in mine} == {k: v for k, v in one.items() if k in mine}


def test_settle_states(spark):
    spans = spark.createDataFrame([(0, "ok"), (1, "ok"), (2, "repaired"), (3, "quarantined"), (4, "drift")], "lo long, state string")
    diffs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "span_lo long")
    plain = {r.lo: r.state for r in ledger.span_settle(spans, diffs, False).collect()}
    fixed = {r.lo: r.state for r in ledger.span_settle(spans, diffs, True).collect()}
    assert plain == {0: "ok", 1: "drift", 2: "drift", 3: "quarantined", 4: "drift"}
    assert fixed == {0: "ok", 1: "repaired", 2: "quarantined", 3: "quarantined", 4: "repaired"}


def test_reorg_takes_the_deepest_mismatch(spark):
    stored = spark.createDataFrame([(n, f"h{n}") for n in range(1, 21)], "number long, hash string")
    chain = stored.withColumn("hash", F.when(F.col("number").isin(13, 14, 18), "x").otherwise(F.col("hash")))
    row = gaps.reorg_depth(stored, chain).first()
    assert (row.head, row.deepest, row.depth) == (20, 13, 8)
    assert gaps.reorg_depth(stored, stored).first().depth == 0
    assert gaps.stale_head(stored, stored.withColumn("hash", F.lit("x")), window=10, limit=15).first().verdict == "refuse"


def test_range_algebra(spark):
    ranges = spark.createDataFrame([(5, 9), (20, 20), (30, 31)], "from_block long, to_block long")
    stored = spark.createDataFrame([(7,), (20,), (30,)], "number long")
    got = sorted(map(tuple, gaps.range_split(ranges, stored).collect()))
    assert got == [(5, 6), (8, 9), (31, 31)]
    merged = gaps.range_merge(spark.createDataFrame([(1, 3), (4, 6), (8, 9), (8, 8)], "from_block long, to_block long"))
    assert sorted(map(tuple, merged.collect())) == [(1, 6), (8, 9)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_algebra_against_sets(spark):
    r = random.Random(2)
    stored = sorted(r.sample(range(5000), 1800))
    ranges = [(0, 4999), (10, 10), (100, 350), (100, 350), (300, 900), (4990, 6100), (7000, 7000)] + [(n, n) for n in stored[:5]]
    df, held = spark.createDataFrame(ranges, "from_block long, to_block long"), spark.createDataFrame([(n,) for n in stored], "number long")
    got = gaps.range_split(df, held, bucket=64)
    want = []
    for a, b in set(ranges):
        free = [n for n in range(a, b + 1) if n not in set(stored)]
        want += [(x, y) for x, y in runs(free)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    merged = gaps.range_merge(df.unionByName(held.selectExpr("number as from_block", "number + 1 as to_block")), bucket=64)
    covered = sorted({n for a, b in ranges for n in range(a, b + 1)} | set(stored) | {n + 1 for n in stored})
    assert sorted(map(tuple, merged.collect())) == list(runs(covered))
    assert "NestedLoop" not in plan(got) + plan(merged) and "Cartesian" not in plan(got)


def runs(numbers):
    start = None
    for i, n in enumerate(numbers):
        if start is None:
            start = n
        if i + 1 == len(numbers) or numbers[i + 1] != n + 1:
            yield start, n
            start = None


def test_range_split_of_one_range_with_many_blocks(spark):
    held = spark.range(1_000_000).where("id % 7 <> 3").selectExpr("id as number")
    got = gaps.range_split(spark.createDataFrame([(0, 999_999)], "from_block long, to_block long"), held)
    assert got.count() == 142_857 and got.where("from_block <> to_block or from_block % 7 <> 3").count() == 0


def test_as_of_beyond_all_days(spark):
    spans = spark.createDataFrame([("2024-01-01", 10, 40), ("2024-01-02", 45, 3000), ("2024-01-04", 3000, 9000)], "day string, lo long, hi long")
    spans = spans.selectExpr("cast(day as date) day", "lo", "hi")
    at = [0, 9, 10, 39, 40, 44, 45, 2999, 3000, 8999, 9000, 50000, None]
    stats = spark.createDataFrame([(str(n), n) for n in at], "address string, first_seen long")
    forward = {r.address: r.day and r.day.day for r in daily.address_day_asof(stats, spans).collect()}
    back = {r.address: r.day and r.day.day for r in daily.address_day_asof_back(stats, spans).collect()}
    assert [forward[str(n)] for n in at] == [1, 1, 1, 1, 2, 2, 2, 2, 4, 4, None, None, None]
    assert [back[str(n)] for n in at] == [None, None, 1, 1, 1, 1, 2, 2, 4, 4, 4, 4, None]


def test_amounts_beyond_38_digits(spark):
    zero, big = "0x" + "0" * 40, 2**256 - 1
    rows = [("t", zero, "a", str(big), 1), ("t", zero, "a", str(big), 2), ("t", "a", "b", str(2**255), 3), ("t", "b", zero, str(2**200), 4), ("u", zero, "a", "7", 5), ("u", "a", zero, "9", 6)]
    moves = spark.createDataFrame(rows, "token_address string, from_address string, to_address string, v string, block_number long")
    moves = moves.select("*", u256.from_decimal(F.col("v")).alias("value"), F.lit("ERC20").alias("token_type"))
    shown = lambda df, c: df.withColumn(c, u256.to_decimal(F.col(c)))
    totals = {r.token_address: r for r in shown(rollups.token_totals(moves), "supply").collect()}
    assert (totals["t"].supply, totals["u"].supply) == (str(2 * big - 2**200), "-2")
    held = rollups.balances_from_transfers(moves)
    balances = {(r.token_address, r.address): r.balance for r in shown(held, "balance").collect()}
    assert balances[("t", "a")] == str(2 * big - 2**255) and balances[("t", "b")] == str(2**255 - 2**200)
    last = {(r.address, r.block_number): r.balance for r in shown(rollups.balances_from_transfers(moves, history=True), "balance").where("token_address = 't'").collect()}
    assert last[("a", 2)] == str(2 * big) and last[("a", 3)] == str(2 * big - 2**255)
    top = shown(feeds.token_holders(held, moves.selectExpr("'a' as address").limit(1), "t", 5), "balance").collect()
    share = 100 * (2 * big - 2**255) / (2 * big - 2**200)
    top = sorted(top, key=lambda r: r.address)
    assert [r.address for r in top] == ["a", "b"] and abs(float(top[0].percentage) - share) < 1e-4 and top[0].is_contract
    ten = moves.limit(1).select("token_address", F.explode(F.array_repeat(u256.literal(10**78 - 1), 20)).alias("value"), "from_address", "to_address", "token_type")
    assert shown(rollups.token_totals(ten), "supply").first().supply == "9" * 78
    burnt = ten.select("token_address", "value", "token_type", F.col("from_address").alias("to_address"), F.col("to_address").alias("from_address"))
    assert shown(rollups.token_totals(burnt), "supply").first().supply == "-" + "9" * 78


def test_shares_of_large_decimals(spark):
    rows = [("t", "a", Decimal(3 * 10**33)), ("t", "b", Decimal(10**33)), ("t", "c", Decimal(1))]
    held = spark.createDataFrame(rows, "token_address string, address string, balance decimal(38,0)")
    got = feeds.token_holders(held, spark.createDataFrame([], "address string"), "t", 5).collect()
    assert {r.address: float(r.percentage) for r in got} == {"a": 75.0, "b": 25.0, "c": 0.0}
