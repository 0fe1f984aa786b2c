"""Streams fed out of order, with repeated files, against their batch twins."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from blockframe import schemas
from blockframe.operators import daily, gaps, rollups
from blockframe.plans.chain import Chain
from blockframe.streaming import ingest


def landing(c: Chain):
    return c.blocks.selectExpr("number", "hash", "parent_hash", "timestamp", "gas_used", "transaction_count", "cast(size as long) size", "cast(base_fee_per_gas as long) base_fee_per_gas")


def test_ingest_takes_each_block_once(spark, sf, tmp_path):
    rows = landing(Chain(spark, sf)).persist()
    random.seed(1)
    lows = list(range(0, 400, 80))
    random.shuffle(lows)
    folder = str(tmp_path / "landing")
    for lo in [*lows, lows[0]]:
        rows.where(F.col("number").between(lo, lo + 79)).coalesce(1).write.mode("append").parquet(folder)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    ingest.ingest_blocks(spark, folder, out, ckpt, confirmations=12, files_per_batch=2).awaitTermination()
    top = rows.agg(F.max("number")).first()[0]
    got = ingest.history(spark, out)
    assert sorted(r.number for r in got.collect()) == sorted(r.number for r in rows.where(F.col("number") <= top - 12).collect())
    # nothing new: the same files again change nothing; the rest waits
    ingest.ingest_blocks(spark, folder, out, ckpt, confirmations=12).awaitTermination()
    assert ingest.history(spark, out).count() == got.count()
    assert ingest.waiting(spark, out).count() == rows.where(F.col("number") > top - 12).count()


def test_current_balances_equal_the_batch(spark, sf, tmp_path):
    c = Chain(spark, sf)
    reads = c.history.select("token_address", "address", F.col("balance").cast("string").alias("balance"), "block_number", F.lit(1).alias("arrival")).persist()
    folder = str(tmp_path / "reads")
    for part in (2, 0, 1, 2):
        reads.where(F.col("block_number") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest.current_balances_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    keys = ["token_address", "address", "balance", "block_number"]
    got, want = ingest.current_balances_of(spark, str(tmp_path / "ckpt")).select(keys), ingest.batch_twin(reads).select(keys)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # the changes, replayed in order, end in the same state
    log = spark.read.parquet(str(tmp_path / "out"))
    last = log.groupBy("token_address", "address").agg(F.max_by(F.struct("balance", "block_number"), "batch").alias("m")).select("token_address", "address", "m.*")
    assert last.select(keys).exceptAll(want).count() == 0


BALANCES = "token_address string, address string, balance string, block_number long, arrival long"


def test_work_of_a_balance_batch_does_not_grow_with_the_state(spark, tmp_path):
    """The same small batch over a state and one ten times as large: as many rows updated, as many bytes committed."""
    committed = []
    for size in (3_000, 30_000):
        folder, ckpt = str(tmp_path / f"reads{size}"), tmp_path / f"ckpt{size}"

        def run(rows, folder=folder, ckpt=ckpt):
            before = {p for p in ckpt.rglob("*") if p.is_file()} if ckpt.exists() else set()
            rows.coalesce(1).write.mode("append").parquet(folder)
            query = ingest.current_balances_stream(spark.readStream.schema(BALANCES).parquet(folder), f"{folder}-out", str(ckpt))
            query.awaitTermination()
            new = sum(p.stat().st_size for p in ckpt.rglob("*.changelog") if p not in before)
            return query.lastProgress["stateOperators"][0], new

        def keys(n, block):
            return spark.range(n).selectExpr("'t' token_address", "concat('a', id) address", f"'{block}' balance", f"{block}L block_number", "0L arrival")

        run(keys(size, 1))
        state, written = run(keys(50, 2))
        assert state["numRowsTotal"] == size and state["numRowsUpdated"] == 50
        committed.append(written)
        late, _ = run(keys(50, 0))  # late reads change nothing
        rows = {r.address: r for r in ingest.current_balances_of(spark, str(ckpt)).collect()}
        assert len(rows) == size and rows["a7"].block_number == 2 and rows["a99"].block_number == 1
    assert 0 < committed[1] <= 1.2 * committed[0]
    assert "HDFSBackedStateStoreProvider" in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "HDFSBackedStateStoreProvider")


def test_ties_go_to_the_later_arrival(spark, tmp_path):
    rows = [("t", "a", "5", 3, 1), ("t", "a", "6", 3, 2), ("t", "a", "9", 2, 9), ("t", "b", "1", 1, 1)]
    spark.createDataFrame(rows, BALANCES).write.parquet(str(tmp_path / "in"))
    ingest.current_balances_stream(spark.readStream.schema(BALANCES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.address, r.balance, r.block_number, r.arrival) for r in ingest.current_balances_of(spark, str(tmp_path / "ckpt")).collect()}
    assert got == {("a", "6", 3, 2), ("b", "1", 1, 1)}


def test_redelivered_blocks_come_once_and_their_state_is_bounded(spark, sf, tmp_path):
    rows = landing(Chain(spark, sf)).orderBy("number").persist()
    folder = str(tmp_path / "in")
    for low in (0, 100, 0, 200, 300, 200):  # windows of 100 blocks, 600 s each; two of them twice
        rows.where(F.col("number").between(low, low + 99)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schemas.BLOCK_LANDING).option("maxFilesPerTrigger", 1).parquet(folder)
    query = ingest.blocks_once(stream, "2 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [r.number for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = [r.number for r in rows.where("number < 400").collect()]
    assert sorted(got) == sorted(want)
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    assert held <= 2 * 86_400 / 600 + 100 < len(want) + 100  # two days of blocks and a batch


def test_fold_with_a_late_block_equals_the_batch(spark, sf):
    c = Chain(spark, sf)
    blocks, txs, moves = (df.persist() for df in (c.blocks.where("number < 97"), c.txs.where("block_number < 97"), c.transfers.where("block_number < 97")))
    early = blocks.where("number <> 40")
    acc, mark = ingest.daily_fold_step(early, txs.where("block_number <> 40"), moves.where("block_number <> 40"), None, 0)
    assert mark == 39
    same, again = ingest.daily_fold_step(early, txs, moves, acc, mark)
    assert again == 39 and same is acc
    acc, mark = ingest.daily_fold_step(blocks, txs, moves, acc, mark)
    assert mark == 96
    want = daily.daily_parts(blocks, txs, moves)
    assert acc.select(sorted(acc.columns)).exceptAll(want.select(sorted(acc.columns))).count() == 0 and acc.count() == want.count()


def test_gap_scan_seeded(spark):
    random.seed(3)
    gone = set(random.sample(range(1, 2000), 60))
    df = spark.createDataFrame([(n,) for n in range(0, 2001) if n not in gone], "number long")
    got = {n for r in gaps.missing_ranges(df, 0, 2010, bucket=50).collect() for n in range(r.from_block, r.to_block + 1)}
    assert got == gone | set(range(2001, 2011))
    twice = df.unionByName(df.where("number % 3 = 0")).unionByName(spark.createDataFrame([(None,)], "number long"))
    for bucket in (1, 50, gaps.SCAN_BUCKET):
        rows = gaps.missing_ranges(twice, 0, 2010, bucket).collect()
        assert {n for r in rows for n in range(r.from_block, r.to_block + 1)} == gone | set(range(2001, 2011))
        assert [r.to_block for r in rows] == sorted((r.to_block for r in rows), reverse=True)


def test_schema_text_is_readable(spark):
    assert "number" in spark.createDataFrame([], schemas.BLOCK_LANDING).columns
    assert rollups.COUNTED_TYPES == (0, 1, 2, 3, 4)
