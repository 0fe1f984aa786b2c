"""What appends leave on disk, and that ranges which hold some of the rows end up right."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from blockframe.operators import decode
from blockframe.sources import fixtures, history, versions


def _txs(spark, lo: int, hi: int):
    return spark.range(lo, hi).selectExpr("id as block_number", "concat('0xt', id) as hash", "0 as tx_index", "'0xa' as from_address", "'0xb' as to_address")


def exchanged(spark) -> set[str]:
    """Files of exchanges that are on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_exchanges_go_with_the_write(spark, tmp_path):
    before = exchanged(spark)
    now = history.append(versions.current(spark, str(tmp_path)), {"txs": _txs(spark, 0, 1000)}, 100)
    for _ in range(20):
        if not exchanged(spark) - before:
            break
        time.sleep(0.5)
    assert not exchanged(spark) - before and now.read("txs").count() == 1000
    assert all(spark.conf.get(k) == "false" for k in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",)) and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_lines_that_are_dealt_by_ranges_are_not_exchanged_again(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with versions.writing(spark):
            transfers = fixtures.view(spark, sf, "f_transfers", deal=history.dealt_by(500))
            for table, rows in (("transfers", transfers), ("logs", decode.transfer_logs(transfers))):
                plan = history._dealt(table, rows, 500)._jdf.queryExecution().executedPlan().toString()
                assert plan.count("Exchange ") == 2, table  # lines and orders
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert transfers.exceptAll(fixtures.view(spark, sf, "f_transfers")).isEmpty() and transfers.count() == fixtures.view(spark, sf, "f_transfers").count()


def test_ranges_that_hold_some_rows_are_written_without_them(spark, tmp_path):
    first = history.append(versions.current(spark, str(tmp_path)), {"txs": _txs(spark, 0, 50)}, 20)
    rows = _txs(spark, 30, 90)
    after = history.append(first, {"txs": rows.unionByName(rows)}, 20)
    assert sorted(r[0] for r in after.read("txs").select("block_number").collect()) == list(range(90))
    assert sorted(map(int, after.buckets("txs"))) == [0, 20, 40, 60, 80]
    named = {f for held in after.folders["txs"].values() for f in held}
    there = {f"txs/{c}/{b}" for c in os.listdir(tmp_path / "txs") for b in os.listdir(tmp_path / "txs" / c) if b.startswith("bucket=")}
    assert there == named  # what was written twice is gone
    assert history.append(after, {"txs": rows}, 20).read("txs").count() == 90


def test_other_sketches_are_read_as_unknown(spark, tmp_path):
    """Histories written before have 64-bit fingerprints in a folder for each range."""
    now = history.append(versions.current(spark, str(tmp_path)), {"txs": _txs(spark, 0, 40)}, 20)
    older = _txs(spark, 0, 40).select((F.floor(F.col("block_number") / 20) * 20).alias("bucket"), F.xxhash64("block_number", "hash").alias("print"))
    now = versions.commit(now, [versions.Change("txs_sketch", older, tuple(now.buckets("txs_sketch")))])
    after = history.append(now, {"txs": _txs(spark, 10, 60)}, 20)
    assert after.read("txs").count() == 60
    assert history.append(after, {"txs": _txs(spark, 0, 60)}, 20).read("txs").count() == 60


def test_a_wide_range_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "PIECE", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        now = history.append(versions.current(spark, str(tmp_path)), {"txs": _txs(spark, 0, 1000).unionByName(_txs(spark, 0, 1000))}, 10_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert now.buckets("txs") == ["0"] and now.read("txs").count() == 1000 and len(now.read("txs").inputFiles()) > 1


def test_postings_hold_a_hash_for_frames_only(spark, tmp_path):
    moves = spark.createDataFrame([("0xt3", 3, 0, "0xa", "0xc")], "tx_hash string, block_number long, log_index int, from_address string, to_address string")
    frames = spark.createDataFrame([("0xt3", 3, "", "0xa", "0xb")], "tx_hash string, block_number long, trace_address string, from_address string, to_address string")
    now = history.append(versions.current(spark, str(tmp_path)), {"txs": _txs(spark, 0, 5), "transfers": moves, "frames": frames}, 20)
    assert {(r.kind, r.ref) for r in now.read("postings").collect()} == {("tx", None), ("transfer", None), ("frame", "0xt3 ")}
    assert [r.hash for r in history.txs_by_address(now, "0xc", None, 5).collect()] == ["0xt3"]


def test_filters_are_as_small_as_their_keys(spark, tmp_path):
    now = history.append(versions.current(spark, str(tmp_path)), {"txs": _txs(spark, 0, 500)}, 500)
    files = [f"{folder}/{f}" for folder in now.parts("tx_index") for f in os.listdir(folder) if f.endswith(".parquet")]
    assert files and max(os.path.getsize(f) for f in files) < 10_000  # 64 KB of filter each before
