"""What appends compute, and what reverts read."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from blockframe.sources import history, versions


def _txs(spark, lo: int, hi: int):
    return spark.range(lo, hi).selectExpr("id as block_number", "concat('0xt', id) as hash", "0 as tx_index", "'0xa' as from_address", "'0xb' as to_address")


def test_what_comes_in_is_computed_once(spark, tmp_path):
    first = history.append(versions.current(spark, str(tmp_path)), {"txs": _txs(spark, 0, 100)}, 10)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(h):
        calls.add(1)
        return h

    rows = _txs(spark, 50, 150).coalesce(1).withColumn("hash", counted.asNondeterministic()("hash"))
    after = history.append(first, {"txs": rows}, 10)
    assert calls.value == 100 and after.read("txs").count() == 150


def test_places_of_transfers_and_frames_are_not_compared(spark):
    moves = spark.createDataFrame([("t", 1, 0, "a", "b"), ("t", 1, 1, "a", "a")], "tx_hash string, block_number long, log_index int, from_address string, to_address string")
    frames = spark.createDataFrame([("t", 1, "", "a", "b"), ("t", 1, "0", "a", "b")], "tx_hash string, block_number long, trace_address string, from_address string, to_address string")
    alone = history._postings({"transfers": moves, "frames": frames})
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 7
    txs = spark.createDataFrame([("t", 1, 0, "a", "c")], "hash string, block_number long, tx_index int, from_address string, to_address string")
    whole = history._postings({"txs": txs, "transfers": moves, "frames": frames})
    assert sorted((r.kind, r.address) for r in whole.where("kind = 'tx'").collect()) == [("tx", "a"), ("tx", "b"), ("tx", "c")] and whole.count() == 10


def test_ranges_that_lose_all_are_not_read(spark, tmp_path):
    now = history.append(versions.current(spark, str(tmp_path)), {"txs": _txs(spark, 0, 100)}, 10)
    for folder in now.parts("txs", [30]):
        for name in os.listdir(folder):
            os.remove(f"{folder}/{name}")
    after = history.revert(now, 25, 10**9)
    assert after.read("txs").agg(F.max("block_number"), F.count("*")).first()[:] == (24, 25)
    none = history.revert(after, 0, 10**9)
    assert none.read("txs").isEmpty() and none.read("postings").isEmpty()


def test_a_failed_table_leaves_no_version(spark, tmp_path):
    good, bad = (spark.range(4).select("id", F.lit(0).alias("bucket"), v.alias("v")) for v in (F.lit(1), F.raise_error(F.lit("no"))))
    try:
        versions.commit(versions.current(spark, str(tmp_path)), [versions.Change("a", good), versions.Change("b", bad)])
    except Exception as e:
        assert "no" in str(e)
    else:
        raise AssertionError("it failed")
    assert versions.current(spark, str(tmp_path)).number == 0
