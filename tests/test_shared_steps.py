"""Steps that many queries share read and exchange their tables once."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from blockframe.operators import decode, reorg
from blockframe.plans.chain import Chain
from blockframe.sources import fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, sf, tmp_path):
    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return write


def test_lines_equal_their_sql(spark, sf):
    tables = {"lineitem": fixtures.read(spark, sf, "lineitem"), "f_tx": fixtures.view(spark, sf, "f_tx")}
    want = spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", fixtures.VIEWS["f_lines"]), **tables)
    got = fixtures.view(spark, sf, "f_lines").select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert plan(got).count("Exchange hashpartitioning") <= 2  # one for each table


def test_creations_read_frames_once(spark, sf, stored):
    frames = stored(fixtures.view(spark, sf, "f_frames"), "frames")
    assert plan(decode.internal_creations(frames)).count("FileScan") == 1


def test_creations_keep_equal_rows_and_rows_without_transaction(spark):
    kind = "tx_hash string, trace_address string, call_type string, error string, to_address string"
    rows = [("a", "0", "create", None, "x"), ("a", "0", "create", None, "x"), ("b", "", "call", "bad", None), ("b", "0,1", "create", None, "y"), (None, "", "call", "bad", None), (None, "0", "create", None, "z")]
    assert sorted(r.to_address for r in decode.internal_creations(spark.createDataFrame(rows, kind)).collect()) == ["x", "x", "z"]


def test_revert_reads_contributions_once(spark, sf, stored):
    c = Chain(spark, sf)
    contributions, stats = stored(c.contributions, "contributions"), stored(c.stats, "stats")
    assert plan(reorg.revert_address_stats(stats, contributions, 20, 10**9)).count("FileScan") == 2


def test_split_is_computed_once(spark, sf):
    c = Chain(spark, sf)
    assert plan(c.split_stats).count("FileScan") == 1 and "lineitem" not in plan(c.split_stats)
    columns = c.stats.columns
    assert c.split_stats.select(columns).exceptAll(c.stats).isEmpty() and c.stats.count() == c.split_stats.count()
    some = c.txs.select(F.col("from_address").alias("address")).limit(3)
    few = c.stats_of(spark.createDataFrame(some.collect(), "address string"))
    assert few.exceptAll(c.stats).isEmpty() and few.count() == some.distinct().count()
