"""What is written to disk is in proportion to the rows."""

from __future__ import annotations

import glob
import os

from blockframe.plans import landing
from blockframe.plans.chain import Chain
from blockframe.sources import history, versions


def size(pattern: str) -> int:
    return sum(os.path.getsize(f) for f in glob.glob(pattern, recursive=True) if os.path.isfile(f))


def test_sketches_and_filters_follow_the_keys(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id div 4 as block_number", "sha2(cast(id as string), 256) as hash")
    first = history.append(versions.current(spark, str(tmp_path)), {"txs": rows.select("*", *_columns())}, 500)
    assert size(f"{tmp_path}/txs_sketch/**/*.parquet") < 200_000  # 2,000 keys: 8 bytes each
    assert size(f"{tmp_path}/txs/**/*.parquet") < 600_000  # no filter of 1 MB
    again = rows.union(spark.range(2000, 2010).selectExpr("id - 2000", "sha2(cast(id as string), 256)"))
    assert history.unstored(first, "txs", again.select("*", *_columns()), 500).count() == 10


def _columns():
    from pyspark.sql import functions as F

    return F.lit(0).alias("tx_index"), F.lit("0xa").alias("from_address"), F.lit("0xb").alias("to_address")


def test_dump_is_packed(spark, sf, tmp_path):
    landing.write_bundles(Chain(spark, sf), f"{tmp_path}/dump")
    assert glob.glob(f"{tmp_path}/dump/*.gz") and size(f"{tmp_path}/dump/*") < 1_500_000  # some 4 MB as text
