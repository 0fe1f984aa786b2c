"""The change feed as a stream: no gaps, no repeats, restarts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from blockframe.plans.chain import Chain
from blockframe.plans.landing import feed_bundles
from blockframe.sources import raw, versions
from blockframe.streaming import feed


@pytest.fixture(scope="module")
def bundles(spark, sf):
    return feed_bundles(Chain(spark, sf)).where("number < 60").persist()


def run(spark, tmp_path):
    stream = spark.readStream.schema(feed.BUNDLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feed.change_feed_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    return feed.events_from(spark, str(tmp_path / "out")).collect()


def test_restarts_and_redelivery(spark, sf, bundles, tmp_path):
    def land(condition):
        bundles.where(condition).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    land("number < 20")
    land("number between 30 and 39")
    first = run(spark, tmp_path)
    assert [r.sequence for r in first] == list(range(len(first)))
    # a batch that was committed, but whose checkpoint was lost, runs again
    now = versions.current(spark, str(tmp_path / "out"))
    assert feed.publish(now, bundles.where("number between 30 and 39"), now.token) is now
    land("number between 20 and 29")
    land("number < 40")  # again
    land("number >= 40")
    whole = run(spark, tmp_path)
    assert whole[: len(first)] == first and [r.sequence for r in whole] == list(range(len(whole)))
    by_block = {}
    for r in whole:
        by_block.setdefault(r.block_number, []).append(r)
    assert all([r.place for r in rs] == list(range(len(rs))) and rs[0].event == "new_block" for rs in by_block.values())
    c = Chain(spark, sf)
    own = [df.where(F.col(k) < 60) for df, k in ((c.blocks, "number"), (c.txs, "block_number"), (c.transfers, "block_number"))]
    want = raw.change_feed(*own).groupBy("event", "block_number").count().collect()
    got = {}
    for r in whole:
        got[r.event, r.block_number] = got.get((r.event, r.block_number), 0) + 1
    assert got == {(r.event, r.block_number): r["count"] for r in want}
    # a consumer goes on from any number
    assert feed.events_from(spark, str(tmp_path / "out"), 100, 50).collect() == whole[100:150]
    assert feed.events_from(spark, str(tmp_path / "out"), len(whole)).collect() == []


def test_a_replaced_block_is_a_new_event(spark, bundles, tmp_path):
    now = versions.current(spark, str(tmp_path))
    one = feed.publish(now, bundles.where("number = 5"), 0)
    two = feed.publish(one, bundles.where("number = 5").withColumn("hash", F.lit("0xother")), 1)
    rows = feed.events_from(spark, str(tmp_path)).collect()
    assert {r.block_hash for r in rows} == {bundles.where("number = 5").first().hash, "0xother"} and len(rows) == 2 * one.facts["next"] == two.facts["next"]
    assert json.loads(rows[0].payload)["number"] == 5


def test_only_folders_from_the_sequence_on_are_read(spark, bundles, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "EVENTS", 50)
    now = feed.publish(versions.current(spark, str(tmp_path)), bundles, 0)
    read = []
    whole = versions.Snapshot.read
    monkeypatch.setattr(versions.Snapshot, "read", lambda self, t, b=None, s=None: (read.append(list(b)), whole(self, t, b, s))[1])
    rows = feed.events_from(spark, str(tmp_path), 120, 40).collect()
    assert [r.sequence for r in rows] == list(range(120, 160)) and sorted(map(int, read[0])) == [2, 3] and len(now.buckets("events")) > 6
