"""Versions of tables: untouched folders stay, reruns do nothing, a half-written commit is invisible."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from blockframe.sources import versions
from blockframe.sources.versions import Change


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "bucket long, x long")


def held(snapshot, table="t", buckets=None):
    return sorted(r.x for r in snapshot.read(table, buckets).collect())


def test_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "v")
    empty = versions.current(spark, path)
    assert empty.number == 0 and empty.buckets("t") == []
    one = versions.commit(empty, [Change("t", rows(spark, (1, 10), (2, 20), (3, 30)))], {"mark": 3}, token=0)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "v" / "t").rglob("*.parquet")}
    two = versions.commit(one, [Change("t", rows(spark, (2, 21), (4, 40)), replaced=(2, 3))], token=1)
    assert held(two) == [10, 21, 40] and held(one) == [10, 20, 30]  # a reader of the older version still has it
    assert held(two, buckets=[1, 9]) == [10] and two.facts == {"mark": 3}
    assert {p: p.stat().st_mtime_ns for p in files} == files  # nothing was written over
    assert two.folders["t"]["1"] == one.folders["t"]["1"]
    three = versions.commit(two, [Change("t", rows(spark, (1, 11)))])
    assert held(versions.current(spark, path)) == [10, 11, 21, 40] and len(three.folders["t"]["1"]) == 2
    assert versions.commit(three, [Change("t", rows(spark, (1, 99)))], token=1) is three  # that batch is in it


def test_merge_and_vacuum(spark, tmp_path):
    now = versions.current(spark, str(tmp_path))
    for i in range(5):
        now = versions.commit(now, [Change("t", rows(spark, (1, i), (2, 100)) if i == 0 else rows(spark, (1, i)), order=("x",))])
    assert versions.merge_parts(now, "t", most=8) is now
    merged = versions.merge_parts(now, "t", most=3)
    assert held(merged) == [0, 1, 2, 3, 4, 100] and len(merged.folders["t"]["1"]) == 1
    assert merged.folders["t"]["2"] == now.folders["t"]["2"]
    assert versions.vacuum(merged, keep=1) == 4 and held(versions.current(spark, str(tmp_path))) == [0, 1, 2, 3, 4, 100]


def test_half_a_commit_is_invisible_and_two_writers_collide(spark, tmp_path):
    one = versions.commit(versions.current(spark, str(tmp_path)), [Change("t", rows(spark, (1, 1)))])
    broken = rows(spark, (1, 2)).withColumn("x", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(one, [Change("t", rows(spark, (1, 5))), Change("u", broken)])
    assert held(versions.current(spark, str(tmp_path))) == [1]
    versions.commit(one, [Change("t", rows(spark, (1, 2)))])
    with pytest.raises(RuntimeError, match="another writer"):
        versions.commit(one, [Change("t", rows(spark, (1, 3)))])
    assert held(versions.current(spark, str(tmp_path))) == [1, 2]
