from __future__ import annotations

import numpy as np

from blockframe.llm import embed_dedup


def test_shards_follow_the_count():
    assert [embed_dedup.shards_of(n) for n in (0, 1, 1_600_000, 1_600_001, 40_000_000)] == [8, 8, 8, 9, 200]


def test_bounded_shards_give_the_same_links(spark, monkeypatch):
    random = np.random.default_rng(5)
    x = random.normal(size=(400, 16))
    x[100:200] = x[:100] + 0.05 * random.normal(size=(100, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    sizes, blocks = [], embed_dedup._blocks

    def seen(nodes, key):
        if key == "shard":
            sizes.extend(r[1] for r in nodes.groupBy("shard").count().collect())
        return blocks(nodes, key)

    want = sorted(embed_dedup.near_duplicates(df, shards=8).collect())
    monkeypatch.setattr(embed_dedup, "SHARD_ROWS", 20)
    monkeypatch.setattr(embed_dedup, "_blocks", seen)
    assert sorted(embed_dedup.near_duplicates(df).collect()) == want
    assert len(sizes) == 20 and max(sizes) < 45
