from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockframe.llm import cover_tree, hard_negatives
from blockframe.llm.queries import QUERIES


def brute(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """rows: {id: (label, ints)}; every pair by plain arithmetic."""
    out = []
    for a in sorted(anchors):
        label, x = rows[a]
        scores = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in rows.items() if len(y) == len(x)}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if rows[i][0] == label and i != a][:positives]:
            fit = [i for i in order if rows[i][0] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            out += [(a, p, rank, i, scores[p], scores[i]) for rank, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def as_ints(vector):
    return [math.floor(256 * float(v)) for v in vector]


def got(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, sf):
    folder = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = {r.vec_id: ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, as_ints(r.embedding)) for r in table if r.label is not None and r.embedding is not None}
    want = brute(rows, [i for i in rows if i % 100 == 0])
    assert want and got(QUERIES["op11_hard_negatives"](spark, folder)) == want


def test_shards_lanes_ties_and_crowds(spark):
    random = np.random.default_rng(5)
    x = random.normal(size=(400, 8)).astype(np.float32)
    x[50:200] = x[50]  # a crowd of copies with many labels
    x[200:260] = x[50] + random.normal(size=(60, 8)).astype(np.float32) * 0.05
    labels = [i % 3 if i % 5 else 0 for i in range(400)]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], labels[i]) for i in range(400)], "vec_id long, embedding array<float>, label int")
    rows = {i: (labels[i], as_ints(x[i])) for i in range(400)}
    want = brute(rows, range(0, 400, 10))
    for shards, lanes in ((1, 1), (3, 2), (7, 3)):
        assert got(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, shards=shards, lanes=lanes)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.8, 0.1], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2),
        (7, [0.85, 0.0], None), (None, [0.85, 0.0], 2), (8, [0.0, 0.0], 2), (9, [], 2), (10, [0.9, 0.0, 5.0], 2), (2, [0.8, 0.1], 2), (100, [], 1), (200, [0.0, 0.0], 3),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, rank string, shard int")
    good = {i: (lab, as_ints(v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    assert got(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == brute(good, [0, 100, 200])
    empty = hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0)
    assert empty.collect() == [] and "negative_id" in empty.columns


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**22
    rows = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big, -1.0], 2), (3, [big, 0.0], 2), (4, [big, 1.5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(hard_negatives.mine(df, F.col("vec_id") == 0)) == brute({i: (lab, as_ints(v)) for i, v, lab in rows}, [0])


def test_tree_covers_and_skips():
    random = np.random.default_rng(2)
    centres = random.normal(size=(12, 16)) * 300
    x = np.floor(np.concatenate([c + random.normal(size=(250, 16)) * 12 for c in centres]))
    tree = cover_tree.CoverTree(x, np.arange(len(x)))
    below = {}
    for node in reversed(range(len(tree.centre))):
        below[node] = np.concatenate([tree.own[node], *(below[c] for c in tree.children[node])]).astype(int)
        cosines = tree.unit[below[node]] @ tree.unit[tree.centre[node]]
        assert np.arccos(np.clip(cosines, -1, 1)).max() <= tree.angle[node] + 1e-6
    assert sorted(below[0]) == list(range(len(x)))
    visited = []
    whole = tree.scores
    tree.scores = lambda rows, q: (visited.append(len(rows)), whole(rows, q))[1]
    window = cover_tree.Window(-np.inf, np.inf, 5)
    cover_tree.search([tree], x[7], [window])
    exact = x @ x[7]
    assert list(window.id) == list(np.lexsort((np.arange(len(x)), -exact))[:5])
    assert sum(visited) < len(x) / 3  # most nodes were never opened
