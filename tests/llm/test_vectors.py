from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockframe.llm import ann, embed_dedup, hnsw


def clustered(n=700, dim=16, seed=3):
    """Random vectors, a crowd of near copies, exact copies, and a chain of links."""
    random = np.random.default_rng(seed)
    x = random.normal(size=(max(n, 300), dim))
    x[100:220] = x[100] + random.normal(size=(120, dim)) * 0.08
    x[220:240] = x[220]
    for i in range(241, 260):
        x[i] = x[i - 1] + random.normal(size=dim) * 0.32
    return x[:n].astype(np.float32)


def truth(x, threshold=0.9):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= threshold
    np.fill_diagonal(near, False)
    group = np.arange(len(x))
    while True:
        new = np.array([min(group[i], group[near[i]].min()) if near[i].any() else group[i] for i in range(len(x))])
        if (new == group).all():
            return near.sum(axis=1), group
        group = new


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], "z") for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string")


def test_near_duplicates_match_all_pairs(spark):
    x = clustered()
    bad = [(5000, None, "z"), (5001, [0.0] * 16, "z"), (5002, [float("nan")] + [1.0] * 15, "z"), (5003, [None] + [1.0] * 15, "z"), (5004, [], "z"), (None, [1.0] * 16, "z"), (5005, [float("inf")] * 16, "z")]
    out = embed_dedup.near_duplicates(frame(spark, x, bad), shards=3, lanes=2)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = {r.vec_id: r for r in out.collect()}
    links, group = truth(x)
    assert len(got) == len(x) + len(bad)
    assert [got[i].n_links for i in range(len(x))] == list(links)
    assert [got[i].component_id for i in range(len(x))] == list(group)
    assert all(got[i].kept == (i == group[i]) for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(5000, 5006))
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept is False


def test_empty_and_repeated(spark):
    x = clustered(40)
    assert embed_dedup.near_duplicates(frame(spark, x).limit(0)).collect() == []
    twice = frame(spark, x[:5]).unionByName(frame(spark, x[:5]))
    assert {r.n_links for r in embed_dedup.near_duplicates(twice, shards=2, lanes=1).collect()} == {1}


def test_graph_recall():
    random = np.random.default_rng(1)
    x = random.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.build(x)
    q = random.normal(size=(200, 24)).astype(np.float32)
    at, near = graph.search(q, 64)
    best = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(at, best)]) > 0.9
    assert (np.diff(near, axis=1) <= 1e-6).all()


@pytest.mark.parametrize("n", [1, 2, 30])
def test_tiny_graphs(n):
    x = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
    at, _ = hnsw.build(x).search(x, 8)
    assert (np.sort(at, axis=1)[:, -min(n, 8):] >= 0).all()


def check_search(rows, x, ids, k=20):
    score = x.astype(np.float64) @ x.astype(np.float64).T
    place = {v: i for i, v in enumerate(ids)}
    hit = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        s = score[place[q]].copy()
        s[place[q]] = -np.inf
        best = [ids[j] for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert all(abs(r.score - score[place[q], place[r.vec_id]]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(best))
        total += len(best)
    return hit / max(1, total)


def test_search_recall_and_edges(spark):
    x = clustered(1200)
    x[300:420] *= 3.0  # lengths differ: nearness is the inner product
    bad = [(5000, None, "z"), (5020, [0.0] * 16, "z"), (5040, [float("nan")] + [1.0] * 15, "z"), (None, [1.0] * 16, "z")]
    out = ann.search(frame(spark, x, bad), F.col("vec_id") % 20 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert check_search(out.collect(), x, list(range(len(x)))) >= 0.9
    few = ann.search(frame(spark, x[:7]), F.col("vec_id") % 20 == 0).collect()
    assert check_search(few, x[:7], list(range(7))) == 1.0
    assert ann.search(frame(spark, x[:7]).limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_search_ties_and_copies(spark):
    x = np.repeat(clustered(3), 400, axis=0)  # three vectors, many copies each
    rows = ann.search(frame(spark, x), F.col("vec_id") % 20 == 0).collect()
    assert check_search(rows, x, list(range(len(x)))) == 1.0


def test_lengths_are_searched_apart(spark):
    random = np.random.default_rng(2)
    x, y = random.normal(size=(300, 8)), random.normal(size=(41, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    assert check_search([r for r in got if r.query_id < 1000], x, list(range(300))) >= 0.9
    assert check_search([r for r in got if r.query_id >= 1000], y, list(range(1000, 1041))) == 1.0
    near = {r.vec_id: r for r in embed_dedup.near_duplicates(df.unionByName(df.where("vec_id in (3, 1003)").selectExpr("vec_id + 5000 as vec_id", "embedding"))).collect()}
    assert near[3].n_links == near[5003].n_links == 1 and near[6003].n_links == near[1003].n_links >= 1 and near[6003].component_id == near[1003].component_id


def test_double_columns_keep_their_precision(spark):
    a, b = [1.0, 0.0], [0.9, (1 - 0.81) ** 0.5 * (1 + 4e-9)]  # a cosine below 0.9 by less than single precision tells
    df = spark.createDataFrame([(1, a), (2, b)], "vec_id long, embedding array<double>")
    assert {r.n_links for r in embed_dedup.near_duplicates(df).collect()} == {0}


def test_lists_grow_with_the_rows():
    sizes = [ann.lists_for(10**i) for i in range(1, 10)]
    assert sizes == sorted(sizes) and sizes[3] == 20 and sizes[-1] < ann.MOST_LISTS
    assert ann.lists_for(10**8) == 20_000


def test_wide_beams_and_audits():
    """All pairs within reach, in a shard that is a crowd, from a narrow beam on."""
    random = np.random.default_rng(4)
    x = random.normal(size=(900, 12))
    x[:500] = x[0] + 0.05 * random.normal(size=(500, 12))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = hnsw.build(x)
    pairs = {(i, j) for a, b in embed_dedup.range_search(graph, x, 0.9, beam=8) for i, j in zip(a.tolist(), b.tolist())}
    assert pairs == set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.9))))


def test_queries_against_all_pairs(spark, sf):
    from blockframe.llm.queries import op2_embeddings, op10_ann

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float32)
    ids = [r.vec_id for r in rows]
    assert check_search(op10_ann(spark, sf).collect(), x, ids) >= 0.9
    links, group = truth(x)
    got = {r.vec_id: r for r in op2_embeddings(spark, sf).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in ids] == [(n, ids[g]) for n, g in zip(links, group)]


def test_query_with_planted_links(spark, sf, tmp_path):
    from blockframe.llm.queries import op2_embeddings

    random = np.random.default_rng(6)
    real = spark.read.parquet(f"{sf}/embeddings.parquet")
    some = real.orderBy("vec_id").limit(60).collect()
    more = [(10**6 + 10 * r.vec_id + j, [float(v) + random.normal() * s for v in r.embedding]) for r in some for j, s in ((1, 0.0), (2, 0.01), (3, 0.03))]
    near = spark.createDataFrame(more, "vec_id long, embedding array<double>").selectExpr("vec_id", "cast(embedding as array<float>) embedding", "cast(0 as int) label")
    whole = real.selectExpr("vec_id", "cast(embedding as array<float>) embedding", "cast(0 as int) label").unionByName(near)
    whole.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = whole.orderBy("vec_id").collect()
    ids = [r.vec_id for r in rows]
    links, group = truth(np.array([r.embedding for r in rows], dtype=np.float32))
    assert links.sum() > 100
    got = {r.vec_id: r for r in op2_embeddings(spark, str(tmp_path)).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in ids] == [(n, ids[g]) for n, g in zip(links, group)]


def test_long_vectors_make_smaller_shards():
    rows = embed_dedup.SHARD_BYTES // (8 * 1536)
    assert embed_dedup.shards_of(8 * embed_dedup.SHARD_ROWS, 64) == 8
    assert embed_dedup.shards_of(8 * embed_dedup.SHARD_ROWS, 1536) >= 8 * embed_dedup.SHARD_ROWS // rows


def test_an_audit_finds_links_where_they_are_rare():
    random = np.random.default_rng(6)
    x = random.normal(size=(6000, 16)).astype(np.float32)
    x[:40] = x[100:140] + random.normal(size=(40, 16)).astype(np.float32) * 0.05
    q = np.concatenate([x[40:100], x[200:5900], x[:40]])
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    graph = hnsw.build(unit(x))
    _, links = embed_dedup.audit(graph, unit(q), 0.95, audited=20)
    assert links >= 20 + 10  # each query finds itself; and a good part of those with a true link is among the audited
    assert embed_dedup.audit(graph, unit(q[:0]), 0.95) == (embed_dedup.BEAM, 0)


def test_the_ratio_is_measured_a_query_at_a_time(spark):
    x = clustered()
    lists = ann.fit(x, len(x), float((x.astype(np.float64) ** 2).sum(axis=1).max()))
    q = x[:30].astype(np.float64)
    asked, near = np.repeat(np.arange(30), 5), x[np.argsort(-(q @ x.T), axis=1)[:, :5].ravel()]
    ratio = ann.measure_ratio(lists, q, asked, near)
    assert ratio >= 1 and ann.measure_ratio(lists, q, asked[:0], near[:0]) == 1.0
