"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

Inner products are turned into distances by one more component, sqrt(largest squared norm - squared norm). Centroids
are fitted to a bounded sample by hierarchical balanced clustering; a small-world graph over them is what tasks search
in memory. Every vector is posted to its nearest centroid, and to further ones nearly as near (boundary vectors),
unless a list already chosen is nearer to that centroid than the vector is. A query reads the lists whose centroid's
distance is within a ratio of its nearest centroid's. The ratio is measured: for a sample of queries the true
neighbours are computed over all rows, and the least ratio is taken that finds `TARGET` of them. Lists are read in
blocks of bounded size, so that a list with a third of all rows is many tasks' work. Scores are inner products of the
original vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hnsw
from .runtime import bound_batches, cut
from .vectors import matrix, usable, vector_type

K = 20
#: Vectors per list aimed at. Up to LISTS lists they are as many as that takes; beyond, lists and their lengths both grow
#: with the root of the rows, and so does what a query reads. MOST_LISTS bounds what is sent to the tasks (some 50 MB at 64
#: components); it is reached at 10^9 rows, where a query reads lists of 16,000.
LIST_ROWS = 512
LISTS = 2048
MOST_LISTS = 65_536
#: Rows of the sample that centroids are fitted to: so many, or so many for each list.
SAMPLE_ROWS = 20_000
LIST_SAMPLE = 10
#: Vectors in a block.
BLOCK_ROWS = 1024
QUERY_BLOCK = 512
#: A vector is posted to at most so many lists, each at most so much farther than its nearest.
REPLICAS = 3
CLOSURE = 1.1
#: Recall that the ratio is measured for, and the queries it is measured with.
TARGET = 0.97
AUDITED = 64


@dataclass(frozen=True)
class Lists:
    """Centroids in the space with one more component, their graph, and the largest squared norm."""

    graph: hnsw.Graph
    centroids: np.ndarray
    squares: np.ndarray
    top: float

    def extend(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.top - (x * x).sum(axis=1)))
        return np.concatenate([x, more[:, None]], axis=1)

    def nearest(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(list, distance) of the count nearest centroids found in the graph; -1 and inf where there are fewer.

        The graph ranks by inner product; vectors carry (-2c, |c|^2) there, so that the least distance ranks first.
        """
        q = np.concatenate([x, np.full((len(x), 1), -1.0)], axis=1).astype(np.float32)
        at, _ = self.graph.search(q, min(count, len(self.centroids)))
        far = np.full(at.shape, np.inf)
        for i in range(0, len(x), 256):
            a = at[i : i + 256]
            d = x[i : i + 256, None, :] - self.centroids[a]
            far[i : i + 256] = np.where(a >= 0, np.sqrt((d * d).sum(axis=2)), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(at, order, axis=1), np.take_along_axis(far, order, axis=1)


def _split(x: np.ndarray, rows: np.ndarray, size: int, random) -> list[np.ndarray]:
    """Balanced clusters of at most size rows: halves along the line between two means, again and again."""
    if len(rows) <= size:
        return [rows]
    y = x[rows]
    a, b = y[random.choice(len(rows), 2, replace=False)]
    for _ in range(6):
        side = ((y - a) ** 2).sum(axis=1) - ((y - b) ** 2).sum(axis=1)
        order = np.argsort(side, kind="stable")
        half = len(rows) // 2
        a, b = y[order[:half]].mean(axis=0), y[order[half:]].mean(axis=0)
    return [*_split(x, rows[order[:half]], size, random), *_split(x, rows[order[half:]], size, random)]


def lists_for(total: int) -> int:
    """How many lists so many rows get."""
    return max(1, min(MOST_LISTS, -(-total // LIST_ROWS), max(LISTS, int(2 * total**0.5))))


def fit(sample: np.ndarray, total: int, top: float) -> Lists:
    """Lists for so many rows, from a sample of them."""
    random = np.random.default_rng(17)
    plain = Lists(None, None, None, top)
    x = plain.extend(sample, query=False)
    count = min(lists_for(total), len(x))
    parts = _split(x, np.arange(len(x)), max(1, -(-len(x) // count)), random)
    centroids = np.array([x[p].mean(axis=0) for p in parts])
    squares = (centroids**2).sum(axis=1)
    # the inner product of (q, -1) with (2c, |c|^2) is |q|^2 - |q - c|^2
    graph = hnsw.build(np.concatenate([2 * centroids, squares[:, None]], axis=1).astype(np.float32))
    return Lists(graph, centroids, squares, top)


def postings(lists: Lists, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each row's lists."""
    e = lists.extend(x, query=False)
    at, far = lists.nearest(e, max(8, REPLICAS * 2))
    rows, chosen = [np.arange(len(x))], [at[:, 0]]
    kept = np.full((len(x), REPLICAS), -1)
    kept[:, 0] = at[:, 0]
    taken = np.ones(len(x), dtype=int)
    for j in range(1, at.shape[1]):
        good = (at[:, j] >= 0) & (far[:, j] <= CLOSURE * far[:, 0] + 1e-12) & (taken < REPLICAS)
        for r in range(REPLICAS):  # not if a list of its own is nearer to that centroid than the vector is
            own = kept[:, r] >= 0
            between = np.sqrt(((lists.centroids[at[:, j]] - lists.centroids[kept[:, r]]) ** 2).sum(axis=1))
            good &= ~own | (between >= far[:, j])
        rows.append(np.flatnonzero(good))
        chosen.append(at[good, j])
        kept[good, taken[good]] = at[good, j]
        taken[good] += 1
    return np.concatenate(rows), np.concatenate(chosen)


def probes(lists: Lists, q: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) of the lists within the ratio. The beam over centroids is widened until it reaches beyond it."""
    e = lists.extend(q, query=True)
    beam = 32
    while True:
        at, far = lists.nearest(e, beam)
        inside = (at >= 0) & (far <= ratio * far[:, :1] + 1e-12)
        if beam >= len(lists.centroids) or not inside[:, -1].any():
            return np.nonzero(inside)[0], at[inside]
        beam *= 2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dealt(rows: DataFrame, by: str, lists, choose) -> DataFrame:
    """(list, id, vector) of rows(id, vector)."""

    def run(batches):
        own = lists.value
        for batch in batches:
            if batch.num_rows:
                row, chosen = choose(own, _matrix(batch.column(1)))
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen, pa.int32()), batch.column(0).take(take), batch.column(1).take(take)],
                    names=["list", by, "vector"],
                )

    return rows.mapInArrow(run, f"list int, {by} long, vector {rows.schema['vector'].dataType.simpleString()}")


def _blocks(rows: DataFrame, by: str, size: int, prefix: str) -> DataFrame:
    """One row per list and block of about size of its rows, with ids and vectors as bytes."""
    counts = rows.groupBy("list").agg(F.count("*").alias("c"))
    # counts has a row for each list at most, so it may be broadcast
    cut_up = rows.join(F.broadcast(counts), "list").withColumn(
        "part", F.pmod(F.xxhash64(by), F.ceil(F.col("c") / size)).cast("int")
    )

    def gather(table: pa.Table) -> pa.Table:
        vectors = _matrix(table.column("vector").combine_chunks())
        ids = table.column(by).combine_chunks().to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        return pa.table(
            {
                "list": table.column("list")[:1],
                f"{prefix}part": table.column("part")[:1],
                f"{prefix}ids": pa.array([ids[order].tobytes()], pa.binary()),
                f"{prefix}vectors": pa.array([np.ascontiguousarray(vectors[order]).tobytes()], pa.binary()),
            }
        )

    schema = f"list int, {prefix}part int, {prefix}ids binary, {prefix}vectors binary"
    return cut_up.select("list", "part", by, "vector").groupBy("list", "part").applyInArrow(gather, schema)


def _best(score: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of each query's k nearest in a block, itself left out; ties go to the smaller id (ids ascend)."""
    score = np.where(own[:, None] == ids[None, :], -np.inf, score)
    if score.shape[1] > k:
        border = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        above = score > border
        equal = score == border  # of those on the border the first, which have the smaller ids
        room = k - above.sum(axis=1, keepdims=True)
        take = above | (equal & (np.cumsum(equal, axis=1) <= room))
    else:
        take = np.ones(score.shape, dtype=bool)
    return np.nonzero(take & (score > -np.inf))


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision."""
    return (q.astype(np.float64) * x.astype(np.float64)).sum(axis=1)


def _scored(pairs: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each pair of blocks, thinned out to a task's k nearest."""

    def thin(found):
        q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])  # a vector posted to several lists comes several times
        q, v, s = q[new], v[new], s[new]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        return q[keep], v[keep], s[keep]

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                own, ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("q_ids", "ids"))
                q, x = matrix(row["q_vectors"], len(own), dim), matrix(row["vectors"], len(ids), dim)
                a, b = _best(q.astype(np.float64) @ x.astype(np.float64).T, own, ids, k)
                found.append((own[a], ids[b], dots(q[a], x[b])))
                size += len(a)
                if size > 400_000:
                    found = [thin(found)]
                    if len(found[0][0]) > 200_000:  # many queries: they go on, and are merged after the exchange
                        yield _rows(found[0])
                        found = []
                    size = len(found[0][0]) if found else 0
        if found:
            yield _rows(thin(found))

    def _rows(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2])], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def _truth(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of a bounded sample of queries' true nearest, over all rows.

    Each task keeps k per query; Spark merges them, and the driver gets the k vectors of each sampled query only.
    """

    def run(batches):
        best = None
        for batch in batches:
            x, own = _matrix(batch.column(1)).astype(np.float64), batch.column(0).to_numpy()
            if len(own):
                order = np.argsort(own, kind="stable")
                x, own = x[order], own[order]
                a, b = _best(q @ x.T, ids, own, k)
                new = (a, own[b], dots(q[a], x[b]))
                best = new if best is None else tuple(np.concatenate([o, n]) for o, n in zip(best, new, strict=True))
                order = np.lexsort((best[1], -best[2], best[0]))
                best = tuple(c[order] for c in best)
                keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
                best = tuple(c[keep] for c in best)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2])], names=["q", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    top = rows.mapInArrow(run, "q int, id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)
    found = top.select("q", "id").join(rows, "id").select("q", "vector").coalesce(8).toArrow().combine_chunks()
    if not found.num_rows:
        return np.empty(0, np.int64), np.empty((0, q.shape[1]), np.float32)
    return found["q"].to_numpy().astype(np.int64), _matrix(found["vector"].combine_chunks())


def measure_ratio(lists: Lists, q: np.ndarray, asked: np.ndarray, x: np.ndarray, target: float = TARGET) -> float:
    """The least ratio that finds the target's share of the true neighbours x of sampled queries q[asked]."""
    if not len(x):
        return 1.0
    e = lists.extend(q, query=True).astype(np.float64)
    far = np.empty((len(e), len(lists.centroids)))
    for i, one in enumerate(e):  # a query at a time: no more than the centroids' own size at once
        far[i] = np.sqrt(((lists.centroids - one) ** 2).sum(axis=1))
    row, chosen = postings(lists, x)
    query = asked[row]
    need = np.full(len(x), np.inf)
    np.minimum.at(need, row, far[query, chosen] / np.maximum(far[query].min(axis=1), 1e-12))
    return float(np.quantile(need, target, method="higher"))


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest rows found of each row for which the column queries is true.

    Every row is a candidate but the query's own; nearness is the largest inner product, ties go to the smaller id.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of
    different lengths have no inner product: each length is searched for itself. Of rows that share an id and a length the
    one with the least vector takes part. Fewer than k candidates give fewer rows, an empty table none. Other columns aren't
    read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    plain = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast(vector_type(df, vector)).alias("vector"), queries.alias("asked")
    )
    rows = plain.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    rows = cut(rows.groupBy("id", "dim").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked")))
    found = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    for (dim,) in rows.where("asked").select("dim").distinct().orderBy("dim").collect():  # lengths are few
        found = found.unionByName(_search(rows.where(F.col("dim") == dim), dim, k).withColumnRenamed("vec_id", id_col))
    return found


def _search(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows(id, vector, asked) of one length."""
    spark = rows.sparkSession
    squares = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    total, top = rows.agg(F.count("*"), F.max(squares)).first()
    order = F.xxhash64("id")
    # the threshold is found over hashes alone; the vectors below it come to the driver from few tasks
    border = rows.select(order.alias("h")).orderBy("h").limit(max(SAMPLE_ROWS, LIST_SAMPLE * lists_for(total))).agg(F.max("h")).first()[0]
    drawn = rows.where(order <= border).select("vector").coalesce(16).toArrow()["vector"]
    sample = _matrix(drawn.combine_chunks()).astype(np.float32)
    sample = sample[np.lexsort(sample.T)]  # they come in any order
    lists = fit(sample, total, top)
    asked = rows.where("asked").select("id", "vector")
    audit = asked.orderBy(order).limit(AUDITED).toArrow()
    ids, q = audit["id"].to_numpy(), np.array(audit["vector"].to_pylist(), dtype=np.float64).reshape(audit.num_rows, dim)
    ratio = measure_ratio(lists, q, *_truth(rows.select("id", "vector"), ids, q, k)) if len(ids) else 1.0
    sent = spark.sparkContext.broadcast(lists)  # at most MOST_LISTS centroids and their links
    posted = cut(_dealt(rows.select("id", "vector"), "id", sent, postings))
    probed = cut(_dealt(asked, "query", sent, lambda own, x: probes(own, x, ratio)))
    pairs = cut(_blocks(posted, "id", BLOCK_ROWS, "")).join(cut(_blocks(probed, "query", QUERY_BLOCK, "q_")), "list")
    found = _scored(pairs, k, dim).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
