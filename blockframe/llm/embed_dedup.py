"""Near-duplicates of embeddings with a navigable small-world graph per shard.

Equal vectors are made one first. The distinct ones are dealt to shards (`SHARDS` at least) by a hash of their id, so many that
a shard stays within `SHARD_ROWS` and, with its graph, `SHARD_BYTES`; each shard's graph is built in one task and written to the shared
checkpoint folder. All vectors, in blocks, are then searched in every shard. Blocks are dealt to lanes of `LANE_BLOCKS` at most;
a task gets a shard's graph once and the blocks of one lane. It audits itself first: of a sample of its queries, and of more
that are known to have links, all true links in the shard are computed, and while the search misses one the beam is doubled,
up to the whole shard. Then all are searched, and those whose whole beam is linked again with one twice as wide. Found pairs
are verified by their cosine in double precision. Only counts and a spanning forest of a task's links leave it, so a group of n near copies
costs n rows and not n^2. Components are unioned over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .components import connected_components
from .runtime import bound_batches, cut
from .vectors import cosines, distinct, matrix, pack, unit, vector_type

THRESHOLD = 0.9
#: Graphs that every vector is searched in, at least.
SHARDS = 8
#: Vectors of a shard, and bytes of them, as doubles, with their links: so one fits a task and a row at any number and length.
SHARD_ROWS = 200_000
SHARD_BYTES = 160 * 1024 * 1024
#: Queries in a block.
BLOCK = 2048
#: Blocks that a task searches in a shard, at most; lanes of a shard, at least.
LANE_BLOCKS = 64
LANES = 4
BEAM = 32
#: Queries that are audited at random, and as many of those among POOL that have links.
AUDITED = 48
POOL = 4096
#: Single precision may put a pair on the wrong side of the threshold by less than this.
_SLACK = 1e-4
#: Pairs that a task holds at once.
_PAIRS = 2_000_000


def _blocks(nodes: DataFrame, key: str) -> DataFrame:
    """One row for each value of key: its ids, counts and vectors as bytes."""

    def gather(table: pa.Table) -> pa.Table:
        got = pack(table, {"id": "", "n": "", "vector": "matrix"})
        order = np.argsort(got["id"], kind="stable")
        return pa.table(
            {
                key: table.column(key)[:1],
                "dim": table.column("dim")[:1],
                "ids": pa.array([got["id"][order].astype(np.int64).tobytes()], pa.binary()),
                "counts": pa.array([got["n"][order].astype(np.int64).tobytes()], pa.binary()),
                "vectors": pa.array([np.ascontiguousarray(got["vector"][order]).tobytes()], pa.binary()),
            }
        )

    kind = nodes.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, dim int, ids binary, counts binary, vectors binary"
    return nodes.groupBy("dim", key).applyInArrow(gather, schema)


def _read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], dtype=np.int64)
    counts = np.frombuffer(row[f"{prefix}counts"], dtype=np.int64)
    return ids, counts, matrix(row[f"{prefix}vectors"], len(ids), row["dim"])


def _graphs(shards: DataFrame) -> DataFrame:
    """The shards with their graphs: each layer's own nodes and their links as bytes, its width, and the entry node."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                graph = hnsw.build(unit(_read(row)[2]))
                yield pa.RecordBatch.from_pylist(
                    [
                        row
                        | {
                            "members": [np.flatnonzero((x >= 0).any(axis=1)).astype(np.int32).tobytes() for x in graph.layers],
                            "layers": [x[(x >= 0).any(axis=1)].astype(np.int32).tobytes() for x in graph.layers],
                            "widths": [x.shape[1] for x in graph.layers],
                            "entry": graph.entry,
                        }
                    ],
                    schema=schema,
                )

    schema = pa.schema(
        [("shard", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary()),
         ("members", pa.list_(pa.binary())), ("layers", pa.list_(pa.binary())), ("widths", pa.list_(pa.int32())), ("entry", pa.int32())]
    )
    return shards.mapInArrow(
        run, "shard int, dim int, ids binary, counts binary, vectors binary, members array<binary>, layers array<binary>, widths array<int>, entry int"
    )


def _dense(q: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of all pairs as near as least, of a few queries at once."""
    step = max(1, _PAIRS // max(1, len(x)))
    for i in range(0, len(q), step):
        r, c = np.nonzero(q[i : i + step] @ x.T >= least)
        yield r + i, c


def _graph(row: dict, vectors: np.ndarray) -> hnsw.Graph:
    layers = []
    for members, data, width in zip(row["members"], row["layers"], row["widths"], strict=True):
        links = np.full((len(vectors) + 1, width), -1, dtype=np.int32)
        links[np.frombuffer(members, dtype=np.int32)] = np.frombuffer(data, dtype=np.int32).reshape(-1, width)
        layers.append(links)
    return hnsw.Graph(unit(vectors), layers, row["entry"])


def audit(graph: hnsw.Graph, q: np.ndarray, least: float, beam: int = BEAM, audited: int = AUDITED, seed: int = 3) -> tuple[int, int]:
    """(beam, links): the beam that misses none of the audited queries' true links, and how many links they have.

    A random sample alone would hold few queries with links where links are rare; so as many that a first search finds some
    for are audited besides, out of a larger sample.
    """
    n = len(graph.vectors)
    drawn = np.random.default_rng(seed).permutation(len(q))[: max(audited, POOL)]
    linked = drawn[:0]
    if len(drawn) > audited:
        _, near = graph.search(q[drawn], beam)
        linked = drawn[(near >= least).sum(axis=1) > 1][:audited]  # one of them may be the query itself
    sample = np.unique(np.concatenate([drawn[:audited], linked]))
    truth = np.zeros(len(sample), np.int64)
    for rows, _ in _dense(q[sample], graph.vectors, least):
        np.add.at(truth, rows, 1)
    own = np.flatnonzero(truth)
    while beam < n and len(own):
        _, near = graph.search(q[sample[own]], beam)
        # a full beam is widened for its own query anyway
        if (np.minimum(truth[own], beam) <= (near >= least).sum(axis=1)).all():
            break
        beam *= 2
    return beam, int(truth.sum())


def range_search(graph: hnsw.Graph, q: np.ndarray, least: float, beam: int = BEAM, audited: int = AUDITED, seed: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of the pairs as near as least that the graph finds, in parts of bounded size.

    First the beam is widened by an audit, unless none are to be audited; then all are searched with it, and those whose whole beam is linked again with
    one twice as wide, until none's is. A beam as wide as the graph is no search any more, and becomes products with all
    its vectors.
    """
    n = len(graph.vectors)
    if audited:
        beam, _ = audit(graph, q, least, beam, audited, seed)
    left = np.arange(len(q))
    while len(left) and beam < n:
        full = []
        step = max(1, _PAIRS // beam)
        for i in range(0, len(left), step):
            own = left[i : i + step]
            at, near = graph.search(q[own], beam)
            linked = (at >= 0) & (near >= least)
            more = linked[:, -1]
            full.append(own[more])
            rows, cols = np.nonzero(linked & ~more[:, None])
            yield own[rows], at[rows, cols]
        left, beam = np.concatenate(full), 2 * beam
    for rows, cols in _dense(q[left], graph.vectors, least):
        yield left[rows], cols


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the ends of a and b as their pairs do: each end to the least end that it reaches."""
    ends, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    least = np.arange(len(ends))
    while True:
        new = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = least != np.arange(len(ends))
    return ends[moved], ends[least[moved]]


def _search(graphs: DataFrame, queries: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(id, links, other): a query's number of linked rows in a shard, or (with links null) an edge of a task's forest."""

    def visit(shard: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        if shard.num_rows and blocks.num_rows:
            row = shard.to_pylist()[0]
            ids, counts, x = _read(row)
            graph = _graph(row, x)
            lane = [_read(block, "q_") for block in blocks.to_pylist()]
            drawn = np.random.default_rng(7)
            some = [q[drawn.permutation(len(q))[: -(-POOL // len(lane))]] for _, _, q in lane]
            beam, _ = audit(graph, unit(np.concatenate(some)), threshold - _SLACK)
            found = [_links(graph, ids, counts, x, own, q, beam, threshold) for own, _, q in lane]
        return pa.concat_tables([_EMPTY, *found])

    return graphs.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(visit, "id long, links long, other long")


_EMPTY = pa.table({c: pa.array([], pa.int64()) for c in ("id", "links", "other")})


def _links(graph: hnsw.Graph, ids, counts, x, own, q, beam: int, threshold: float) -> pa.Table:
    """The links of one block's queries in a shard: their counts, and a spanning forest."""
    links = np.zeros(len(own), dtype=np.int64)
    src = dst = np.empty(0, np.int64)
    for a, b in range_search(graph, unit(q), threshold - _SLACK, beam, audited=0):
        for i in range(0, len(a), 65536):
            u, v = a[i : i + 65536], b[i : i + 65536]
            good = (cosines(q[u], x[v]) >= threshold) & (own[u] != ids[v])
            np.add.at(links, u[good], counts[v[good]])
            # of the links so far a spanning forest is kept, no more rows than vectors
            src, dst = _forest(np.concatenate([src, own[u[good]]]), np.concatenate([dst, ids[v[good]]]))
    some = np.flatnonzero(links)
    columns = {
        "id": pa.array(np.concatenate([own[some], src]), pa.int64()),
        "links": pa.concat_arrays([pa.array(links[some], pa.int64()), pa.nulls(len(src), pa.int64())]),
        "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(dst, pa.int64())]),
    }
    return pa.table(columns)


def shards_of(count: int, dim: int = 64) -> int:
    """The shards that so many distinct vectors of so many components are dealt to."""
    rows = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * dim + 16 * hnsw.NEIGHBOURS)))
    return max(SHARDS, -(-count // rows))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, shards: int | None = None, lanes: int | None = None) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of df.

    n_links is the number of other rows linked directly, equal vectors included; component_id is the least id reachable,
    a row's own included. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    and so do rows with a null id (component_id null, kept false). Vectors of different lengths never link. Rows that
    share an id and a vector count as separate rows; an id with several vectors is one node of the components. An empty
    table gives an empty result; other columns aren't read. The number of shards follows the count unless it is given.
    """
    spark = df.sparkSession
    bound_batches(spark)
    nodes = cut(distinct(df, id_col, vector))
    count, longest = nodes.agg(F.count("*"), F.max("dim")).first()
    shards = shards or shards_of(count, longest or 1)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    graphs = cut(_graphs(_blocks(nodes.withColumn("shard", shard), "shard").repartition(shards, "shard")))
    n_blocks = max(1, -(-count // BLOCK))
    lanes = lanes or max(LANES, -(-n_blocks // LANE_BLOCKS))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int")
    queries = _blocks(nodes.withColumn("block", block), "block").select(
        "dim", "block", *(F.col(c).alias(f"q_{c}") for c in ("ids", "counts", "vectors"))
    )
    # Each block meets each shard. A graph is sent once for each lane, and meets the blocks of the lane in one task.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = queries.select("*", every(shards).alias("shard")).withColumn("lane", F.col("block") % lanes)
    found = cut(_search(graphs.select("*", every(lanes).alias("lane")), sent, ["dim", "shard", "lane"], threshold))
    counted = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("other is not null"), "id", "other")
    named = nodes.join(counted, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(vector_type(df, vector)).alias("vector"))
    good = F.when(F.col("id").isNotNull(), F.col("vector"))  # a null meets nothing
    full = rows.withColumn("v", good).join(named.withColumnRenamed("vector", "v"), "v", "left")
    component = F.coalesce("component_id", "id")
    return full.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
