"""Hard negatives: for an anchor and each of its nearest of the same label, the nearest of other labels within a window.

Rows are dealt to shards by a hash of their id, so no label, however common, makes a large one; a shard's rows become a
cover tree per label and length. Anchors visit every shard in lanes, twice: first the trees of their own label, for their
positives, then those of the other labels, once for the windows of all positives. Every task holds one shard and one lane,
both bounded in bytes, and gives a few rows per anchor and window, which Spark merges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cover_tree
from .runtime import bound_batches, written
from .vectors import vector_type

POSITIVES = 5
NEGATIVES = 5
#: The window of a negative's score, in per cent of the positive's.
LOW, HIGH = 80, 100
#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Bytes of a task's shard of candidates and of its lane of anchors, as doubles.
SHARD_BYTES = 32 * 1024 * 1024
LANE_BYTES = 32 * 1024 * 1024
#: Shards are smaller where that many rows would leave cores idle, but not below this.
SHARD_ROWS = 2048


def _rows(df: DataFrame, anchors: Column, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, dim, label, vector, asked): rows that take part, one for each id."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))
    plain = df.where(good).select(
        F.col(id_col).cast("long").alias("id"),
        F.struct(F.col(label).cast("string").alias("label"), F.col(vector).cast(vector_type(df, vector)).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asked")).alias("row"),
    )
    return plain.groupBy("id").agg(F.min("row").alias("row")).select("id", F.size("row.vector").alias("dim"), "row.*")


def _vectors(table: pa.Table, dim: int, scale: int) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64).reshape(table.num_rows, dim) * scale)


def _trees(rows: pa.Table, scale: int) -> dict[tuple[int, str], cover_tree.CoverTree]:
    """A tree for each length and label of a shard."""
    found = {}
    dims, labels = rows.column("dim").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=object)
    for dim in np.unique(dims):
        for label in sorted(set(labels[dims == dim])):
            part = rows.filter(pa.array((dims == dim) & (labels == label)))
            found[int(dim), label] = cover_tree.CoverTree(_vectors(part, int(dim), scale), part.column("id").to_numpy())
    return found


def _visit(rows: DataFrame, anchors: DataFrame, shards: int, lanes: int, visit, schema: str) -> DataFrame:
    """visit(shard's rows, lane's anchors) for every shard and lane."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.select("id", "dim", "label", "vector", dealt("id", shards).alias("shard"), every(lanes).alias("lane"))
    right = anchors.select("*", dealt("anchor", lanes).alias("lane"), every(shards).alias("shard"))
    return left.groupBy("shard", "lane").cogroup(right.groupBy("shard", "lane")).applyInArrow(visit, schema)


def _first(found: DataFrame, keys: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The k best of each key, ranked; few rows per shard and key are merged."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


_POSITIVE = [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]
_NEGATIVE = [*_POSITIVE, ("negative_id", pa.int64()), ("negative_score", pa.int64())]


def _table(found: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, fields, strict=True)})


def _sql(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{name} long" for name, _ in fields)


def mine(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    shards: int | None = None, lanes: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which anchors is true.

    A score is the inner product of floor(scale * component), an exact integer; higher ones come first, ties by the smaller
    id. Positives are the first other rows of the anchor's label (all, if fewer); negatives the first rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score. Rows with a null id or label, or a null vector,
    or one that holds null or non-finite components, take no part; zero and empty vectors do. Vectors of different
    lengths have no inner product and never meet. Of rows that share an id the one with the least (label, vector) takes
    part, so repeated rows count once. An empty table gives no rows. A score beyond 64 bits is an error. Other columns
    aren't read, whatever their names.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = written(_rows(df, anchors, id_col, vector, label))
    n, asked, dim = rows.agg(F.count("*"), F.count_if("asked"), F.max("dim")).first()
    if not asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = 8 * (dim + 2)
    cores = spark.sparkContext.defaultParallelism
    shards = shards or max(-(-n * width // SHARD_BYTES), min(cores, -(-n // SHARD_ROWS)))
    lanes = lanes or -(-asked * width // LANE_BYTES)
    chosen = rows.where("asked").select(*(F.col(c).alias(name) for c, name in (("id", "anchor"), ("dim", "length"), ("label", "own"), ("vector", "query"))))

    def nearest(shard: pa.Table, lane: pa.Table) -> pa.Table:
        trees, found = _trees(shard, scale), []
        for one, query in _queries(lane, scale):
            tree = trees.get((one["length"], one["own"]))
            if tree is not None:
                best = cover_tree.Window(-np.inf, np.inf, positives)
                cover_tree.search([tree], query, [best], one["anchor"])
                found += [(one["anchor"], int(i), int(s)) for i, s in zip(best.id, best.score, strict=True)]
        return _table(found, _POSITIVE)

    near = _visit(rows, chosen, shards, lanes, nearest, _sql(_POSITIVE))
    near = written(_first(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))

    def between(shard: pa.Table, lane: pa.Table) -> pa.Table:
        trees, found = _trees(shard, scale), []
        for one, query in _queries(lane, scale):
            others = [tree for (dim, label), tree in trees.items() if dim == one["length"] and label != one["own"]]
            # whole numbers s with low * p <= 100 * s <= high * p
            asked = [(p["positive_id"], p["positive_score"]) for p in one["near"]]
            windows = [cover_tree.Window(-(-low * p // 100), high * p // 100, negatives) for _, p in asked]
            open_ = [w for w in windows if w.low <= w.high]
            if open_ and others:
                cover_tree.search(others, query, open_)
            for (i, p), w in zip(asked, windows, strict=True):
                found += [(one["anchor"], i, p, int(j), int(s)) for j, s in zip(w.id, w.score, strict=True)]
        return _table(found, _NEGATIVE)

    of = near.groupBy(F.col("anchor_id").alias("anchor")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("near"))  # at most `positives`
    hard = _visit(rows, chosen.join(of, "anchor"), shards, lanes, between, _sql(_NEGATIVE))
    hard = _first(hard, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _queries(lane: pa.Table, scale: int):
    """Each anchor of a lane, and its vector."""
    vectors = lane.column("query").to_pylist()
    for one, x in zip(lane.drop_columns(["query"]).to_pylist(), vectors, strict=True):
        yield one, np.floor(np.array(x, dtype=np.float64) * scale)
