"""Connected components over an edge table, for groups of any size.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
Each half round is one aggregate (min per node, combined before the shuffle) and one equi-join that adaptive execution
may split where a node is hot, so no task ever holds all neighbours of a node. Rounds grow with the logarithm of the
largest component; each is cut off into the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links(u, v) with m of least(u, m).

    Joined on a hash of u besides u: so both sides are exchanged for the join itself, and adaptive execution can split
    the rows of a hot node over several tasks (it can't below an aggregate's own exchange).
    """
    left = links.select(F.xxhash64("u").alias("k"), "u", "v")
    right = least.select(F.xxhash64("u").alias("k"), "u", "m")
    return left.join(right, ["k", "u"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge table; component is the least node reachable.

    Nodes are of any ordered type. Null ends, self links, repeated and reversed edges are allowed; edges with a null
    end are ignored. Nodes whose only edges are self links are returned as their own component.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    pairs = cut(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    work = pairs.where("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of u are linked to the least of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _with_least(large, small).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.select("u", F.col("m").alias("v"))
        work = cut(stars.unionByName(moved).where("u <> v").distinct())
        now = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every node but a root points at its root
    nodes = pairs.select(F.col("v").alias("node")).unionByName(pairs.select(F.col("u").alias("node"))).distinct()
    return nodes.join(work.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def keep_first(df: DataFrame, groups: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of df that groups(first) name by id and content hash; of rows that repeat both one stays."""
    first = groups.select("first.*").distinct()
    stay = first.select(F.col("id").alias("id_"), F.col("content").alias("content_"))
    whole = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("content"))
    kept = whole.join(stay, (F.col("content") == F.col("content_")) & F.col("id").eqNullSafe(F.col("id_")), "left_semi")
    one = F.row_number().over(Window.partitionBy("content", "id").orderBy("content"))
    return kept.withColumn("one", one).where("one = 1").select("row.*")
