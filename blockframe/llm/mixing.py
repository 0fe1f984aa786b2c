"""Mixing sources to target weights by Poisson replication, in native expressions only.

A document of source s is wanted r(s) times in the mean: (target weight of s) x (rows wanted) / (rows of s). How often
it comes is a Poisson variable of that mean, inverted at a uniform number that is a hash of seed and id, so a rerun, a
retried task and a grown table give the same documents the same numbers. A mean too large to invert in double precision
is split into equal parts, each with a draw of its own, and the draws are added up: a sum of Poisson variables is one of
the summed mean. Each document is exploded by its count, and all copies are put into a global order by a hash of seed,
id and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to which their table (a row of some 30 to 1000 numbers each) is broadcast.
BROADCAST_SOURCES = 2000
#: Means up to which one draw is made; e^-mean is a double. A larger one is split into parts of at most `PART`.
SINGLE = 700
PART = 500
#: 52 bits of the hash are used, so the uniform number is exact as a double.
_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by a bar; nulls as an empty part."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("double") / float(16**_DIGITS)


def cumulative(rate: Column) -> Column:
    """Poisson's cumulative distribution for 0, 1, 2, ... up to where it is 1 in double precision, as an array.

    In steps of the recurrence p(k) = p(k-1) r / k, for a mean of at most `SINGLE`: the p(0) of a larger one is no double.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def parts(rate: Column) -> Column:
    """Into how many equal parts a mean is split."""
    return F.when(rate <= SINGLE, F.lit(1)).otherwise(F.ceil(rate / PART).cast("int"))


def rates(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n, weight, rate) of each source present.

    Target weights are the given ones (a source that isn't listed has none and its documents go), or the sources'
    shares to the power alpha; either way they are scaled to 1 over the sources present. epochs is the rows wanted, as a
    multiple of the rows there are. Rows with a null source are a source of their own.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        pairs = [x for k, w in weights.items() if k is not None for x in (F.lit(k), F.lit(float(w)))]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        listed = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.try_element_at(table, F.col("source")))
        raw = F.coalesce(listed, F.lit(0.0))
    raw = counts.select("source", "n", raw.alias("raw"))
    total = raw.agg(F.sum("raw").alias("all_raw"), F.sum("n").alias("all_n"))
    weight = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw")).otherwise(0.0)
    wanted = raw.crossJoin(F.broadcast(total)).withColumn("weight", weight)  # total is one row
    return wanted.select("source", "n", "weight", (F.col("weight") * F.col("all_n") * epochs / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, source: str = "source", id_col: str = "doc_id", weights: dict[str | None, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 42, copy: str = "copy") -> DataFrame:
    """docs, each row as often as the hash of its id draws, with the number of the copy (from 0), in a global shuffle.

    Rows are drawn one by one; rows that share an id share its number and so its count, and a null id has the number of
    an empty one. All columns are kept; one named as the copy number is replaced. An empty table stays empty.
    """
    names = [c for c in docs.columns if c.lower() != copy.lower()]
    cdf = rates(docs, source, weights, alpha, epochs).select(
        F.col("source").alias("source_"), cumulative(F.col("rate") / parts(F.col("rate"))).alias("cdf_"), parts(F.col("rate")).alias("parts_")
    )
    if cdf.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        cdf = F.broadcast(cdf)  # else exchanged, and adaptive execution splits a hot source's rows over tasks
    rows = docs.select(F.struct(*names).alias("row_"), F.col(source).alias("source"), F.col(id_col).alias("id_"))
    drawn = rows.join(cdf, F.col("source").eqNullSafe(F.col("source_"))).withColumn("u_", uniform(F.lit(seed), F.col("id_")))
    # the first draw is the only one of most sources; further ones are added to it
    more = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("parts_") - 1))

    def draw(total: Column, part: Column) -> Column:
        u = uniform(F.lit(f"{seed} part"), F.col("id_"), part)
        return total + F.size(F.filter("cdf_", lambda c: c <= u))

    once = F.size(F.filter("cdf_", lambda c: c <= F.col("u_")))
    times = F.when(F.col("parts_") == 1, once).otherwise(F.aggregate(more, once, draw))
    copies = drawn.withColumn("times_", times).where("times_ > 0").select("row_", "id_", F.explode(F.sequence(F.lit(0), F.col("times_") - 1)).alias(copy))
    order = uniform(F.lit(f"{seed} order"), F.col("id_"), F.col(copy))
    return copies.withColumn("order_", order).repartition(F.col("order_")).sortWithinPartitions("order_").select("row_.*", copy)
