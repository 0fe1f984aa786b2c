"""Substring dedup: near-duplicate paragraphs by MinHash banding, exact verification and components.

Texts are cut into paragraphs and windows of a word stream (see `passages`), so that a passage is found inside longer lines
and over line breaks too. A paragraph's 5-word shingles give bands of minimal hashes; paragraphs that agree on a band
collide. Windows need no bands: equal ones are one cluster.

Verification without all pairs of a band. First each distinct unit ("node") is held against the least node of its band, by
the exact Jaccard similarity of the shingle sets; of near copies most are linked so already. A band whose nodes all lie in
one component then needs no more. The nodes of the others are compared by prefix filtering, which is exact: with the
shingles in order of rarity, two sets of similarity s share one of the first n - ceil(s n) + 1 of each, so nodes that each
have rare shingles of their own, such as the edited units of a crowd of copies, never meet. Pairs of few nodes that share
such a shingle are counted first, and verified only if they share enough of them. Where many nodes share one, those outside
the largest component are compared with all others in blocks of bounded size; a pair that earlier links have joined is
skipped, and only a block's forest of links leaves its task.

Units are written once as a table in the shared checkpoint folder; a second pass over the texts fetches the shingles of
those units only that a bitmap of fixed size doesn't rule out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .passages import Cutter, shingle_set
from .runtime import bound_batches, cut, discard, written

SIMILARITY = 0.8
#: Nodes with a rare shingle in common up to which they are joined pairwise; beyond, so many are one side of a block.
PAIR_LIMIT = 32
BLOCK = 128
#: Nodes of the other side that a task holds.
PART = 4096
#: The bitmap that rules out units has 2^BITMAP bits (8 MB), whatever the size of the corpus. A full one rules out nothing.
BITMAP = 26
#: The same for a join: 2^JOIN_BITMAP bits on 262,144 rows at most, which are broadcast.
JOIN_BITMAP = 24


def _units(docs: DataFrame) -> DataFrame:
    """(id, content, start, end, first, n, node, check, bands) of the paragraphs and windows of docs(id, text), written to the shared folder.

    content is a hash of the text; bands are left out where the task has just met the same node.
    """

    def run(batches):
        cutter = Cutter()
        for batch in batches:
            ids, content = batch.column(0), batch.column(1)
            for found in cutter.units(batch.column(2)):
                rows = pa.array(found["row"], pa.int64())
                wanted = cutter.news(found["node"])
                offsets, values = cutter.bands(found, wanted)
                bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
                ints = [pa.array(found[c].astype(np.int32)) for c in ("start", "end", "first", "n")]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), content.take(rows), *ints, pa.array(found["node"]), pa.array(found["check"]), bands],
                    names=["id", "content", "start", "end", "first", "n", "node", "check", "bands"],
                )

    schema = "id long, content long, start int, end int, first int, n int, node long, check int, bands array<long>"
    return written(docs.select("id", F.xxhash64("text").alias("content"), "text").mapInArrow(run, schema))


def whole_texts(docs: DataFrame) -> DataFrame:
    """(id, content, node, simhash, bands) of docs(id, text), each whole text a unit, written to the shared folder."""

    def run(batches):
        cutter = Cutter(whole=True)
        for batch in batches:
            ids, content = batch.column(0), batch.column(1)
            for found in cutter.units(batch.column(2)):
                rows = pa.array(found["row"], pa.int64())
                offsets, values = cutter.bands(found, cutter.news(found["node"]))
                bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), content.take(rows), pa.array(found["node"]), pa.array(cutter.fingerprints(found)), bands],
                    names=["id", "content", "node", "simhash", "bands"],
                )

    rows = docs.select("id", F.xxhash64("text").alias("content"), "text")
    return written(rows.mapInArrow(run, "id long, content long, node long, simhash long, bands array<long>"))


def _members(units: DataFrame) -> DataFrame:
    """(band, node, least) of the bands that several distinct nodes share; one exchange serves both sides of the join."""
    rows = units.where(F.size("bands") > 0).select(F.explode("bands").alias("band"), "node").repartition("band")
    shared = rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    return written(rows.join(shared.select("band", "least"), "band").distinct())


def _bitmap(nodes: DataFrame, size: int) -> DataFrame:
    """(word, bits): a bitmap of 2^size bits in which the bit of each node is set; 2^(size - 6) rows at most."""
    bit = F.expr("shiftleft(1L, cast(node & 63 as int))")
    return nodes.select(_word(size).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _word(size: int) -> Column:
    return F.shiftright(F.col("node").bitwiseAND(F.lit((1 << size) - 1)), 6).cast("int")


def _sent_bitmap(nodes: DataFrame) -> bytes:
    words = np.zeros(1 << (BITMAP - 6), dtype=np.int64)
    table = _bitmap(nodes, BITMAP).toArrow()
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return words.tobytes()


def _likely(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows(node) that a bitmap of fixed size doesn't rule out, so that fewer are exchanged for a join with nodes(node)."""
    bits = F.broadcast(_bitmap(nodes, JOIN_BITMAP))
    rows = rows.withColumn("word", _word(JOIN_BITMAP)).join(bits, "word")
    return rows.where("(shiftright(bits, cast(node & 63 as int)) & 1) = 1").drop("word", "bits")


def _shingles(docs: DataFrame, whole: bool, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of nodes(node): the sorted distinct shingle hashes, written to the shared folder."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_sent_bitmap(nodes))

    def run(batches):
        cutter = Cutter(whole)
        bits = np.frombuffer(bitmap.value, dtype=np.uint64)
        for batch in batches:
            for found in cutter.units(batch.column(0)):
                node = found["node"].view(np.uint64)
                slot = node & np.uint64((1 << BITMAP) - 1)
                hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (node & np.uint64(63))) & np.uint64(1) == 1
                at = np.flatnonzero(hit)
                at = at[cutter.news(found["node"][at])]
                sets = [shingle_set(found["shingles"], a, n) for a, n in zip(found["a"][at].tolist(), found["n"][at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["node"][at]), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
                )

    found = docs.select("text").mapInArrow(run, "node long, shingles array<long>")
    return written(found.groupBy("node").agg(F.first("shingles").alias("shingles")).join(nodes, "node"))


def _on(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An equi-join exchanged on a hash besides the key, so that a hot key's rows can be split over tasks."""
    k = F.xxhash64(key)
    return left.withColumn("k_", k).join(right.withColumn("k_", k), ["k_", key]).drop("k_")


def _alike(a: str, b: str, similarity: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= similarity * (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs(src, dst) of nodes whose shingle sets have that Jaccard similarity."""
    a = shingles.select(F.col("node").alias("src"), F.col("shingles").alias("a"))
    b = shingles.select(F.col("node").alias("dst"), F.col("shingles").alias("b"))
    return _on(_on(pairs, a, "src"), b, "dst").where(_alike("a", "b", similarity)).select("src", "dst")


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Links between the two sides of a block: rows(token, block, part, side, node, component, shingles).

    Side 0 holds some BLOCK nodes, which are compared with each other and with side 1, some PART nodes.
    """

    def compare(table: pa.Table) -> pa.Table:
        group: dict[int, int] = {}

        def top(x):
            while group.get(x, x) != x:
                group[x] = group.get(group[x], group[x])
                x = group[x]
            return x

        src, dst, held = [], [], []
        order = np.argsort(table.column("side").to_numpy(), kind="stable").tolist()
        nodes, parts, sides, sets = (table.column(c) for c in ("node", "component", "side", "shingles"))
        for i in order:
            node, part, mine = nodes[i].as_py(), parts[i].as_py(), set(sets[i].as_py())
            for other, other_part, theirs in held:
                a, b = top(part), top(other_part)
                if a == b or min(len(mine), len(theirs)) < similarity * max(len(mine), len(theirs)):
                    continue
                both = len(mine & theirs)
                if both >= similarity * (len(mine) + len(theirs) - both):
                    group[max(a, b)] = min(a, b)
                    src.append(node)
                    dst.append(other)
            if sides[i].as_py() == 0:
                held.append((node, part, mine))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return rows.groupBy("token", "block", "part").applyInArrow(compare, "src long, dst long")


def _rest(members: DataFrame, shingles: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Links between nodes of bands that still have several components, found by prefix filtering."""
    parted = shingles.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    labelled = _on(members.select("band", "node"), parted, "node")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    # of a band with two nodes the one pair has been verified
    nodes = _on(labelled, mixed.where("lo <> hi and n > 2").select("band"), "band").select("node", "component").distinct()
    nodes = written(_on(nodes, shingles, "node"))
    shingles = nodes.select("node", "shingles")
    tokens = nodes.select("node", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    # shingles of one node only never meet another, but they take their places in its prefix
    shared = F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared")
    shared = _on(tokens, common, "token").groupBy("node", "component", "size").agg(shared)
    # of the first n - ceil(s n) + 1 of a set; tail is what lies behind them
    tail = F.ceil(F.lit(similarity) * F.col("size") - 1e-9) - 1
    prefix = F.size("shared") - tail
    listed = F.transform(F.slice("shared", F.lit(1), prefix.cast("int")), lambda x: x["token"])
    first = cut(shared.where(prefix > 0).select("node", "component", "size", tail.cast("int").alias("tail"), F.explode(listed).alias("token")))
    by_token = first.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token")
    by_token = by_token.agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all")).where("most.n < all")
    met = cut(_on(first, by_token.select("token", F.col("most.component").alias("major"), (F.col("all") - F.col("most.n")).alias("others"), "all"), "token"))
    few = met.where(F.col("all") <= PAIR_LIMIT)
    # two sets share the tokens counted here, at most those of crowds that each has, and what lies behind one's prefix
    crowded = first.select("token", "node").join(few.select("token").distinct(), "token", "left_anti").groupBy("node").agg(F.count("*").alias("crowded"))
    facts = first.select("node", "size", "tail").distinct().join(crowded, "node", "left").select("node", F.struct("size", "tail", F.coalesce("crowded", F.lit(0)).alias("crowded")).alias("of"))
    a, b = (few.select("token", F.col("node").alias(n), F.col("component").alias(f"{n}_part")) for n in ("src", "dst"))
    pairs = _on(a, b, "token").where("src < dst and src_part <> dst_part").groupBy("src", "dst").agg(F.count("*").alias("both"))
    for n in ("src", "dst"):
        pairs = _on(pairs, facts.select(F.col("node").alias(n), F.col("of").alias(f"{n}_")), n)
    most = F.col("both") + F.least("src_.crowded", "dst_.crowded") + F.greatest("src_.tail", "dst_.tail")
    sizes = F.col("src_.size") + F.col("dst_.size")
    pairs = pairs.where(most * (1 + similarity) >= similarity * sizes - 1e-6).select("src", "dst")
    links = _verified(pairs, shingles, similarity)
    met = met.where(F.col("all") > PAIR_LIMIT)
    blocks = F.ceil(F.col("others") / BLOCK).cast("int")
    own = F.when(F.col("component") != F.col("major"), F.pmod(F.xxhash64("node"), blocks).cast("int"))
    parts = F.ceil(F.col("all") / PART).cast("int").alias("parts")
    met = met.select("token", "node", "component", own.alias("own"), parts, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    # a block's own nodes are one side; nodes of the largest component, and of later blocks, are the other
    met = met.where(F.col("own").isNull() | (F.col("own") >= F.col("block")))
    met = met.withColumn("side", F.when(F.col("own") == F.col("block"), 0).otherwise(1))
    # the other side is cut into parts, each of which meets the whole block
    dealt = F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    met = met.withColumn("part", F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(dealt)))
    crowds = _compared(_on(met.select("token", "block", "part", "side", "node", "component"), shingles, "node"), similarity)
    found = cut(links.unionByName(crowds))
    discard(nodes)
    return found


def linked(units: DataFrame, docs: DataFrame, whole: bool = False, similarity: float = SIMILARITY, more: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes of units that are linked. more(src, dst) are further candidate pairs to verify."""
    members = _members(units)
    pairs = members.where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst"))
    if more is not None:
        pairs = pairs.unionByName(more)
    pairs = written(pairs.distinct())
    nodes = written(members.select("node").union(pairs.select("src")).union(pairs.select("dst")).distinct())
    shingles = _shingles(docs, whole, nodes)
    first = cut(_verified(pairs, shingles, similarity))
    second = _rest(members, shingles, connected_components(first), similarity)
    discard(members, pairs, nodes, shingles)
    return connected_components(first.unionByName(second))


def duplicate_passages(df: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each maximal passage that occurs again, exactly or nearly, in the same or another document.

    Columns: id_col; start, end (code points of the text, end exclusive); n_words; cluster_id (16 hex digits, the component of
    the passage's first unit); keeper (the id of the document that has the first occurrence: least id, then least start);
    removed (false for the first occurrences only: what is removed leaves one copy of each passage); n_rows.
    Units of a text that overlap or touch are one passage where they have the same keeper and the same fate.
    Null and empty texts have no passages. A null id comes last in its cluster. Rows that repeat id and text are one row
    here, counted in n_rows, and of what only they share both are first. Texts of any length are whole. An empty table gives
    an empty result. Other columns aren't read.
    """
    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    units = _units(docs)
    groups = linked(units, docs, similarity=similarity)
    counted = units.groupBy("node").agg(F.count("*").alias("n"), F.min("check").alias("check")).where("n > 1").select("node", "check")
    again = counted.join(groups, "node", "full").select("node", "check", F.coalesce("component", "node").alias("cluster"))
    again = written(again)
    rows = _on(_likely(units.drop("bands").withColumnRenamed("check", "own"), again), again, "node")
    # two texts that share 64 bits of a hash but not the next 32 are left alone
    rows = rows.where(F.col("check").isNull() | (F.col("check") == F.col("own")))
    rows = rows.groupBy("id", "content", "start", "end", "first", "n", "cluster").agg(F.count("*").alias("n_rows"))
    # units of one text that overlap are alike by that alone: one occurrence
    rows = written(_joined(rows, ["id", "content", "cluster"], 0))
    discard(units, again)
    place = F.struct(F.isnull("id").alias("none"), F.col("id"), F.col("start"))
    whole = rows.groupBy("cluster").agg(F.min(place).alias("keeper"), F.sum("n_rows").alias("size")).where("size > 1")
    rows = _on(rows, whole.select("cluster", "keeper"), "cluster")
    kept = F.col("keeper.id").eqNullSafe(F.col("id")) & (F.col("keeper.start") == F.col("start"))
    rows = rows.withColumn("removed", ~kept).withColumn("keeper", F.col("keeper.id"))
    out = _joined(rows, ["id", "content", "keeper", "removed"], 1)
    return out.select(
        F.col("id").alias(id_col), "start", "end", F.col("n").cast("long").alias("n_words"), F.lower(F.lpad(F.hex("cluster"), 16, "0")).alias("cluster_id"), "keeper", "removed", "n_rows"
    )


def _joined(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    """rows(first, n, start, end, cluster, n_rows, *by), those of the same by that overlap, or lie less than gap words apart, as one."""
    line = Window.partitionBy(*by).orderBy("first", "n")
    before = F.max(F.col("first") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("first") < before + gap, 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"),
        (F.max(F.col("first") + F.col("n")) - F.min("first")).alias("n"), F.max("n_rows").alias("n_rows"),
        *([] if "cluster" in by else [F.min_by("cluster", "first").alias("cluster")]),
    ).drop("part")
