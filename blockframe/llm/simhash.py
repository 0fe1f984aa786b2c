"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A fingerprint is 64 bits, the bitwise majority over the hashes of a text's word shingles. Texts are linked where their
fingerprints differ in at most `MAX_BITS` bits.

Candidate search. The fingerprint is cut into three segments of 22, 21 and 21 bits. Of at most two differing bits none
falls into at least one segment (pigeonhole), and the next segment then differs in at most two. A segment, padded to 23
bits, is decoded with the perfect binary Golay code (23, 12, 7), it and all words one bit away: the indices of the code
words met are its keys (one key, or six at most), and two segments within two bits of each other always share a
key, since some word lies within one bit of both. So two linked fingerprints share (segment number, segment, Golay key
of the next segment), a join key of 34 bits, without neighbours being enumerated over 64 bits.

Linking. Fingerprints are made distinct first, so a group of copies of any size is one row. Fingerprints under a key are
joined and verified (bit_count of the difference) where they are few. Where more than `PAIR_LIMIT` distinct fingerprints
share a key (thousands of near copies), pairs would grow with the square of the group. There each fingerprint and its
one-bit neighbours outside the equal segment are emitted instead, and those with a common neighbour are linked to the
least of them: they are within two bits by construction, and every pair within two bits has such a neighbour. Both ways
are exact; the components are the same.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import paragraphs
from .components import connected_components, keep_first
from .runtime import add_columns, bound_batches, cut, texts

MAX_BITS = 2
#: Distinct fingerprints under one key up to which they are joined pairwise.
PAIR_LIMIT = 12
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the perfect binary Golay code (23, 12, 7).
GENERATOR = 0b101011100011

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, width: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is set where over half of the shingle hashes have it."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    if len(words) < width:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8")
    # counts of set bits, in blocks so that a text of any length needs little memory
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", width: int = 3) -> DataFrame:
    """df with the fingerprint of a text column as a long (the 64 bits, signed). A null text counts as empty: zero."""

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            values = np.array([fingerprint(x, width) for x in texts(column)], dtype=np.uint64)
            return [pa.array(values.view(np.int64), type=pa.int64())]

        return run

    bound_batches(df.sparkSession)
    return add_columns(df, [text], [T.StructField(out, T.LongType())], make)


def as_hex(bits: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


@cache
def _decoder() -> np.ndarray:
    """The number of the one code word within three bits of each 23-bit word."""
    n = 1 << 12
    words = np.zeros(n, dtype=np.int64)
    for i in range(n):
        r = i << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        words[i] = i << 11 | r
    table = np.full(1 << 23, -1, dtype=np.int16)
    errors = [0]
    for a in range(23):
        errors.append(1 << a)
        for b in range(a):
            errors.append(1 << a | 1 << b)
            errors.extend(1 << a | 1 << b | 1 << c for c in range(b))
    index = np.arange(n, dtype=np.int16)
    for e in errors:
        table[words ^ e] = index
    return table


def golay_keys(segments: np.ndarray, bits: int) -> list[np.ndarray]:
    """The distinct Golay keys of each segment: code words met by it and by all words one bit away."""
    table = _decoder()
    flips = np.array([0, *(1 << i for i in range(bits))], dtype=np.int64)
    met = np.sort(table[segments[:, None] ^ flips], axis=1)
    first = np.ones(met.shape, dtype=bool)
    first[:, 1:] = met[:, 1:] != met[:, :-1]
    return [m[f] for m, f in zip(met, first, strict=True)]


def _keyed(distinct: DataFrame) -> DataFrame:
    """(key, simhash) for each key of each distinct fingerprint."""

    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = prints.view(np.uint64)
            part = [((bits >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
            keys, rows = [], []
            for i in range(3):
                j = (i + 1) % 3
                near = golay_keys(part[j], SEGMENTS[j][1])
                times = np.array([len(k) for k in near])
                head = (np.int64(i) << np.int64(34)) | (part[i] << np.int64(12))
                keys.append(np.repeat(head, times) | (np.concatenate(near).astype(np.int64) if len(near) else 0))
                rows.append(np.repeat(prints, times))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(rows))], names=["key", "simhash"]
            )

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("simhash", T.LongType())])
    return distinct.select("simhash").mapInArrow(run, schema)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints that join all that differ in at most `MAX_BITS` bits.

    Every edge is a true link; of a larger group only as many are returned as connect it the same way.
    """
    keyed = cut(_keyed(distinct))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # joined on a hash besides the key, so that a hot key's rows can be split over tasks
    members = cut(
        keyed.withColumn("k", F.xxhash64("key")).join(shared.withColumn("k", F.xxhash64("key")), ["k", "key"])
    )
    few = members.where(F.col("n") <= PAIR_LIMIT).select("key", "simhash")
    pairs = (
        few.select("key", F.col("simhash").alias("src"))
        .join(few.select("key", F.col("simhash").alias("dst")), "key")
        .where("src < dst")
        .where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS)
        .select("src", "dst")
    )
    crowd = members.where(F.col("n") > PAIR_LIMIT).select("simhash").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)))
    near = crowd.select("simhash", F.explode(flips).alias("flip")).select(
        "simhash", F.col("simhash").bitwiseXOR(F.col("flip")).alias("near")
    )
    # only 65 words lie within one bit of a word, so no group here has more rows
    met = near.groupBy("near").agg(F.min("simhash").alias("dst"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(met, "near").where("simhash <> dst").select(F.col("simhash").alias("src"), "dst")
    return pairs.unionByName(stars).distinct()


def components(small: DataFrame) -> DataFrame:
    """(simhash, component_id, first) for each distinct fingerprint of small(id, simhash, content).

    component_id is the least id of the fingerprint's group, null if it has none. first is (none, id, simhash, content)
    of the row that represents the group: the least id, then fingerprint, then content hash.
    """
    least = F.min(F.struct(F.isnull("id").alias("none"), "id", "simhash", "content")).alias("best")
    nodes = cut(small.groupBy("simhash").agg(least))
    groups = connected_components(links(nodes)).withColumnRenamed("node", "simhash")
    named = nodes.join(groups, "simhash", "left").select(
        "simhash", "best", F.coalesce("component", "simhash").alias("component")
    )
    chosen = named.groupBy("component").agg(F.min("best").alias("first"))
    left = named.select(F.xxhash64("component").alias("k"), "component", "simhash")
    right = chosen.select(F.xxhash64("component").alias("k"), "component", "first")
    return left.join(right, ["k", "component"]).select("simhash", F.col("first.id").alias("component_id"), "first")


def _small(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, simhash, content) of each row, content being a hash of its text; written once, texts aren't kept."""
    pruned = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    return cut(fingerprints(pruned).select("id", "simhash", "content"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, simhash, component_id): a row for each row of df, with the least id reachable over links.

    Rows with the same fingerprint are linked. A null or empty text has the fingerprint zero and is linked like any
    other. A null id is never the least; a group of null ids only has a null component_id. Repeated rows all get a row.
    An empty table gives an empty result; other columns of df aren't read.
    """
    small = _small(df, id_col, text)
    return small.join(components(small), "simhash").select(F.col("id").alias(id_col), "simhash", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay when one of each group is kept: the one with the least id.

    Ties in the id go to the least fingerprint and content hash, and of rows that repeat all three one stays. Columns are
    those of df. Fingerprints are made once; the rows to keep are then found by id and content hash, a JVM expression.
    """
    return keep_first(df, components(_small(df, id_col, text)), id_col, text)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = paragraphs.SIMILARITY) -> DataFrame:
    """The rows of df that stay when one of each group of near copies is kept: the one with the least id.

    Whole texts are linked where the exact Jaccard similarity of their 5-word shingles reaches similarity, groups are the
    components. Candidates come from Golay keys of their 64-bit fingerprints over 5-word shingles, at `MAX_BITS` bits or
    fewer. Fingerprints of texts of similarity 0.8 differ in 10 bits, with a spread of 3, which no radius that is worth
    joining on finds; so MinHash bands of the same shingles give further candidates, with a recall of 0.9999 at 0.8.
    All candidates are verified alike.
    Words are separated by any white space and compared in lower case. Null and empty texts are one group. Ties in the id go
    to the least node and content hash, and of rows that repeat all three one stays. Columns are those of df, whatever
    their names. An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    units = paragraphs.whole_texts(docs)
    distinct = cut(units.select("node", "simhash").distinct())
    prints = cut(distinct.groupBy("simhash").agg(F.min("node").alias("dst")))
    same = distinct.join(prints, "simhash").where("node <> dst").select(F.col("node").alias("src"), "dst")
    a, b = (prints.select(F.col("simhash").alias(c), F.col("dst").alias(f"{c}_node")) for c in ("src", "dst"))
    close = links(prints).join(a, "src").join(b, "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    groups = paragraphs.linked(units, docs, True, similarity, same.unionByName(close))
    least = F.min(F.struct(F.isnull("id").alias("none"), F.col("id"), F.col("node"), F.col("content"))).alias("best")
    named = units.groupBy("node").agg(least).join(groups, "node", "left")
    first = named.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("best").alias("first"))
    return keep_first(df, first, id_col, text)
