"""Tables of Parquet folders by bucket whose versions are replaced as one.

A commit writes new folders and then a manifest, a small JSON file that names the folders of every bucket. Readers follow
the newest manifest, so they see all of a commit or nothing; folders of buckets that it doesn't touch are named again and
stay as they are. A commit may carry a token, the number of a stream's batch: one that is there already isn't made again.
There is one writer for a path at a time; a second one that makes the same commit number fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Change:
    """Rows for a table, by their column bucket (text or a whole number): added, or in place of what buckets hold.

    replaced lists buckets whose rows go, also those for which there are no new ones; others are added to.
    """

    table: str
    rows: DataFrame
    replaced: tuple = ()
    #: Columns that are looked up by equality, and get a Bloom filter in each file.
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    #: Tasks that the buckets are dealt over, for small rows that they share evenly: so that many small files aren't one task's.
    #: Without it, tasks are as many as the rows are large, and a bucket with many rows is split.
    tasks: int | None = None
    #: Rows that lie by bucket, in order, and are written by the tasks that hold them.
    dealt: bool = False


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    path: str
    number: int = 0
    token: int | None = None
    facts: dict = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    folders: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def buckets(self, table: str) -> list[str]:
        return list(self.folders.get(table, {}))

    def parts(self, table: str, buckets=None) -> list[str]:
        """The folders of a table, or of some of its buckets."""
        held = self.folders.get(table, {})
        wanted = held if buckets is None else dict.fromkeys(str(b) for b in buckets)
        return [f"{self.path}/{f}" for b in wanted for f in held.get(b, [])]

    def read(self, table: str, buckets=None, schema: T.StructType | str | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets, without the column bucket; none if it has none.

        schema serves a table that has no commit yet.
        """
        known = T.StructType.fromJson(json.loads(self.schemas[table])) if table in self.schemas else schema
        parts = self.parts(table, buckets)
        return self.spark.read.schema(known).parquet(*parts) if parts else self.spark.createDataFrame([], known)


def _fs(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, root = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def current(spark: SparkSession, path: str) -> Snapshot:
    """The newest version at a path; an empty one if there is none."""
    path = path.rstrip("/")
    done = sorted(n for n in _names(spark, f"{path}/commits") if n.endswith(".json"))
    if not done:
        return Snapshot(spark, path)
    fs, at = _fs(spark, f"{path}/commits/{done[-1]}")
    stream = fs.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Snapshot(spark, path, **json.loads(text))


#: Tables of a commit that are worked on at once: most are small, and their files are written one after the other by few tasks.
AT_ONCE = 8


def each(spark: SparkSession, work: Callable, items: Iterable, at_once: int = AT_ONCE) -> list:
    """work of each item, a few at once: Spark jobs that don't wait for each other. The first failure is raised when all have ended."""
    with ThreadPoolExecutor(at_once) as pool:
        tasks = [pool.submit(inheritable_thread_target(spark)(work), item) for item in items]
    return [t.result() for t in tasks]


#: What holds while tables are written: a write's exchanges leave the disk when it ends, not when the driver happens to collect
#: its garbage; and sides of a join that are dealt alike by one of its keys stay where they lie.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class Written:
    """A change's rows in a folder that no manifest names yet."""

    base: Snapshot
    change: Change
    place: str
    buckets: tuple[str, ...]

    def rows(self, buckets: Iterable[str] | None = None) -> DataFrame:
        """The rows with their bucket, or those of some buckets; columns that aren't wanted aren't read."""
        whole = self.base.spark.read.schema(self.change.rows.schema).parquet(f"{self.base.path}/{self.place}")
        return whole if buckets is None else whole.where(F.col("bucket").isin([int(b) for b in buckets]))

    def without(self, buckets: Iterable[str]) -> Written:
        """What is left when the folders of some buckets are removed."""
        gone = set(buckets)
        for bucket in gone:
            fs, at = _fs(self.base.spark, f"{self.base.path}/{self.place}/bucket={bucket}")
            fs.delete(at, True)
        return Written(self.base, self.change, self.place, tuple(b for b in self.buckets if b not in gone))


def write(base: Snapshot, change: Change) -> Written:
    """A change's rows, dealt by bucket, under a folder of the next version; a bucket with many rows is split over several files."""
    place = f"{change.table}/commit={base.number + 1}-{uuid.uuid4().hex[:8]}"
    rows = change.rows
    if not change.dealt:
        rows = rows.repartition(change.tasks, "bucket") if change.tasks else rows.hint("rebalance", "bucket")
        if change.order:
            rows = rows.sortWithinPartitions("bucket", *change.order)
    writer = rows.write.partitionBy("bucket").option("compression", "zstd")
    for key in change.keys:  # filters as large as a file's keys need, from 2 KB up, not the 1 MB that one takes otherwise
        writer = writer.options(**{f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.candidates.number#{key}": 10})
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(f"{base.path}/{place}")
    names = _names(base.spark, f"{base.path}/{place}")
    return Written(base, change, place, tuple(n.removeprefix("bucket=") for n in names if n.startswith("bucket=")))


def commit(base: Snapshot, changes: list[Change], facts: dict | None = None, token: int | None = None) -> Snapshot:
    """The version after base with the changes and facts; base itself if its token says that it has them.

    Tables are written at once. What fails half way leaves folders that no manifest names (vacuum removes them).
    """
    if token is not None and base.token is not None and token <= base.token:
        return base
    return publish(base, each(base.spark, lambda change: write(base, change), changes), facts, token)


def publish(base: Snapshot, parts: list[Written], facts: dict | None = None, token: int | None = None) -> Snapshot:
    """The version after base with what was written for it."""
    number = base.number + 1
    folders = {t: dict(b) for t, b in base.folders.items()}
    schemas = dict(base.schemas)
    for part in parts:
        held = folders.setdefault(part.change.table, {})
        for bucket in part.change.replaced:
            held.pop(str(bucket), None)
        for bucket in part.buckets:
            held[bucket] = [*held.get(bucket, []), f"{part.place}/bucket={bucket}"]
        schemas[part.change.table] = part.change.rows.drop("bucket").schema.json()
    after = {"number": number, "token": base.token if token is None else token, "facts": {**base.facts, **(facts or {})}, "schemas": schemas, "folders": folders}
    _publish(base.spark, f"{base.path}/commits", f"{number:012d}.json", json.dumps(after))
    return Snapshot(base.spark, base.path, **after)


def _publish(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A whole file under its name, or an error if that name is taken."""
    fs, final = _fs(spark, f"{folder}/{name}")
    _, draft = _fs(spark, f"{folder}/.{name}-{uuid.uuid4().hex[:8]}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"{name} was committed by another writer")


def merge_parts(base: Snapshot, table: str, most: int = 8, keys: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> Snapshot:
    """base with the buckets of a table that have more than `most` folders rewritten as one each; others aren't read."""
    many = [b for b in base.buckets(table) if len(base.folders[table][b]) > most]
    if not many:
        return base
    rows = [base.read(table, [b]).withColumn("bucket", F.lit(b)) for b in many]
    whole = rows[0]
    for part in rows[1:]:
        whole = whole.unionByName(part)
    return commit(base, [Change(table, whole, tuple(many), keys, order)])


def vacuum(base: Snapshot, keep: int = 2) -> int:
    """Remove commit folders that none of the newest manifests names, and older manifests; the number of folders removed.

    Not to be run while a commit is being written.
    """
    spark = base.spark
    done = sorted(n for n in _names(spark, f"{base.path}/commits") if n.endswith(".json"))
    for name in done[:-keep]:
        fs, at = _fs(spark, f"{base.path}/commits/{name}")
        fs.delete(at, False)
    named = set()
    for name in done[-keep:]:
        fs, at = _fs(spark, f"{base.path}/commits/{name}")
        stream = fs.open(at)
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        named |= {"/".join(f.split("/")[:2]) for held in json.loads(text)["folders"].values() for parts in held.values() for f in parts}
    gone = 0
    for table in base.folders:
        for name in _names(spark, f"{base.path}/{table}"):
            if f"{table}/{name}" not in named:
                fs, at = _fs(spark, f"{base.path}/{table}/{name}")
                fs.delete(at, True)
                gone += 1
    return gone
