"""What the operators of this subpackage share: Arrow column maps, lineage cuts and input guards."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch between the JVM and a Python worker. Texts differ in length by a factor of 10^4,
#: so both are bounded.
BATCH_ROWS = 400
BATCH_BYTES = 32 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small enough for a Python worker, and let workers import this package.

    A query's batches are bounded when it runs, which may be long after it was built; so the bounds, the same for all
    operators, stay with the session, but only ever lower what it had.
    A driver may have put the package's folder on its own path only; workers look where PYTHONPATH of the context says. On
    a cluster the package is installed or shipped, and a folder that isn't there is ignored.
    """
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    One of our own is made only where none is set and driver and executors are one machine (tests). Elsewhere that's an error:
    a folder of the driver's disk would be lost to the executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like cut, but as a table of columns: smaller, and only the columns that are used are read again."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    _WRITTEN[table] = folder
    return table


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Remove tables that written() made, once nothing that is still to run reads them."""
    for table in tables:
        remove(table.sparkSession, _WRITTEN.pop(table))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
) -> DataFrame:
    """df with columns computed from Arrow arrays; all other columns pass through untouched.

    make() runs once per task and returns a function from the input arrays to one array per output field. An output
    replaces an input column of the same name (compared without case, as Spark does), like withColumn.
    """
    taken = {f.name.lower() for f in outputs}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    by_name = {f.name.lower(): i for i, f in enumerate(df.schema.fields)}
    places = [by_name[c.lower()] for c in inputs]
    through = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    names = [f.name for f in kept] + [f.name for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            new = f(*(batch.column(i) for i in places)) if batch.num_rows else None
            if new is not None:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in through), *new], names=names)

    return df.mapInArrow(run, T.StructType([*kept, *outputs]))


def texts(column: pa.Array) -> list[str]:
    """The Python strings of a column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]
