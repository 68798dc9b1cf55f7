"""Helpers shared by the training-data operators.

Words are maximal runs of anything but the six ASCII white-space characters
``[\\x20\\x09-\\x0D]``; ``bytes.split()`` splits UTF-8 at exactly those.
"""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words.
SPACE = " \t\n\x0b\f\r"
SPACE_BYTES = SPACE.encode()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A local session without that setting gets a temporary folder of its own; a
    cluster session without it is an error, as a machine-local folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    """A JVM path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the application ends."""
    root = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"
    path, system = _hadoop_path(spark, root)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


#: Paths that written() made in the calls of settled() that are running.
_MADE: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends here.

    The schema is passed on, so an empty table reads back too. discard() deletes the table early.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _MADE:
        _MADE[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more; other tables are left alone."""
    for df in frames:
        if path := df.__dict__.get("_scratch"):
            found, system = _hadoop_path(df.sparkSession, path)
            system.delete(found, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """written() of what make returns; the tables that were written on the way to it are deleted."""
    _MADE.append([])
    try:
        out = written(make(), name)
    finally:
        paths = _MADE.pop()
    for path in paths:
        if path != out._scratch:
            found, system = _hadoop_path(out.sparkSession, path)
            system.delete(found, True)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(text: Column) -> Column:
    """text (null: empty) without white space at both ends."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))


def word_array(text: Column) -> Column:
    """The words of a text as an array, natively."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in batches that are sorted by them, as (key, rows).

    Only one run is held at a time; batch borders inside a run are bridged.
    """
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if held and rows[start] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = rows[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield now, pa.Table.from_batches(held)


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A mapInArrow function from one that maps a batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return each


def worker_memo(name: str, make: Callable):
    """What make() returned first under this name in this Python worker; tasks that reuse the worker find it again.

    For stores that only save time: a new worker starts without.
    """
    memo = sys.modules.setdefault("_textloom_memo", types.ModuleType("_textloom_memo")).__dict__
    if name not in memo:
        memo[name] = make()
    return memo[name]


#: Bytes of files up to which a table of few files may be dealt out over the cores.
SMALL_TABLE = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table for one pass that is all work: a small one in fewer files than there are cores, such as a file of a single row
    group, is dealt out over them; any other, having splits enough, stays where it lies. The size is the plan's, so nothing is read for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size <= SMALL_TABLE and len(df.inputFiles()) < cores else df
