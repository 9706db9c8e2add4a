"""Pieces that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that each operator at work has saved, the innermost operator last.
SCRATCH: list[list[str]] = []

#: Spark then drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared folder.

    The folder is what the session has as ``spark.checkpoint.dir``; only where
    that is unset and all runs on one machine, a temporary folder stands in.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc._conf.set("spark.checkpoint.dir", base)
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ferrule-{uuid.uuid4().hex}"


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``saved`` and the folder's name, for ``discard``.  What was shuffled to
    get there is not needed again, so those files go when the table is written."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if SCRATCH:
        SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: later jobs read it
    again instead of computing it again, whichever executors have been lost."""
    return saved_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy_at(f: Callable[..., DataFrame]) -> Callable[..., tuple[DataFrame, str]]:
    """``f`` with its result as a table, and that table's folder; all else that was saved on the way is removed."""

    @wraps(f)
    def call(*args, **options) -> tuple[DataFrame, str]:
        spark = next(x if isinstance(x, SparkSession) else x.sparkSession for x in (*args, *options.values()) if isinstance(x, SparkSession | DataFrame))
        SCRATCH.append([])
        path = None
        try:
            table, path = saved_at(f(*args, **options))
        finally:
            for p in SCRATCH.pop():
                if p != path:
                    discard(spark, p)
        if SCRATCH:
            SCRATCH[-1].append(path)
        return table, path

    return call


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``tidy_at`` without the folder."""
    at = tidy_at(f)
    return wraps(f)(lambda *args, **options: at(*args, **options)[0])


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def learns(id_col: str, mod: int, held: int = 1) -> Column:
    """True for rows that may be learned from: crc32(id as text) mod ``mod`` is not ``held``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod != held


def as_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


#: What tasks of one operator keep for the next ones; tasks of any other make it ``forget``.
KEPT: list = []


def release_memory(keep: object = None) -> None:
    """Give back what earlier tasks of this Python worker have freed or left, but
    for ``keep``; Spark reuses workers for many tasks, of other operators too."""
    import ctypes
    import gc

    for x in KEPT:
        if x is not keep:
            x.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int, keep: object = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column`` (a longer row stands alone)."""
    release_memory(keep)
    for b in batches:
        size = b.column(column).nbytes if b.num_rows else 0
        step = max(1, int(b.num_rows * most / max(size, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
