"""Tables and folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; on one machine below a temporary folder where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ferrule-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a query that runs within goes when that ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Tables:
    """Tables written to the shared folder while an operator works: what follows
    does not compute them again, whichever executors are lost.

    ``put`` writes one, ``drop`` removes one that nothing reads any more; with
    ``with``, all are removed in the end but those that ``keep`` has named."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for path, _ in self.paths.values():
            self._remove(path)
        self.paths = {}

    def put(self, df: DataFrame, instead: DataFrame | None = None, compression: str | None = None) -> DataFrame:
        """``df`` as a table; ``instead`` was one of these and is removed."""
        path = shared_folder(self.spark)
        # what was shuffled to get there is not needed again
        with shuffle_files_go(self.spark):
            df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        # the frame is held, so that no other gets its id
        self.paths[id(out)] = path, out
        if instead is not None:
            self.drop(instead)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, one of these tables, whose files stay."""
        self.paths.pop(id(df), None)
        return df

    def drop(self, df: DataFrame) -> None:
        if id(df) in self.paths:
            self._remove(self.paths.pop(id(df))[0])

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder that stays, for what reads them later."""
    tables = Tables(df.sparkSession)
    return tables.keep(tables.put(df, compression=compression))
