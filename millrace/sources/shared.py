"""The folder that driver and executors share, and tables settled there."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The open scopes of this thread, innermost last: each lists the folders that it removes.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


def file_at(spark: SparkSession, path: str):
    """The store that a path is in, and the path as the store's calls take it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    """The folder goes from the store that it is in."""
    files, at = file_at(spark, path)
    files.delete(at, True)


def temporary(spark: SparkSession, kind: str = "millrace") -> str:
    """A new folder's path in the shared folder; what is there goes when the application ends, if not before."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    files, at = file_at(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread settles inside are removed at the end; results that read them must have been written by then."""
    own: list[str] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in own:
            removed(spark, path)


def settled(df: DataFrame, into: list[str] | None = None) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here, lost executors cost nothing.

    The table stays until the thread's enclosing `scratch` ends, or the application where there is none. With
    `into` its folder is listed there instead, for the caller to remove.
    """
    path = temporary(df.sparkSession)
    df.write.mode("append").parquet(path)
    if into is not None:
        into.append(path)
    elif _scopes.get():
        _scopes.get()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that a join may broadcast, counted first; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew only where a small input has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it where it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
