"""Written tables in the cluster's shared folder, used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[Table] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in a local session without one, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vantor-")
        atexit.register(shutil.rmtree, folder, True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is no longer referred to, as it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives this process's freed memory back to the system, which Arrow and the C library otherwise keep."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of an execution go when it ends, without waiting for the driver to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Table:
    """A written DataFrame: ``df`` reads it back, ``drop`` removes its files."""

    def __init__(self, df: DataFrame, name: str, partition_by: str | None = None):
        self.spark, self.name = df.sparkSession, name
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _WRITTEN.append(self)

    def drop(self) -> None:
        if self in _WRITTEN:
            _WRITTEN.remove(self)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once into the shared folder and read back; a lost executor costs no recomputation.

    The files stay until :func:`release`, as results that read them are computed later.
    """
    return Table(df, name).df


def mark() -> int:
    """A point after which tables are written, for :func:`release`."""
    return len(_WRITTEN)


def release(since: int = 0, keep: int = 0) -> None:
    """Removes the files of all tables written since a mark, but for the last ``keep``; results that read them are gone too."""
    for table in _WRITTEN[since : len(_WRITTEN) - keep]:
        table.drop()


def release_named(since: int, *names: str) -> None:
    """Removes the files of the tables of some names that were written since a mark."""
    for table in _WRITTEN[since:]:
        if table.name in names:
            table.drop()
