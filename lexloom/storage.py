"""Tables written to the folder that all executors share, to cut lineage and share results between passes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master gets one made here when it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    _delete_on_exit(spark, made)
    return made


_made: dict[str, SparkSession] = {}


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    if not _made:
        atexit.register(_delete_made)
    _made[path] = spark
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # also if Python ends before


def _delete_made() -> None:
    for path, spark in _made.items():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM is gone and has deleted them, or can't
            return


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes away when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    for paths in _open_scopes[-1:]:
        paths.append(path)
    return path


_open_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged inside; the results of the queries inside must be written or collected by then.

    An application that runs many queries keeps the shared folder small by a scope around each.
    """
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a place of :func:`fresh_path` before its time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more, which it else does when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Every later pass reads the files, so a lost executor costs a re-read and never a recomputation.
    The files go away when the driver's JVM ends, or with the :func:`scope` around.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
