"""What the operators share: the folder that all executors see, and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where a local session names none (tests), a fresh one; a cluster must."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps for its next tasks, such as a table of a vocabulary: one at a time, so that the
    operators which share a worker don't add up theirs."""
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Drops what the worker holds, and gives freed memory back to the system: for tasks that need memory of their own."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)


_OPEN: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are materialized inside, and not kept, are deleted at its end: for callers that have written a lazy result."""
    own: list[tuple[SparkSession, str]] = []
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.remove(own)
        for spark, path in own:
            delete(spark, path)


def materialize(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, and survives lost executors.

    The files go when the application ends, or before with discard() or, unless kept, at the end of scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget(spark)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    if _OPEN and not keep:
        _OPEN[-1].append((spark, path))
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


_FORGOT = [0.0]


def _forget(spark: SparkSession, seconds: float = 5.0) -> None:
    """Has the driver collect its garbage, at most once in so many seconds. Plans behind a written table are garbage, and Spark deletes
    their shuffle files and broadcasts on the executors only when the driver's collector has found that."""
    if time.monotonic() - _FORGOT[0] > seconds:
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        _FORGOT[0] = time.monotonic()


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later result reads."""
    for table_ in tables:
        files, where = _file_system(table_.sparkSession, table_.written_to)
        files.delete(where, True)


def delete(spark: SparkSession, path: str, *, on_exit: bool = False) -> None:
    """Delete a folder with all that is in it, now or when the application ends; one that isn't there may be named."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where) if on_exit else files.delete(where, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark resolves it: for what opens it without Spark."""
    files, where = _file_system(spark, path)
    return where.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
