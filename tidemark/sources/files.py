"""Files that tasks write and read themselves, in a folder that driver and executors share."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one of spark.checkpoint.dir, deleted when the application ends. A local session that names none gets
    a temporary one; a cluster must name it."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return made(spark, f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}", passing=True)


def made(spark: SparkSession, folder: str, *, passing: bool = False) -> str:
    """folder with its file system, as Spark resolves it, created where it isn't there; a passing one goes when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    if passing:
        files.deleteOnExit(where)
    return where.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()


def held(df: DataFrame, name: str) -> DataFrame:
    """df, written once into a shared folder as Parquet: for a table that many jobs read, such as those of a fitted model."""
    folder = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def opened(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A file to write from inside a task: written under a name of its own, then moved, so that no reader sees a part and a repeated
    task replaces it. pyarrow.fs opens the folder (file, hdfs, s3, gs)."""
    local = folder.startswith("file:")
    files, at = (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)) if local else fs.FileSystem.from_uri(folder)
    part = posixpath.join(at, f"_{uuid.uuid4().hex}")
    with files.open_output_stream(part, compression=None) as out:
        yield out
    files.move(part, posixpath.join(at, name))


def archives(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """path, modificationTime, length, content: a row for each file of the folder that fits the pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def write_groups(lines: DataFrame, folder: str, write: Callable[[pa.NativeFile, str, Iterator[pa.RecordBatch]], None], file: str, order: str) -> DataFrame:
    """A file for each value of a column, by write(out, name, its rows in the given order, batch by batch): the names of the files written.

    Spark sorts the rows and a task holds one batch of them, however long a file is."""

    def pieces(batches):
        for batch in batches:
            runs, at = pc.run_end_encode(batch.column(file)), 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                yield name, batch.slice(at, end - at)
                at = end

    def run(batches):
        for name, own in groupby(pieces(batches), key=lambda piece: piece[0]):
            with opened(folder, name) as out:
                write(out, name, (rows for _, rows in own))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["file"])

    return lines.repartition(file).sortWithinPartitions(file, order).mapInArrow(run, "file string")


def write_texts(lines: DataFrame, folder: str, file: str = "file", order: str = "place", line: str = "value") -> DataFrame:
    """Lines as text files, each with its lines in the given order: the names of the files written."""

    def write(out, name, batches):
        for rows in batches:
            out.write("".join(t + "\n" for t in rows.column(line).to_pylist() if t is not None).encode())

    return write_groups(lines, folder, write, file, order)
