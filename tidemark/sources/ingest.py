"""Ingest of files that goes on where it stopped: a file stream into a cache with a marker for every empty file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import made
from .tables import held_rows, unheld

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def named(files: DataFrame) -> DataFrame:
    """files with file, the name at the end of each path."""
    return files.withColumn("file", F.regexp_extract("path", "([^/]*)$", 1))


def ingest_files(spark: SparkSession, folder: str, cache: str, progress: str, parse: Callable[[DataFrame], DataFrame], schema: str, *, pattern: str = "*.zip", files_per_batch: int = 1000) -> int:
    """Adds what new files of the folder hold to the cache; the number of batches that this took.

    A stream over the folder takes the files that it hasn't seen, in batches, and ends when there are none (availableNow); what
    it has seen stands in `progress`. parse gets files (path, content, file) and returns their rows with a column file; schema is
    theirs. A file whose name the cache holds already is passed over; one without rows leaves a marker, once the batch's rows are
    written. Each batch writes a partition of its own number, so that one that was cut off is written over when it is run again, and
    adds nothing twice.
    """
    made(spark, cache)

    def add(batch: DataFrame, number: int) -> None:
        files = named(batch.select("path", "content"))
        held = cached_files(spark, cache, schema).where(F.col("batch") != number)
        new, own = unheld(files, held, "file"), f"{cache}/batch={number}"
        rows = parse(files.join(F.broadcast(new), "file", "left_semi"))  # files_per_batch names
        rows.write.mode("overwrite").parquet(own)
        marked = unheld(new, spark.read.schema(rows.schema).parquet(own), "file")
        marked.select(*[F.col(c) if c == "file" else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes]).write.mode("append").parquet(own)

    source = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    run = source.writeStream.foreachBatch(add).trigger(availableNow=True).option("checkpointLocation", progress).start()
    run.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in run.recentProgress)


def cached_files(spark: SparkSession, cache: str, schema: str) -> DataFrame:
    """All rows of the cache with the number of their batch, markers included."""
    return spark.read.schema(f"{schema}, batch int").parquet(cache)


def ingested(spark: SparkSession, cache: str, schema: str, key: str) -> DataFrame:
    """The rows of the cache without markers."""
    return held_rows(cached_files(spark, cache, schema), key).drop("batch")
