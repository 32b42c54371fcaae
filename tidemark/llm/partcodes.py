"""Compression of vectors to short codes: each part of a vector becomes the number of its nearest codebook entry."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize
from .vectorblocks import as_batch, blocks, first_vectors, floors, unpacked, whole_vectors

#: Copies of each label's sum, so that rows of a frequent label meet it in as many tasks.
SALTS = 64


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of part (components x vectors) the number of the nearest entry of book (entries x components), ties to
    the lower one, and its squared distance. Distances accumulate dimension by dimension."""
    total = np.zeros((part.shape[1], len(book)), np.int64)
    for values, entries in zip(part, book.T, strict=True):
        gap = values[:, None] - entries[None, :]
        total += gap * gap
    code = total.argmin(axis=1)
    return code, total[np.arange(len(code)), code]


class Gather:
    """Sums of the vectors next to each entry: the two steps of a treeAggregate. Sums are parts x components x entries, counts
    parts x entries, both int64; None stands for a partition without blocks."""

    def __init__(self, books: np.ndarray):
        self.books = books

    def add(self, total: tuple | None, block: tuple[int, bytes]) -> tuple:
        parts, entries, width = self.books.shape
        sums, counts = total or (np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64))
        x = unpacked(block[0], bytes(block[1]), parts * width)
        for p, book in enumerate(self.books):
            own = x[p * width : (p + 1) * width]
            code, _ = nearest(own, book)
            for d in range(width):
                np.add.at(sums[p, d], code, own[d])
            np.add.at(counts[p], code, 1)
        return sums, counts

    @staticmethod
    def merge(a: tuple | None, b: tuple | None) -> tuple | None:
        if a is None or b is None:
            return b if a is None else a
        return a[0] + b[0], a[1] + b[1]


def improve(blocked: DataFrame, books: np.ndarray, rounds: int, depth: int = 2) -> np.ndarray:
    """The codebooks (parts x entries x components) after the rounds: entries become their parts' floor(sum / count)."""
    rows = blocked.select("n", "x").rdd
    for _ in range(rounds):
        step = Gather(books)
        total = rows.treeAggregate(None, step.add, Gather.merge, depth)
        if total is None:
            break
        sums, counts = (a.swapaxes(1, 2) if a.ndim == 3 else a[:, :, None] for a in total)
        books = np.where(counts > 0, sums // np.maximum(counts, 1), books)
    return books


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0
) -> DataFrame:
    """Codes of vectors by codebooks that are learnt from all of them: the id, code, error, label_error, codebooks_sha256.

    Components count as floor(scale * x). Vectors are cut into `parts` equal consecutive parts; the codebook of a position
    starts as that part of the vectors with the `entries` smallest ids. Each round reads the blocks of all vectors once: a
    treeAggregate over RDD partitions adds int64 sums and counts to one tensor for each partition and merges tensors in
    a tree, so that parts x entries x components numbers reach the driver, however many vectors there are. Blocks are a
    table in the shared folder; lost executors only repeat their partitions of a round.

    code has two hex digits for each part (four beyond 256 entries), error is the sum of the squared distances, label_error
    the sum of errors over equal labels (nulls together).

    Vectors that are null or hold null or non-finite components don't come back. The length is the one that most
    vectors have among those that divide into parts (ties: the shorter one); vectors of other lengths, empty ones too, come back
    with a null code and error. Null ids come last among the starting vectors and repeated ids are rows of their own, in the
    order of their components. Fewer vectors than entries give as many entries; equal entries tie to the lower number, so
    the others stay unused. Components beyond the range in which squared distances fit a long are held to it; a label_error
    beyond a long is null. Other columns are ignored. An empty table gives an empty result.
    """
    rows = whole_vectors(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), "v", "id", "label")
    size = F.size("x")
    lengths = rows.where((size > 0) & (size % parts == 0)).groupBy(size.alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = lengths[0].dims if lengths else 0
    digest, digits = None, 2 if entries <= 256 else 4
    coded = rows.where(size != dims).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if lengths:
        fit = rows.where(size == dims)
        blocked = materialize(blocks(fit, ("id", "label"), dims, scale), "part-blocks")
        start = floors(first_vectors(fit, entries, F.col("id").asc_nulls_last()), scale, dims)
        books = improve(blocked, start.reshape(len(start), parts, dims // parts).swapaxes(0, 1), rounds)
        digest = codebook_digest(books)
        schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
        coded = coded.unionByName(blocked.mapInArrow(_encode(books, digits), schema))
        coded, used = materialize(coded, "part-codes"), blocked
        discard(used)
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("with"))
    salted = coded.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # stable: coded is a written table
    found = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("with")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _encode(books: np.ndarray, digits: int):
    """Codes and errors of the vectors in each block."""

    def run(batches):
        parts, entries, width = books.shape
        names = np.array([f"{k:0{digits}x}" for k in range(entries)], dtype=object)
        for batch in batches:
            for row in range(batch.num_rows):
                n, raw = batch.column("n")[row].as_py(), batch.column("x")[row].as_py()
                x = unpacked(n, raw, parts * width)
                found = [nearest(x[p * width : (p + 1) * width], book) for p, book in enumerate(books)]
                code = sum((names[c] for c, _ in found[1:]), names[found[0][0]])
                error = sum(e for _, e in found)
                yield as_batch({"id": batch.column("id").slice(row, 1).flatten(), "label": batch.column("label").slice(row, 1).flatten(), "code": pa.array(code, pa.string()), "error": error})

    return run
