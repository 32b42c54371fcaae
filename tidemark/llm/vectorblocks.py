"""Integer vectors in columnar blocks: what the code compressor and the centroid clustering read in every round."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Numbers of a block at most, so that a block and what is computed from it stay at a few MB.
BLOCK_VALUES = 1 << 19


def whole_vectors(vectors: DataFrame, vector_col: str, *kept: str) -> DataFrame:
    """The kept columns, then x, the components as doubles, of the vectors that aren't null and hold no null or non-finite ones."""
    rows = vectors.select(*kept, F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def most(dims: int) -> int:
    """The largest component whose squared distances over dims components fit a long; larger ones are held to it."""
    return isqrt(((1 << 63) - 1) // dims) // 2


def floors(x: np.ndarray, scale: float, dims: int) -> np.ndarray:
    """floor(scale * x) as int64, held to the range in which squared distances are exact."""
    return np.clip(np.floor(x * scale), -most(dims), most(dims)).astype(np.int64)


def blocks(rows: DataFrame, kept: tuple[str, ...], dims: int, scale: float, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Rows of vectors of dims components as blocks: n, the kept columns as arrays, and x, the integer components, all first
    ones, then all second ones, and so on, in 2 or 4 bytes as their range asks for."""
    size = max(1, block_values // dims)
    fields = [StructField("n", IntegerType()), *[StructField(c, ArrayType(rows.schema[c].dataType)) for c in kept], StructField("x", BinaryType())]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                values = part.column("x").flatten().to_numpy(zero_copy_only=False)
                x = floors(values.reshape(part.num_rows, dims).T, scale, dims)
                narrow = np.ascontiguousarray(x, "<i2" if np.abs(x).max() < 1 << 15 else "<i4")
                yield as_batch({"n": pa.array([part.num_rows], pa.int32())} | {c: as_list(part.column(c)) for c in kept} | {"x": [narrow.tobytes()]})

    return rows.select(*kept, "x").mapInArrow(run, StructType(fields))


def as_list(column: pa.Array) -> pa.Array:
    """A column as the one array of a block."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def as_batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def unpacked(n: int, raw: bytes, dims: int) -> np.ndarray:
    """The components of a block, an array of dims x n."""
    return np.frombuffer(raw, f"<i{len(raw) // (n * dims)}").reshape(dims, n).astype(np.int64)


def first_vectors(rows: DataFrame, count: int, *order: str | Column) -> np.ndarray:
    """The vectors of the first `count` rows by the order, ties by the vector: a bounded number reaches the driver."""
    return np.array([r.x for r in rows.orderBy(*order, "x").limit(count).select("x").collect()], float)
