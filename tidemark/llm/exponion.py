"""Clustering around centroids, where bounds tell which centroids a vector has to be compared with."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import discard, materialize
from .vectorblocks import as_batch, blocks, first_vectors, floors, unpacked, whole_vectors

#: Room for rounding in every comparison of distances in floating point; what it lets through is compared exactly.
_ROOM = 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c, both int64."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if reach * reach * x.shape[1] < 1 << 53:  # every product and sum is a whole number that a double holds
        a, b = x.astype(float), c.astype(float)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)).astype(np.int64)
    total = np.zeros((len(x), len(c)), np.int64)
    for values, entries in zip(x.T, c.T, strict=True):
        gap = values[:, None] - entries[None, :]
        total += gap * gap
    return total


class Centroids:
    """The centroids of a round, how far each has moved, and for each the others by distance."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.at = now
        apart = np.sqrt(squared(now, now).astype(float))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.next = self.apart[:, 1] if len(now) > 1 else np.full(1, np.inf)
        self.moved = np.zeros(len(now)) if before is None else np.sqrt(((now - before) ** 2).sum(axis=1).astype(float))
        top = np.argsort(self.moved)
        self.others = np.full(len(now), self.moved[top[-1]])  # how far any other one has moved at most
        if len(now) > 1:
            self.others[top[-1]] = self.moved[top[-2]]

    def assign(self, x: np.ndarray, of: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple:
        """The nearest centroid of each row (ties: the smaller number), a bound above its distance, one below that of all others,
        and the number of distances computed.

        A row whose upper bound is below its lower bound, or below half the way from its centroid to the next one, keeps its
        centroid. For others the distance is taken exactly; where that settles nothing, the nearest two centroids lie within
        2 * upper + next of the row's centroid. Those in that ball, its border included, are a prefix of the centroid's sorted
        list; it is scanned up to the next power of two, so that rows of one centroid and prefix are compared together.
        """
        if of is None:
            return (*self._nearest(x, np.arange(len(self.at))), x.shape[0] * len(self.at))
        of, upper, lower = of.copy(), upper + self.moved[of], lower - self.others[of]
        open_ = self._unsettled(of, upper, lower)
        gap = x[open_] - self.at[of[open_]]
        upper[open_] = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(float))
        cost = len(open_)
        open_ = open_[self._unsettled(of[open_], upper[open_], lower[open_])]
        home = of[open_]
        for a in np.unique(home):
            rows = open_[home == a]
            ball = (2 * upper[rows] + self.next[a]) * (1 + _ROOM) + _ROOM
            within = np.searchsorted(self.apart[a], ball, side="right")
            level = np.minimum(len(self.at), 1 << np.ceil(np.log2(np.maximum(within, 2))).astype(int))
            for size in np.unique(level):
                own = rows[level == size]
                of[own], upper[own], lower[own] = self._nearest(x[own], np.sort(self.order[a, :size]))
                cost += len(own) * int(size)
        return of, upper, lower, cost

    def _unsettled(self, of: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return np.flatnonzero(upper * (1 + _ROOM) + _ROOM >= np.maximum(lower, self.next[of] / 2) * (1 - _ROOM))

    def _nearest(self, x: np.ndarray, among: np.ndarray) -> tuple:
        d = squared(x, self.at[among])
        first = d.argmin(axis=1)  # among is ascending, so a tie goes to the smaller number
        rows = np.arange(len(x))
        near = d[rows, first].astype(float)
        if len(among) == 1:
            return among[first], np.sqrt(near), np.full(len(x), np.inf)
        d[rows, first] = np.iinfo(np.int64).max
        return among[first], np.sqrt(near), np.sqrt(d.min(axis=1).astype(float))


def _step(centroids: Centroids, dims: int, columns: list[str]):
    """Blocks with their vectors' new centroids and bounds, and the sums and counts of the block by centroid."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                n = one.column("n")[0].as_py()
                x = np.ascontiguousarray(unpacked(n, one.column("x")[0].as_py(), dims).T)
                state = [np.frombuffer(one.column(c)[0].as_py(), t) for c, t in (("of", "<i4"), ("upper", "<f8"), ("lower", "<f8"))] if "of" in columns else [None] * 3
                of, upper, lower, cost = centroids.assign(x, *state)
                sums = np.zeros((len(centroids.at), dims + 1), np.int64)
                np.add.at(sums, of, np.column_stack([x, np.ones(n, np.int64)]))
                new = {"of": [of.astype("<i4").tobytes()], "upper": [upper.astype("<f8").tobytes()], "lower": [lower.astype("<f8").tobytes()], "sums": [sums.tobytes()], "compared": [int(cost)]}
                yield as_batch({c: one.column(c) for c in ("n", "id", "x")} | new)

    return run


def _result(centroids: Centroids, dims: int):
    """The centroid of each vector and the exact squared distance."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                x = np.ascontiguousarray(unpacked(one.column("n")[0].as_py(), one.column("x")[0].as_py(), dims).T)
                state = [np.frombuffer(one.column(c)[0].as_py(), t) for c, t in (("of", "<i4"), ("upper", "<f8"), ("lower", "<f8"))] if "of" in batch.schema.names else [None] * 3
                of, *_ = centroids.assign(x, *state)
                gap = x - centroids.at[of]
                yield as_batch({"id": one.column("id").flatten(), "cluster": of.astype(np.int32), "distance": np.einsum("ij,ij->i", gap, gap)})

    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, dims: int = 64, clusters: int = 40, rounds: int = 5, scale: float = 256.0, seed: str = "2") -> DataFrame:
    """The nearest of a number of centroids for each vector: the id, cluster, distance (squared), cluster_inertia (its sum over
    the cluster), inertia (over all), centroid_sha256 (of the final centroid's components in decimal, joined by commas).

    Components count as floor(scale * x). Centroids start as the vectors with the smallest SHA-256 of `seed:id`, in that order;
    each round assigns all vectors and sets every non-empty centroid to its vectors' floor(sum / count). Vectors carry bounds from
    round to round (see Centroids.assign), in blocks that each round writes to the shared folder with the sums of the block; a
    treeReduce merges the sums, so that clusters x (dims + 1) numbers reach the driver. Centroids and their sorted lists,
    clusters^2 numbers, go to the tasks with the code.

    Only vectors of exactly dims components, none null or non-finite, come back. Repeated ids are rows of their own, as starting
    vectors in the order of their components; null ids start last. Fewer vectors than clusters give as many centroids. A
    vector as near to two centroids goes to the smaller number, so of equal centroids only the first has vectors; empty
    ones stay where they are. Components beyond the range in which squared distances fit a long are held to it; sums of
    distances beyond a long are null. Other columns are ignored. An empty table gives an empty result.
    """
    rows = whole_vectors(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", "id").where(F.size("x") == dims)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = first_vectors(rows, clusters, hashed.asc_nulls_last())
    kind = rows.schema["id"].dataType
    if not len(start):
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).limit(0)
    state = materialize(blocks(rows, ("id",), dims, scale), "vector-blocks")
    centroids = Centroids(floors(start, scale, dims))
    schema = StructType([*state.schema.fields, *[StructField(c, BinaryType()) for c in ("of", "upper", "lower", "sums")], StructField("compared", LongType())])
    for _ in range(rounds):
        before = state
        state = materialize(before.mapInArrow(_step(centroids, dims, before.columns), schema), "vector-round")
        discard(before)
        sums = state.select("sums").rdd.map(lambda r: np.frombuffer(r[0], np.int64).reshape(-1, dims + 1)).treeReduce(np.add)
        count = sums[:, -1:]
        now = np.where(count > 0, sums[:, :-1] // np.maximum(count, 1), centroids.at)
        centroids = Centroids(now, centroids.at)
    found = state.mapInArrow(_result(centroids, dims), StructType([StructField("id", kind), StructField("cluster", IntegerType()), StructField("distance", LongType())]))
    found = materialize(found, "clusters")
    discard(state)
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}  # a row for each cluster
    total = sum(inertia.values()) if None not in inertia.values() else None
    total = total if total is not None and total < 1 << 63 else None
    named = [(k, inertia[k], hashlib.sha256(",".join(map(str, centroids.at[k].tolist())).encode()).hexdigest()) for k in sorted(inertia)]
    named = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
