"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node near it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v").where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is its smallest node reachable.

    edges: two columns of one orderable type, undirected; loops, repeats and nulls are ignored. Alternates the
    large-star and small-star steps of Kiveris et al. (2014) until the stars stay as they are: O(log^2 n) rounds,
    each a min-aggregation, which combines before its shuffle, and an equi-join that AQE splits where it is skewed.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    now = materialize(now, f"{name}-0")
    before, k = _state(now), 0
    while before[0]:
        k += 1
        last, now = now, materialize(_small_star(_large_star(now)), f"{name}-{k}")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
