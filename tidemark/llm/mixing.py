"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize

#: Runs of other characters than white space.
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def sainte_lague(claims: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients claim / (2 * own seats + 1), ties to the earlier claim.

    The divisor whose rounded shares come nearest below the number of seats is found by bisection. Of the seats left, as
    many as have quotients above any that a claim could have next go at once, by one sort: the same result as handing
    out all seats one by one.
    """
    given = np.zeros(len(claims), np.int64)
    if not seats or not len(claims) or claims.max() <= 0:
        return given
    low, high = 0.0, 2.0 * seats / claims.sum() + 1.0 / claims.max()  # seats per unit of claim
    for _ in range(200):
        mid = (low + high) / 2
        some = np.floor(claims * mid + 0.5).astype(np.int64)
        if some.sum() <= seats:
            low, given = mid, some
        else:
            high = mid
    while left := int(seats - given.sum()):
        quotient = claims / (2 * given + 1)
        sure = int((quotient > (claims / (2 * given + 3)).max()).sum())
        given[np.argsort(-quotient, kind="stable")[: min(left, max(1, sure))]] += 1
    return given


def _quotas(claim: str, seats: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(group.columns[:2]), na_position="last", kind="stable")
        group["quota"] = sainte_lague(group[claim].to_numpy(float), int(group[seats].iloc[0]))
        return group

    return run


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: share of all words by weight, no target above `most` times its source's size.

    Sources are sorted by code point, null last; weights repeat in that order. A source at its most gives its excess
    to the others by weight until none is above: the targets are min(most * size, level * weight) for the one level
    at which they add up, found by a running sum over the sources in the order in which they reach their most.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    # the first source that stays under its most, in that order, sets the level
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least(F.col("most"), level * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 16,
    docs_per_shard: int = 2_000,
    seed: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document the mix takes: id_col, size, source_size, target, taken, and the `keep` columns.

    Sizes are words. The mix is share * all words, cut into blocks of `block` words. Sainte-Lague gives each
    source its number of blocks by its target (see source_targets), and each of the source's shards (documents
    dealt by a hash, about docs_per_shard each, so a large source is many shards) its number by the shard's words.
    In a shard, the documents lie one after another in an order drawn by `seed` (ties: by id, then two hashes of the text and
    one of the kept columns); the shard's blocks are selected
    along that line, once more from its start when it ends. taken is what those blocks hold of a document; it never
    exceeds most (at most 2) times its size, all but one document of a shard are taken a whole number of times,
    and each source's sum comes within a few blocks for each shard of its target.

    The same rows and seed give the same result, whatever the partitions. A null or blank text has size 0 and
    takes nothing; a null source is a source; null and repeated ids are rows of their own. If no text has a word, all
    targets are 0. Other columns are ignored. A text of any length counts whole. An empty table gives an empty result.

    Sources are numbered, and their blocks apportioned, in one task, a row for each source; so are the shards of one
    source, a row for each docs_per_shard documents: 50,000 rows for a source of 100 million documents.
    """
    others = [F.col(c) for c in keep if c not in (id_col, text_col, source_col)]
    tie = [F.xxhash64(text_col).alias("tie1"), F.xxhash64(F.lit(1), text_col).alias("tie2"), (F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)).alias("tie3")]
    docs = documents.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), *[F.col(c).alias(f"keep_{c}") for c in keep], *tie)
    docs = materialize(docs, "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sources, weights, share, most).join(sources.select(F.col("source").alias("s"), "n_docs"), F.expr("source <=> s")).drop("s")
    total = F.coalesce(F.sum("source_size").over(W.partitionBy()), F.lit(0))
    targets = targets.withColumn("seats", F.round(total * F.lit(float(share)) / F.lit(block)).cast("long"))
    schema = "source string, source_size long, target double, n_docs long, seats long, quota long"
    targets = materialize(targets.groupBy("seats").applyInPandas(_quotas("target", "seats"), schema), "targets")
    targets = targets.withColumn("shards", F.ceil(F.col("n_docs") / docs_per_shard).cast("long"))

    drawn = F.xxhash64("id", "size", F.lit(seed))
    placed = docs.join(targets.withColumnRenamed("source", "s"), F.expr("source <=> s")).withColumn("shard", F.pmod(F.xxhash64(drawn, F.lit(1)), "shards"))
    # never null, so that the join by it and the window after it need one shuffle
    placed = placed.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    shards = placed.groupBy("of", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("seats"))
    schema = "of string, shard long, shard_size long, seats long, quota long"
    shards = shards.groupBy("of").applyInPandas(_quotas("shard_size", "seats"), schema).select("of", "shard", "shard_size", F.col("quota").alias("blocks"))
    placed = placed.drop("s", "quota").join(shards, ["of", "shard"])
    line = W.partitionBy("of", "shard").orderBy(drawn, "id", "tie1", "tie2", "tie3").rowsBetween(W.unboundedPreceding, 0)
    words = F.least(F.col("blocks") * F.lit(block), (F.col("shard_size") * F.lit(float(most))).cast("long"))
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0))
    placed = placed.withColumns({"end": F.sum("size").over(line), "rounds": rounds}).withColumn("rest", words - F.col("rounds") * F.col("shard_size"))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("end") - F.col("size"))))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"keep_{c}").alias(c) for c in keep])
