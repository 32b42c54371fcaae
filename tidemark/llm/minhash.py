"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, materialize, release
from .graph import components
from .shingles import WordHashes, mix, shingle_set

_BASE = "id long, n long, set_key binary, sig array<int>, sk1 long, sk2 long"
#: Positions of the sketch: two bits of each fill two longs.
_SKETCH = 64


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:k] | np.uint64(1))[:, None], x[k:][:, None]


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 32-bit MinHash value at each position."""
    least = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 4096):
        np.minimum(least, ((s[None, i : i + 4096] * a) ^ b).min(axis=1), out=least)
    return mix(least).astype(np.uint32).view(np.int32)


def _sketch(width: int, positions: int):
    a, b = _multipliers(positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words = WordHashes()
        shift = np.arange(0, 64, 2, dtype=np.uint64)
        for batch in batches:
            ns, keys, sigs, sk = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                s = shingle_set(raw.as_py() or b"", width, words)
                ns.append(len(s))
                if not len(s):
                    keys.append(None), sigs.append(None), sk.append((None, None))
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = _signature(s, a, b)
                sigs.append(sig)
                two = np.resize(sig, _SKETCH).astype(np.uint64) & np.uint64(3)
                sk.append(tuple(int(x) for x in (two.reshape(2, 32) << shift).sum(axis=1, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array([x for x, _ in sk], pa.int64()), pa.array([y for _, y in sk], pa.int64())],
                ["id", "n", "set_key", "sig", "sk1", "sk2"],
            )
        words.clear()
        release()

    return run


def _keys(chunk: int, errors: int):
    """One key for each chunk and each choice of the positions in which it may err: equal keys agree in all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sig = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(batch.num_rows, -1)
            k = 0
            for c in range(0, sig.shape[1], chunk):
                width = min(chunk, sig.shape[1] - c)
                for kept in combinations(range(c, c + width), max(1, width - errors)):
                    k += 1
                    h = np.full(batch.num_rows, k, np.uint64)
                    for p in kept:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, p])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids], ["key", "id"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(raw.as_py() or b"", width, words).view(np.int64) for raw in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])
        words.clear()
        release()

    return run


def _distance(x: str, y: str) -> Column:
    """Positions of the two-bit sketches in which x and y differ."""
    parts = []
    for c in ("sk1", "sk2"):
        d = F.expr(f"{x}.{c} ^ {y}.{c}")
        parts.append(F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1))).bitwiseAND(F.lit(0x5555555555555555))))
    return parts[0] + parts[1]


def _alike(x: str, y: str, percent: int, sketch_limit: int) -> Column:
    """The sketches are within the limit, and the sizes allow the similarity."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (_distance(x, y) <= sketch_limit) & (small * 100 >= large * percent)


def _similar(x: str, y: str, percent: int) -> Column:
    """The sets have at least that Jaccard similarity."""
    common = F.size(F.array_intersect(x, y))
    return common * 100 >= (F.size(x) + F.size(y) - common) * percent


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 5,
    similarity: float = 0.8,
    chunks: int = 11,
    chunk: int = 6,
    errors: int = 1,
    sketch_limit: int = 24,
    group_rows: int = 1024,
    copy_parts: int = 64,
) -> DataFrame:
    """Groups of documents whose sets of `width`-word shingles have a Jaccard similarity of at least `similarity`.

    Returns one row per row of documents: id_col, n_shingles, component_id (smallest id reachable by links),
    kept (id = component_id).

    Signatures have chunks * chunk MinHash positions. Each chunk gives one key for every choice of `errors`
    positions left out, so every pair that differs in at most chunks * (errors + 1) - 1 positions shares a key;
    two texts of similarity 0.8 differ in 13 of the 66 positions on average and fail to share a key with a chance
    of 8e-6; the sketch rules out a further 2.4e-6 of such pairs. Both chances fall fast as the similarity rises. Texts with the same set are one class before keys are made. Buckets (documents of one key) are gathered by
    their hub, the member that meets the most others: first every member of such a group is compared with its hub; after
    that only groups whose members are still in several components compare members of different components,
    inside the join, so groups of copies are never expanded into all their pairs. Candidates whose sizes or whose
    64-position two-bit sketches (limit 24, five standard deviations above the mean at 0.8) rule the similarity
    out are left; the rest are confirmed on their full sets of 64-bit shingle hashes. Groups of over group_rows members are
    split: each part of a group meets a copy of the whole, so no task compares all of a large group. Copies of one set are
    joined in copy_parts parts.

    Null, empty and blank texts have no shingles and link with nothing. Rows that repeat an id are one vertex
    of the graph: what any of them links to, all do. Rows with a null id link with nothing, have a null
    component_id and are kept. Other columns are ignored. Texts of any length are read whole. An empty table gives an empty
    result.
    """
    percent = round(similarity * 100)  # joins have merge hints where both sides grow with the table
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = materialize(docs.mapInArrow(_sketch(width, chunks * chunk), _BASE), "minhash-base")
    # rows of one set meet its smallest id by parts; each set has a row for every part that it fills, so one text's copies spread
    parted = base.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(copy_parts)).cast("int"))
    sized = parted.where("id is not null and n > 0")
    reps = sized.groupBy("set_key").agg(F.min("id").alias("rep"), F.collect_set("part").alias("held"))
    reps = materialize(reps, "minhash-reps")
    by_part = reps.select("set_key", "rep", F.explode("held").alias("part"))
    own = sized.join(by_part, ["set_key", "part"]).select("id", "rep")
    classes = sized.join(reps.select("set_key", F.col("rep").alias("id")), ["set_key", "id"]).dropDuplicates(["set_key", "id"])
    classes = materialize(classes.select("id", "n", "sig", "sk1", "sk2"), "minhash-classes")
    small = classes.select("id", "n", "sk1", "sk2")
    keys = classes.select("id", "sig").mapInArrow(_keys(chunk, errors), "key long, id long")

    buckets = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("id").alias("lo"),
        F.max("id").alias("hi"),
        F.bit_xor(F.xxhash64("id")).alias("x1"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2"),
    )
    # buckets of the same documents count once
    buckets = buckets.where("members > 1 and lo <> hi").groupBy("members", "lo", "hi", "x1", "x2").agg(F.min("key").alias("key"))
    buckets = materialize(buckets, "minhash-buckets")
    large = buckets.where("members > 2").select("key", "members")
    members = materialize(keys.join(large.hint("merge"), "key"), "minhash-members")
    # a copied text shares more keys with its copies than they share with each other: each bucket's star is
    # around its member that meets the most others over all buckets
    met = members.groupBy("id").agg(F.sum("members").alias("met"))
    hubs = members.join(met.hint("merge"), "id").groupBy("key").agg(F.max(F.struct("met", "id"))["id"].alias("hub"))
    groups = members.join(hubs.hint("merge"), "key").select("hub", "id").distinct().join(small.hint("merge"), "id")
    groups = materialize(groups, "minhash-groups")
    pairs = groups.where("id <> hub").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b"))
    pairs = pairs.union(buckets.where("members = 2").select(F.col("hi").alias("a"), F.col("lo").alias("b"))).distinct()
    x, y = (small.alias(k).hint("merge") for k in "xy")
    first = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    first = materialize(first.where(_alike("x", "y", percent, sketch_limit)).select("a", "b"), "minhash-pairs")
    # a large group meets what is known of its hub by the same parts
    in_part = lambda df: df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(copy_parts)).cast("int"))
    held = F.collect_set("part").alias("held")
    parts = in_part(groups).groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("parts"), held).where("parts > 1")
    parts = parts.select("hub", "parts", F.explode("held").alias("part"))
    split = in_part(groups).join(parts, ["hub", "part"], "left").drop("part").withColumn("parts", F.coalesce("parts", F.lit(1)))
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    copied = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = salted(split).alias("x"), copied(split).alias("y").hint("merge")
    near = x.join(y, F.expr("x.hub = y.hub and x.salt = y.salt and x.id <> y.id") & _alike("x", "y", percent, sketch_limit), "left_semi")
    near = materialize(near, "minhash-near")
    ids = first.select(F.col("a").alias("id")).union(first.select(F.col("b").alias("id"))).union(near.select("id")).distinct()
    sets = docs.join(ids.hint("merge"), "id").select("id", "text").mapInArrow(_sets(width), "id long, hashes array<long>")
    sets = materialize(sets.distinct(), "minhash-sets")

    x, y = (sets.alias(k).hint("merge") for k in "xy")
    links = first.join(x, F.col("a") == F.col("x.id")).select("a", "b", F.col("hashes").alias("ha")).join(y, F.col("b") == F.col("y.id"))
    links = materialize(links.where(_similar("ha", "hashes", percent)).select("a", "b").distinct(), "minhash-links")
    joined = own.where("id <> rep").select("id", "rep").distinct()
    many = own.groupBy("id").agg(F.min("rep").alias("l"), F.max("rep").alias("h")).where("l <> h").select("id")  # ids with several texts
    links = links.union(joined.join(many, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    found = components(links, "minhash-c1")

    placed = near.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = in_part(placed)
    mixed = placed.groupBy("hub").agg(F.min("component").alias("l"), F.max("component").alias("h"), held).where("l <> h")
    mixed = mixed.select("hub", F.explode("held").alias("part"))
    placed = placed.join(mixed.hint("merge"), ["hub", "part"]).drop("part").join(sets.hint("merge"), "id")
    x, y = salted(placed).alias("x"), copied(placed.drop("salt")).alias("y").hint("merge")
    rest = F.expr("x.hub = y.hub and x.salt = y.salt and x.id > y.id and x.component <> y.component") & _alike("x", "y", percent, sketch_limit)
    more = x.join(y, rest & _similar("x.hashes", "y.hashes", percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    more = materialize(more, "minhash-more")
    if not more.isEmpty():
        found = components(links.union(more), "minhash-c2")
    discard(classes, buckets, members, groups, first, near, sets, more)

    of_class = reps.join(found, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("set_key", F.coalesce("component", "rep").alias("component"), F.explode("held").alias("part"))
    out = parted.select("id", "n", "set_key", "part").join(of_class, ["set_key", "part"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
