"""Best-fit packing of tokenized documents into fixed-length sequences, certified by lower bounds."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import IdTable
from .common import discard, held, materialize
from .shingles import mix

_LOG = logging.getLogger(__name__)
_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, place long"
_PACKED = "place long, length long, unit long, sequence_id long, offset long, full boolean"


def _table(path: str) -> IdTable:
    return held(f"ids {path}", lambda: IdTable(path))


def _portions(texts: pa.Array, rows: int = 1024, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of at most `rows` texts and `size` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield at, end - at
        at = end


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    closing = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = _table(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            out = {k: [] for k in ("at", "piece", "start", "length", "crc", "place", "ids")}
            for base, count in _portions(batch.column(1)):
                ids = table.encode(batch.column(1)[base : base + count])
                for i, raw in enumerate(ids):
                    raw += closing
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        out["at"].append(base + i)
                        out["piece"].append(piece)
                        out["start"].append(at // 4)
                        out["length"].append(len(part) // 4)
                        out["crc"].append(zlib.crc32(part))
                        out["place"].append(row)
                        row += 1
                        if with_ids:
                            out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(out["at"], pa.int64())), pa.array(out["piece"], pa.int32())]
            out["place"] = mix(np.array(out["place"], np.uint64)).view(np.int64)  # one to one: still unique
            columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "place")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """The least number of bins that any packing needs, by two families of dual-feasible functions.

    For a threshold t up to half the capacity: sizes over capacity - t count whole, sizes under t count nothing, the
    others their share (t = 0 is the plain volume bound). For a number k: floor((k + 1) x) / k of the share x,
    where (k + 1) x is whole x itself. times: how often each length occurs.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, times, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, volume = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    below = np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = int((large + -((below - volume[capacity - t]) // capacity)).max())
    for k in range(1, 21):
        scaled = (k + 1) * size
        share = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -int(-(share * count).sum() // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: longest first, each into the fullest bin that has room.

    Items of one length are alike, and so are bins with one gap, so whole runs of items are placed at once.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened, i = 0, 0
    while i < len(order):
        size = int(lengths[order[i]])
        j = i
        while j < len(order) and lengths[order[j]] == size:
            j += 1
        gap = size
        while i < j:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                b, room = opened, capacity
                opened += 1
            else:
                b, room = gaps[gap].pop(), gap
            bins[order[i]], offsets[order[i]] = b, capacity - room
            i += 1
            gaps[room - size].append(b)
            if room - size >= size:
                gap = room - size
    return bins, offsets, opened


def _table_bound(pieces: DataFrame, capacity: int) -> int:
    """The lower bound of a table of pieces, from how many there are of each length: a row for each up to the capacity."""
    sizes = np.array([tuple(r) for r in pieces.groupBy("length").count().collect()], np.int64).reshape(-1, 2)
    return lower_bound(sizes[:, 0], capacity, sizes[:, 1])


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """The sequences that a packing uses, and the number that no packing of its pieces can do with less than."""
    return packed.select("sequence_id").distinct().count(), _table_bound(packed, capacity)


def _pack(capacity: int, round_: int):
    """Best-fit decreasing over one group of pieces; keeps the bins that it was given unless fewer do."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "place"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        before = group["sequence_id"].nunique() if round_ else len(group) + 1
        if before > lower_bound(lengths, capacity):
            bins, offsets, n = best_fit_decreasing(lengths, capacity)
            if n < before:
                group["sequence_id"], group["offset"] = (int(key[0]) << 28 | round_ << 24) + bins, offsets
        group["full"] = group.groupby("sequence_id")["length"].transform("sum") == capacity
        return group[["place", "length", "unit", "sequence_id", "offset", "full"]]

    return run


def pack(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = 2048,
    tokenizer: str | None = None,
    end: int = 0,
    pieces_per_unit: int = 8192,
    most_units: int = 64,
    rounds: int = 8,
    with_ids: bool = False,
) -> DataFrame:
    """Packs all documents into as few sequences of at most `capacity` tokens as best-fit decreasing finds.

    A document is its text's ids, then `end`; longer ones are cut into pieces of `capacity`, the last may be
    shorter. Returns per piece: id_col, piece, start, length, ids_crc32 (unsigned little-endian 32-bit ids),
    sequence_id, offset (gapless from 0), and with with_ids=True also `ids`.

    Pieces are dealt by a hash to units of about pieces_per_unit pieces, so no id, source or text that is frequent
    makes a task large. Each unit is packed by itself. The table's lower bound (see lower_bound, from the number
    of pieces of each length) certifies the total; until it is met, while rounds still save bins (and for at most `rounds`
    rounds), the bins with gaps give their pieces back, groups of units (four, then sixteen, up to the pieces of
    most_units units, which bounds a task) exchange them and pack them anew unless their own lower bound certifies what
    they have, and the new bins replace the old ones where they are fewer. Full bins stay. The bins and the bound are logged;
    certificate() gives them for any result.

    A null text counts as empty (the end token alone). Null and repeated ids give pieces per row. Other columns are
    ignored. An empty table gives an empty result. Texts of any length are encoded whole. Pieces of equal length go in the order
    of a hash of their place. Pieces of one row may lie in different sequences.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _PIECES.format(id=dict(docs.dtypes)["doc_id"]) + ", ids array<int>" * with_ids
    pieces = materialize(docs.mapInArrow(_cut(path, capacity, end, with_ids), schema), "pieces")
    units = max(1, -(-pieces.count() // pieces_per_unit))
    items = pieces.select("place", "length", F.pmod("place", F.lit(units)).alias("unit"))
    items = items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "full": F.lit(False)})
    least = _table_bound(pieces, capacity)
    packed = materialize(items.groupBy("unit").applyInPandas(_pack(capacity, 0), _PACKED), "packed-0")
    bins = packed.select("sequence_id").distinct().count()
    for k in range(1, rounds + 1):
        if units == 1 or bins == least:
            break
        groups = max(-(-units // 4**k), -(-units // most_units))
        # pieces of one bin stay together, so a bin that isn't bettered can stay
        again = packed.where("not full").withColumn("unit", F.pmod(F.xxhash64("sequence_id", F.lit(k)), F.lit(groups)))
        again = again.groupBy("unit").applyInPandas(_pack(capacity, k), _PACKED)
        last, packed = packed, materialize(packed.where("full").unionByName(again), f"packed-{k}")
        discard(last)
        before, bins = bins, packed.select("sequence_id").distinct().count()
        if bins == before and groups == -(-units // most_units):
            break
    _LOG.info("%d sequences of %d tokens; none can do with fewer than %d", bins, capacity, least)
    out = pieces.join(packed.select("place", "sequence_id", "offset"), "place")
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return out.select(F.col("doc_id").alias(id_col), *columns)
