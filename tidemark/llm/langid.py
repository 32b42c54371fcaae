"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import release

UNKNOWN = "und"


def is_held_out(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text leaves no remainder by folds; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


@cache
def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(s := chr(c))[0] == "L":
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all texts one after another, and the number of the text that each belongs to.

    A run of other characters than letters is one space.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = _fold()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), lengths)
    kept = codes != 32
    if len(codes):
        kept[0] = True
        kept[1:] |= (codes[:-1] != 32) | (doc[1:] != doc[:-1])
    return codes[kept].astype(np.uint64), doc[kept]


def _grams(codes: np.ndarray, doc: np.ndarray, starts: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that begin at one of the first `starts` places, and the texts that they belong to."""
    letter, h = codes != 32, codes
    ids, owner = [], []
    for n in range(1, longest + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        m = min(starts, len(h))
        same = doc[:m] == doc[n - 1 : n - 1 + m]
        for inside in range(1, n - 1):  # no space but at either end
            same &= letter[inside : inside + m]
        if n == 1:
            same = same & letter[:m]
        mixed = (h[:m][same] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        ids.append((mixed >> np.uint64(32)).astype(np.int64) % buckets)
        owner.append(doc[:m][same])
    return np.concatenate(ids), np.concatenate(owner)


def grams(texts: list[str], longest: int, buckets: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of lower-case letters up to `longest`, and the numbers of the texts they belong to, ascending.

    A run of other characters is one space, so n-grams see where words begin and end but not across them. Texts come in
    portions of at most `most` characters, a longer one in several portions, each n-gram in that where it begins.
    """
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        if size <= most:
            codes, doc = _codes(texts[at:end])
            ids, owner = _grams(codes, doc, len(codes), longest, buckets)
            order = np.argsort(owner, kind="stable")
            yield ids[order], owner[order] + at
        else:
            held = np.empty(0, np.uint64)
            for k in range(0, size, most):
                codes, _ = _codes([texts[at][k : k + most]])
                if len(held) and len(codes) and held[-1] == codes[0] == 32:
                    codes = codes[1:]
                codes = np.concatenate([held, codes])
                starts = len(codes) if k + most >= size else max(0, len(codes) - longest + 1)
                ids, owner = _grams(codes, np.zeros(len(codes), np.int64), starts, longest, buckets)
                yield ids, owner + at
                held = codes[starts:]
        at = end


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 3, buckets: int = 1 << 15, most: int = 1000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the matrix of log probabilities (language x bucket), add-one smoothed.

    Learns from every row with a non-null lang; a null text counts as empty, repeated rows count again, and an empty table
    gives no language. Texts of any length are read whole, in portions (see grams). Each task adds up its rows' n-grams by language, so what is
    shuffled is at most languages x buckets counts for each task, whatever the table. What reaches the driver, and the model, have
    at most `most` languages x buckets numbers; more languages are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                texts = [batch.column(0)[int(i)].as_py() or "" for i in np.flatnonzero(langs == lang)]
                total = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                total[buckets] += len(texts)
                for ids, _ in grams(texts, longest, buckets):
                    total[:buckets] += np.bincount(ids, minlength=buckets)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    counts = documents.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = counts.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.limit(most * (buckets + 1) + 1).toPandas()
    if counts["lang"].nunique() > most or len(counts) > most * (buckets + 1):
        raise ValueError(f"more than {most} languages")
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), buckets + 1))
    table[np.searchsorted(langs, counts["lang"]) if langs else [], counts["bucket"]] = counts["n"]
    docs, table = table[:, buckets], table[:, :buckets] + 1.0
    return langs, np.log((docs + 1) / (docs.sum() + len(langs))), np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def identify(documents: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", *, longest: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, lang_pred and score (posterior probability) of every whole text, and the `keep` columns as they are.

    The model is broadcast: languages x buckets floats. A text that is null or has no letter is `und` with score 0, as
    are all texts if the model has no language; equal scores go to the first language by name. Null and repeated ids
    give a row each. Texts of any length are read whole, in portions. An empty table gives an empty result.
    """
    langs, prior, logp = model
    buckets = logp.shape[1]
    shared = documents.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = shared.value
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            total, known = np.tile(prior, (len(texts), 1)).astype(float), np.zeros(len(texts), bool)
            for ids, owner in grams(texts, longest, buckets):
                own, first = np.unique(owner, return_index=True)
                known[own] = True  # a letter is an n-gram of its own
                if langs and len(own):
                    total[own] += np.add.reduceat(table[ids], first, axis=0, dtype=np.float64)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if langs and len(texts):
                best = total.argmax(axis=1)
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names = [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                scores = np.where(known, sure, 0.0)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *rest], fields)

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    fields = ["id", "lang_pred", "score", *[f"keep_{c}" for c in keep]]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds.get(c, {'lang_pred': 'string', 'score': 'double'}.get(c))}" for c in fields)
    out = docs.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", *[F.col(f"keep_{c}").alias(c) for c in keep])
