"""Exact token counts of whole texts and of their prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .bpe import PrefixCounts
from .common import held


def _table(path: str) -> PrefixCounts:
    return held(f"prefixes {path}", lambda: PrefixCounts(path))


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, limit: int = 2048, prefixes: bool = False) -> DataFrame:
    """Tokens of every whole text: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts come from dynamic programming over prefixes (see PrefixCounts), without begin or end tokens; special
    tokens' strings in a text count as one token each. With prefixes=True there is also `prefix_tokens`
    array<long>: tokens up to and with each white-space-separated chunk of the normalised text, ascending, from
    which a budget or a truncation is answered without encoding again.

    A null text counts as empty (0 bytes, 0 tokens, an empty array). Null and repeated ids give a row each. Other
    columns are ignored. Texts and words of any length are counted whole, in memory in proportion to their length. An
    empty table gives an empty result. tokenizer: path of a word BPE file on the executors; by default word_bpe_49k.json.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            sizes, counts, ends = [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                sizes.append(len(text.encode()))
                if prefixes:
                    ends.append(table.cumulative(text)[0])
                    counts.append(int(ends[-1][-1]) if len(ends[-1]) else 0)
                else:
                    counts.append(table.count(text))
            out = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(np.array(counts, np.int64) > limit)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ends, pa.list_(pa.int64()))] * prefixes, names)

    names = ["id", "n_bytes", "n_tokens", "over_limit"] + ["prefix_tokens"] * prefixes
    kind = dict(documents.select(id_col).dtypes)[id_col]
    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", prefix_tokens array<long>" * prefixes
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def truncate(documents: DataFrame, budget: int, text_col: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """documents with a column `truncated`: the longest run of whole chunks from the start of the normalised text
    that has at most `budget` tokens, continued inside the next chunk while it still fits.

    The cut is found in the prefix counts; nothing is encoded. Texts and words of any length take memory in proportion to
    their length. An empty table gives an empty result. A null text stays null, an empty one empty, and a
    budget below 1 gives empty texts. A column named `truncated` in documents is replaced.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    @F.pandas_udf("string")
    def cut(texts):
        table = _table(path)

        def one(text):
            if text is None:
                return None
            ends, chunks = table.cumulative(text)
            k = int(np.searchsorted(ends, budget, "right"))
            kept, left = chunks[:k], budget - (int(ends[k - 1]) if k else 0)
            if k < len(chunks) and left > 0 and chunks[k] not in table.chunker.special:
                fit = table.fitting(chunks[k], left)
                kept = [*kept, chunks[k][:fit]] if fit else kept
            return " ".join(kept)

        return texts.map(one, na_action=None)

    return documents.withColumn("truncated", cut(F.col(text_col).cast("string")))
