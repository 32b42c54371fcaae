"""Document quality: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .langid import is_held_out

#: Names of the statistics, in the order of the columns of `statistics`.
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "spaces", "punctuation", "symbols", "non_ascii",
    "distinct_words", "distinct_pairs", "top_word", "lines", "line_length", "distinct_lines", "longest_line", "ends_in_stop", "words_with_symbol",
    "capital_words", "shouted_words", "one_letter_words", "long_words", "repeated_run", "alpha_words", "bullets", "stop_per_word", "longest_word", "number_words",
)
_CLASSES = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASSES[_c] = 5 if _c > 127 else 0 if "a" <= _s <= "z" else 1 if "A" <= _s <= "Z" else 2 if _s.isdigit() else 3 if _s.isspace() else 4 if _s in ".,;:!?'\"-()" else 6
_WORD_SYMBOL = re.compile(rb"[^A-Za-z0-9\x80-\xff.,;:!?'\"()-]")


def statistics(text: str) -> list[float]:
    """The document statistics of a whole text; all zero for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    words = raw.split()
    lines = [x for x in (y.strip() for y in raw.split(b"\n")) if x]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marks = len(_WORD_SYMBOL.findall(raw)) - raw.count(b" ") - raw.count(b"\n")
    line_lengths = [len(x) for x in lines] or [0]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), kinds[0] + kinds[1] + kinds[5], kinds[1], kinds[2], kinds[3], kinds[4], kinds[6], kinds[5],
        len(counts) / n, len(set(zip(words, words[1:], strict=False))) / n, max(counts.values(), default=0) / n, np.log1p(len(lines)), sum(line_lengths) / len(line_lengths),
        len(set(lines)) / max(1, len(lines)), max(line_lengths), sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)), marks / n,
        sum(w[:1].isupper() for w in words) / n, sum(w.isupper() for w in words) / n, float((lengths == 1).mean()), float((lengths > 12).mean()), repeated / n,
        sum(w.isalpha() for w in words) / n, sum(x[:1] in b"-*|#" for x in lines) / max(1, len(lines)), sum(w.endswith((b".", b"!", b"?")) for w in words) / n, lengths.max(),
        sum(w.isdigit() for w in words) / n,
    ]


@dataclass
class Trees:
    """A forest flattened into arrays (tree x node): inner node i has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x; all rows step down all trees together."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return 1 / (1 + np.exp(-(self.start + self.value[trees, node - (2**self.depth - 1)].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Gradient boosting of the logistic loss with histograms of at most `bins` quantile bins for each column.

    Every tree is grown level by level to `depth`: one bincount of gradients and hessians over (node, column, bin)
    and a running sum give the gain of every split at once. A node without a gainful split (or with less hessian
    than `least` on a side) passes all its rows to the left. One class only, or no rows, gives its smoothed share.
    """
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), start, depth)
    if not n or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            flat = ((node[:, None] * m + np.arange(m)) * bins + binned).ravel()
            g = np.bincount(flat, np.repeat(grad, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2)
            h = np.bincount(flat, np.repeat(hess, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2)
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (total_g - g) ** 2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
            gain[(h < least) | (total_h - h < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            column, cut = best // bins, best % bins
            for k in np.flatnonzero(good):
                out.feature[t, width - 1 + k] = column[k]
                out.threshold[t, width - 1 + k] = edges[column[k]][cut[k]] if cut[k] < len(edges[column[k]]) else np.inf
            node = 2 * node + (good[node] & (binned[np.arange(n), column[node]] > cut[node]))
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        out.value[t] = -rate * g / (h + l2)
        raw += out.value[t][node]
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [list(map(float, statistics(x.as_py() or ""))) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["id", "label", "x"])


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, rows: int = 20_000, **options) -> Trees:
    """Trees that tell label 1 from label 0, from at most `rows` labelled documents (the bound; drawn by a hash of the id).

    Labels other than 0 and 1 and null ids are left out; of several labels of one id, the smallest counts. Only
    the statistics of the bounded sample reach the driver: rows x 30 doubles. Of documents that repeat a labelled id, the
    one with the smallest statistics counts. Statistics are taken of whole texts, however long; labels that tie in the hash's
    order go by id. No labelled row gives trees that score every text alike.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    own = F.broadcast(own.orderBy(F.xxhash64("id"), "id").limit(rows))  # bounded by rows
    sample = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(own, "id").select("id", "text", "label")
    kind = dict(sample.dtypes)["id"]
    sample = sample.mapInArrow(_stats, f"id {kind}, label int, x array<double>").groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    got = sample.select("label", "x").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the same trees whatever order the rows come in
    return fit(x[order], y[order], **options)


def score(documents: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the probability of label 1 (`score`) of every whole text; a null text counts as empty.

    Null and repeated ids give a row each; other columns are ignored; an empty table gives an empty result. Texts of any length
    are read whole, one at a time; equal texts have equal scores.
    """
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            scores = []
            for k in range(0, batch.num_rows, 1024):
                scores.append(forest.score(np.array([statistics(x.as_py() or "") for x in batch.column(1)[k : k + 1024]], float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["id", "score"])

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """id_col, held_out, score, predicted (score >= threshold) for every document.

    The held-out fold (crc32 of the id as text leaves no remainder by folds) is never learnt from; without labels
    of both classes every score is the smoothed share of label 1. Very long and null texts, ties and repeated rows are as in train
    and score; a score of exactly the threshold is predicted 1.
    """
    trees = train(documents, labels.where(~is_held_out(id_col, folds)), id_col, text_col, **options)
    scored = score(documents, trees, id_col, text_col)
    return scored.select(id_col, is_held_out(id_col, folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
