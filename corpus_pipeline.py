"""A training-data pipeline over documents: each stage writes Parquet that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm import langid, minhash, mixing, packing, secrets
from tidemark.llm.common import discard, materialize, scratch, table

#: SQL can express neither naive Bayes nor best-fit packing; tests compare every stage with a brute-force version.
ORACLE_SQL = None

#: A text whose likeliest language has less than this posterior probability is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _carried(docs: DataFrame, *own: str) -> DataFrame:
    """doc_id, the named columns, and all others in one struct `rest`, so that none clashes with what an operator adds."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", *own)]
    return docs.select("doc_id", *own, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("rest"))


def _restored(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns of documents in their order: doc_id and the named ones from df, all others out of `rest`."""
    return df.select(*[F.col(c) if c in ("doc_id", *own) else F.col("rest")[c].alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known (score at least LEAST_LANGUAGE_SCORE); others have no letter or are a
    toss-up between languages. The predicted language fills a null lang; a given one stays.

    A null text has no letter and goes; null and repeated ids are judged row by row; an empty table stays empty. Texts of any length
    are judged whole; languages that tie are a toss-up, so the text goes.
    """
    model = langid.train(docs.where(~langid.is_held_out("doc_id")))
    found = langid.identify(_carried(docs, "text", "lang"), model, keep=("text", "lang", "rest"))
    known = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    known = known.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "rest")
    return _restored(known, docs.columns, "text", "lang")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: that of the smallest id.

    Of rows that repeat an id, the one with the smallest text hash stays; rows with a null id all do. Texts without a word
    are copies of nothing. An empty table stays empty. Sets are of whole texts, however long; a tie between texts of one id and hash
    goes by the text, and equal rows are one.
    """
    found = minhash.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = _carried(docs, "text").join(found.hint("merge"), "doc_id")
    once = kept.where("n = 1")
    of_id = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    repeated = kept.where("n > 1").withColumn("rank", F.row_number().over(of_id)).where("rank = 1").drop("rank")
    return _restored(once.unionByName(repeated), docs.columns, "text").unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars follows.

    A null text stays null and an empty one empty; null and repeated ids are rows of their own; an empty table stays empty. Texts of
    any length are masked whole; spans that overlap or begin together are replaced by one mark.
    """
    found = secrets.find_secrets(_carried(docs, "text", "n_chars"), keep=("text", "n_chars", "rest"))
    found = found.withColumn("text", secrets.redact("text"))
    found = found.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _restored(found, docs.columns, "text", "n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a whole copy for each time, and a first part for what is left of it.

    Documents that the mix takes no word of go, and so do those without words. A null source is a source; null and repeated
    ids are rows of their own; an empty table stays empty. Texts of any length count whole. Rows that tie in the order in which
    the mix takes them go by their id, text and other columns, so the result is the same whatever the partitions; equal rows
    are interchangeable.
    """
    mixed = mixing.mix_sources(_carried(docs, "text", "source", "n_chars"), keep=("text", "source", "n_chars", "rest")).where("taken > 0")
    whole = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    cut = F.when(left < F.col("size"), F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, left), " ")).otherwise(F.col("text"))
    whole = whole.withColumn("text", cut)
    whole = whole.withColumn("n_chars", F.when(left < F.col("size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _restored(whole, docs.columns, "text", "source", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 2048 tokens (pack(with_ids=True) adds the ids).

    A null or empty text is its end token alone; null and repeated ids give pieces per row; an empty table gives none. Texts of any
    length are cut into pieces; pieces of equal length go in the order of a hash of their place.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each result written and read again before the next; then its input goes, and so do
    the stage's own tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if name != STAGES[0][0]:
            discard(before)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
