"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import covertree, exponion, hnsw, langid, minhash, mixing, packing, partcodes, pii, quality, secrets, sql, tokens, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by two-word shingles at a similarity of 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and which have over 2048."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.where(~langid.is_held_out("doc_id")))
    found = langid.identify(documents, model)
    return found.select("doc_id", langid.is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings of one label at a cosine of 0.93."""
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", *pii.span_digest())


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", *secrets.span_digest())


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of eight parts by codebooks of 16 entries."""
    return partcodes.compress(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings by the nearest of 40 centroids."""
    return exponion.cluster(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, normalised and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict:
    """Every query of this subpackage by name."""
    own = (op1_best_fit_packing, op2_quality_classifier, op3_minhash_near_dedup, op4_token_counts, op5_language_id, op6_source_mixing, op7_embedding_near_dedup, op8_pii, op9_exact_top_k, op10_secret_scan, op11_vector_codes, op12_centroid_clustering, op13_warc)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, where SQL can express the operator's rows."""
    own = {op3_minhash_near_dedup: sql.OP3, op7_embedding_near_dedup: sql.OP7, op9_exact_top_k: sql.OP9, op11_vector_codes: sql.OP11, op12_centroid_clustering: sql.OP12, op13_warc: sql.OP13}
    return {f.__name__: text for f, text in own.items()}
