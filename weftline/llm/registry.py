"""Queries of this package: one opN_ query an operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import embedding_dedup, language_id, line_dedup, media_chunks, minhash_dedup, packing, piece_codec, quality, token_files, toxicity
from weftline.llm.common import fold, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored for toxicity; predicted is 1 from a score of 0.5 on."""
    scored = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with begin and end ids, and decoded again."""
    return piece_codec.encode_column(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, its calibrated score, and whether it is rejected."""
    told = language_id.identify(read(spark, sf_dir, "documents"))
    return told.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written in Simple-8b files and read back."""
    return token_files.round_trip(read(spark, sf_dir, "documents"))


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as media in deduplicated content-defined chunks, read back."""
    return media_chunks.round_trip(read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more between all vectors."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that no earlier line repeats, exactly or nearly."""
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 4096 ids."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar by 80 per cent."""
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=2, similarity=80)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored for quality; predicted is 1 from a score of 0.3 on."""
    scored = quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_QUERIES = (
    op1_toxicity,
    op2_sentencepiece,
    op3_language_id,
    op4_token_files,
    op5_media_chunks,
    op6_embedding_dedup,
    op7_line_dedup,
    op8_packing,
    op9_minhash_dedup,
    op10_quality,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {}
