"""A training corpus from raw documents: toxicity, quality, lines, near-duplicates, packing.

Each stage gets what the one before it kept. All but the last return the columns of
``documents``, whatever their names, unchanged but for text and n_chars; the last
returns the packed pieces.

Defined results, in every stage: an empty table gives an empty one; repeated rows are
judged alike, and near-dedup keeps one of those that share a doc_id and text; a null
doc_id is scored like any other, but takes no part in line and near-dedup. Null and
empty texts are scored as texts without features; those that stay keep their text, and
are packed as empty documents. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_dedup, minhash_dedup, packing, quality, toxicity
from weftline.llm.common import free_name, read, written

#: Scores from which a document counts as toxic, and as of good quality.
TOXIC, GOOD = 0.5, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC."""
    score = free_name(docs, "score")
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), into=score)
    return scored.filter(F.col(score) < TOXIC).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least GOOD."""
    score = free_name(docs, "score")
    scored = quality.quality(docs, read(spark, sf_dir, "labels"), into=score)
    return scored.filter(F.col(score) >= GOOD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those of which nothing is left go."""
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    done = line_dedup.dedup_lines(docs, n_lines, n_removed)
    left = (F.col(n_removed) == 0) | F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return done.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return minhash_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", keep_one),
    ("packing", pack),
]

#: Learned scores and tokenizers are beyond SQL; run() and each stage are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
