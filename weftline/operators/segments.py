"""Blocks to hashed sentence segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.hashing import NATIVE, Store

# Block types that are never translated.
OPAQUE = ("code_block", "thematic_break", "html_block")


def line_blocks(files: DataFrame) -> DataFrame:
    """Each line of files(path, source) that is not blank as a paragraph block; the plainest parser."""
    lines = files.select("path", F.posexplode(F.split("source", "\n")).alias("block_idx", "raw_content"))
    lines = lines.filter(T.trim(F.col("raw_content")) != "")
    return lines.select("path", F.lit(0).alias("section_idx"), "block_idx", F.lit("paragraph").alias("block_type"), "raw_content", F.lit(True).alias("translatable"))


def all_segments(blocks: DataFrame, store: Store = NATIVE) -> DataFrame:
    """Every block's sentences: path, section_idx, block_idx, seg_idx, segment_id, source, source_hash, block_type, translatable."""
    cut = blocks.select("path", "section_idx", "block_idx", "block_type", "translatable", F.posexplode(T.split_sentences(F.col("raw_content"))).alias("seg_idx", "source"))
    return cut.select(
        "path",
        "section_idx",
        "block_idx",
        "seg_idx",
        T.segment_id(F.col("section_idx"), F.col("block_idx"), F.col("seg_idx")).alias("segment_id"),
        "source",
        store.content(F.col("source")).alias("source_hash"),
        "block_type",
        "translatable",
        # document order as one number: comparable within a file
        (F.col("section_idx").cast("long") * 1_000_000_000_000 + F.col("block_idx").cast("long") * 1_000_000 + F.col("seg_idx")).alias("seq"),
    )


def translatable_segments(blocks: DataFrame, store: Store = NATIVE) -> DataFrame:
    """Segments of blocks whose flag is set; the block's type does not matter here."""
    return all_segments(blocks.filter("translatable"), store).drop("translatable")


def type_translatable(block_type) -> F.Column:
    return ~block_type.isin(*OPAQUE)


def section_split(blocks: DataFrame, order: str = "block_idx") -> DataFrame:
    """section_idx anew: a heading of level 2 or less opens a section unless the current one is still empty."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy(order)
    opens = (F.coalesce(F.col("heading_level") <= 2, F.lit(False)) & (F.row_number().over(w) > 1)).cast("int")
    return blocks.withColumn("_opens", opens).withColumn("section_idx", F.sum("_opens").over(w)).drop("_opens")
