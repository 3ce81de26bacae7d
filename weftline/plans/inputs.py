"""Views of the supplied tables that stand in for files, state, pairs, events and glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import segments as S
from weftline.operators.reconcile import CARRIED

# A glossary of words that the invented prose holds
TERMS = (("the", "T1"), ("und", "T2"), ("que", "T3"), ("License", "T4"), ("of the", "T5"), ("", "T6"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("path"), F.col("text").alias("source"), "lang")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.translatable_segments(S.line_blocks(files(spark, sf_dir)))


def state(rows: DataFrame) -> DataFrame:
    """State as an earlier run might have left it: some segments missing, some without translation, some in another context, some with an old snapshot."""
    from weftline.functions.hashing import context_hash

    key = F.col("path") * 31 + F.col("block_idx") * 7 + F.col("seg_idx")
    held = rows.withColumn("current", context_hash(F.col("source_hash"))).withColumn("k", key).filter("k % 7 <> 0")
    return held.select(
        "path",
        (F.col("block_idx") * 1000 + F.col("seg_idx")).cast("int").alias("pos"),
        "segment_id",
        "source_hash",
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("tr "), F.col("source"))).alias("translation"),
        F.when(F.col("k") % 11 == 0, F.lit(1).cast("bigint")).otherwise(F.col("current")).alias("context_hash"),
        F.create_map().cast("map<string,string>").alias("glossary_snapshot"),
        F.lit(None).cast("timestamp").alias("translated_at"),
        F.array().cast("array<string>").alias("issues"),
    ).select("path", "pos", "segment_id", "source_hash", *CARRIED)


def glossary(spark: SparkSession, terms=TERMS) -> DataFrame:
    return spark.createDataFrame([(t, v, None) for t, v in terms], "term string, translation string, note string")


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with addresses and role headers behind their html, which has none of its own."""
    page = F.col("page_id")
    more = (F.lit(" see https://a.example/p"), page.cast("string"), F.lit(". or (http://b.example/q-"), (page % 7).cast("string"), F.lit('), {name "k"}`v` {2}'))
    return table(spark, sf_dir, "pages").withColumn("linked", F.concat("html", *more))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with marks, which they have none of: literals, emphasis, and what opens a construct at a line's start."""
    text, kind = F.col("text"), F.pmod("turn", F.lit(5))
    put = F.when(kind == 0, F.concat(F.lit("`"), text, F.lit("` *b*"))).when(kind == 1, F.concat(F.lit("* "), text)).when(kind == 2, F.concat(F.lit("# "), text))
    put = put.when(kind == 3, F.concat(F.lit("  > "), text, F.lit(" `x` https://a.example/"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("| "), text))
    return table(spark, sf_dir, "conversations").withColumn("text", put)


def pairs(spark: SparkSession, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    """Neighbouring turns of conversations as (source, translation)."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations") if turns is None else turns
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = turns.select(F.col("conv_id").alias("path"), F.col("turn").alias("seq"), F.col("text").alias("source"), F.lead("text").over(w).alias("translation"))
    return out.withColumn("markup", F.element_at(F.array(*map(F.lit, ("markdown", "asciidoc", "rst", "verso"))), (F.pmod("path", F.lit(4)) + 1).cast("int")))


EVENT_TYPES = ("run_started", "file_discovered", "file_started", "block_queued", "block_started", "block_attempt", "block_translating", "block_translated", "block_failed", "file_completed", "file_failed")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a run's progress events."""
    raw = table(spark, sf_dir, "events")
    at = lambda n: F.pmod("event_id", F.lit(n))
    return raw.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.element_at(F.array(*map(F.lit, EVENT_TYPES)), (at(11) + 1).cast("int")).alias("type"),
        at(97).alias("id"),
        F.concat(F.lit("f"), at(13).cast("string")).alias("file"),
        at(5).alias("segments"),
        (at(3) + 1).cast("int").alias("attempt"),
        F.lit(None).cast("string").alias("error"),
        F.lit(4).alias("concurrency"),
        at(17).alias("pending"),
    )
