"""Progress events of runs, folded in batch or as a stream.

Events: run_id, seq (order of arrival), type, and where they apply id, file, segments,
attempt, error, concurrency, pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

EVENT = S.StructType(
    [
        S.StructField("run_id", S.StringType()),
        S.StructField("seq", S.LongType()),
        S.StructField("type", S.StringType()),
        S.StructField("id", S.LongType()),
        S.StructField("file", S.StringType()),
        S.StructField("segments", S.LongType()),
        S.StructField("attempt", S.IntegerType()),
        S.StructField("error", S.StringType()),
        S.StructField("concurrency", S.IntegerType()),
        S.StructField("pending", S.LongType()),
    ]
)


def event_source(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """Events from JSON files of folder, as they arrive or as they lie there."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).json(folder)


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


def _totals() -> list[Column]:
    some = lambda t, c: F.coalesce(F.sum(F.when(_is(t), F.col(c))), F.lit(0))
    return [
        F.max(F.when(_is("run_started"), F.col("concurrency"))).alias("concurrency"),
        F.count_if(_is("file_discovered")).alias("files_total"),
        some("file_discovered", "pending").alias("segments_total"),
        F.count_if(_is("file_completed", "file_failed")).alias("files_done"),
        some("block_translated", "segments").alias("segments_done"),
        F.count_if(_is("block_attempt") & (F.col("attempt") > 1)).alias("retried"),
        F.count_if(_is("block_failed", "file_failed")).alias("errors"),
        F.count_if(_is("finished")).alias("finished"),
        F.count_if(_is("block_queued")).alias("_queued"),
        F.count_if(_is("block_started")).alias("_started"),
        F.count_if(_is("block_translated", "block_failed")).alias("_ended"),
    ]


def _shape(folded: DataFrame) -> DataFrame:
    """Blocks waiting and active, none of either once the run has finished."""
    running = F.col("finished") == 0
    waiting = F.greatest(F.col("_queued") - F.col("_started"), F.lit(0))
    active = F.greatest(F.col("_started") - F.col("_ended"), F.lit(0))
    out = folded.withColumns({"queued": F.when(running, waiting).otherwise(0), "active": F.when(running, active).otherwise(0)})
    return out.withColumn("idle", F.greatest(F.coalesce("concurrency", F.lit(0)) - F.col("active"), F.lit(0))).drop("_queued", "_started", "_ended")


def job_totals(events: DataFrame) -> DataFrame:
    """A row a run: the totals of its job. The same plan serves a stream in complete mode."""
    return _shape(events.groupBy("run_id").agg(*_totals()))


def active_blocks(events: DataFrame) -> DataFrame:
    """Blocks under way, the newest first in each run: run_id, id, file, segments, attempt, phase."""
    ended = events.filter(_is("finished")).select("run_id").distinct()
    by = events.filter(F.col("id").isNotNull()).groupBy("run_id", "id").agg(
        F.max(F.when(_is("block_started"), F.col("seq"))).alias("started"),
        F.max(F.when(_is("block_started"), F.col("file"))).alias("file"),
        F.max(F.when(_is("block_started"), F.col("segments"))).alias("segments"),
        F.greatest(F.max(F.when(_is("block_attempt"), F.col("attempt"))), F.lit(1)).alias("attempt"),
        F.max_by("type", F.when(_is("block_started", "block_attempt", "block_translating"), F.col("seq"))).alias("last"),
        F.count_if(_is("block_translated", "block_failed")).alias("over"),
    )
    phase = F.when(F.col("last") == "block_translating", "evaluating").otherwise("translating")
    out = by.filter("started is not null and over = 0").join(ended, "run_id", "left_anti")
    return out.select("run_id", "id", "file", "segments", "attempt", phase.alias("phase"), F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("started"))).alias("place"))


def file_fold(events: DataFrame) -> DataFrame:
    """A row a file: its state (waiting, translating, done, error), and segments done, at most its total."""
    state = F.when(_is("file_discovered"), "waiting").when(_is("file_started", "block_started", "block_translated"), "translating").when(_is("file_completed"), "done").when(_is("file_failed"), "error")
    named = events.filter(F.col("file").isNotNull() & state.isNotNull())
    out = named.groupBy("run_id", "file").agg(
        F.max_by(state, "seq").alias("state"), F.coalesce(F.max("pending"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(_is("block_translated"), F.col("segments"))), F.lit(0)).alias("done")
    )
    return out.withColumn("done", F.least("done", "total"))


def feed_limit(events: DataFrame, most: int = 150) -> DataFrame:
    """The newest events."""
    return events.orderBy(F.desc("seq")).limit(most)


def stream_totals(events: DataFrame, name: str, checkpoint: str):
    """Starts the fold over a stream into the memory table ``name``; runs until what has arrived is folded."""
    return job_totals(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_save(updates: DataFrame, folder: str, checkpoint: str):
    """Appends a stream of translated segments to a Parquet store, batch by batch; a batch that is run again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number:09d}")

    return updates.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(store: DataFrame) -> DataFrame:
    """The newest translation of each segment in an incrementally saved store."""
    return store.groupBy("path", "seq").agg(F.max_by("translation", "batch").alias("translation"))
