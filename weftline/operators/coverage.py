"""Which lines that carry words a parse offers for translation, and the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

LEAST_LINES, TOP_GAPS, PREVIEW = 5, 5, 60


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text, start, stop) of files(path, source): lines from 1 and the byte ranges they hold with their line feeds; stop is null for the last. A final line feed opens no line."""
    parts = F.split("source", "\n")
    parts = F.when(F.col("source").endswith("\n") | (F.col("source") == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    sized = files.select("path", F.size(parts).alias("n"), F.posexplode(parts).alias("i", "text"))
    bytes_ = F.octet_length("text") + 1
    stop = F.sum(bytes_).over(Window.partitionBy("path").orderBy("i"))
    return sized.select("path", (F.col("i") + 1).alias("line"), F.regexp_replace("text", r"\r+$", "").alias("text"), (stop - bytes_).alias("start"), F.when(F.col("i") + 1 < F.col("n"), stop).alias("stop"))


def span_lines(lines_: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line) that spans(path, span_start, span_end) touch, up to the line on which the end lies; an empty span touches its line."""
    touches = (F.col("start") <= F.greatest("span_start", "span_end")) & (F.col("stop").isNull() | (F.col("stop") > F.col("span_start")))
    return lines_.select("path", "line", "start", "stop").join(spans.select("path", "span_start", "span_end"), "path").filter(touches).select("path", "line").distinct()


def flagged(lines_: DataFrame, offered: DataFrame) -> DataFrame:
    """lines with has_word and offered."""
    mark = offered.select("path", "line").distinct().withColumn("_on", F.lit(True))
    return lines_.join(mark, ["path", "line"], "left").select("path", "line", "text", T.has_word(F.col("text")).alias("has_word"), F.coalesce("_on", F.lit(False)).alias("offered"))


def coverage(lines_: DataFrame) -> DataFrame:
    """Per file of flagged lines: word_lines, offered_lines, ratio (1 where no line has words)."""
    out = lines_.groupBy("path").agg(F.count_if("has_word").alias("word_lines"), F.count_if(F.col("has_word") & F.col("offered")).alias("offered_lines"))
    return out.withColumn("ratio", F.when(F.col("word_lines") == 0, 1.0).otherwise(F.round(F.col("offered_lines") / F.col("word_lines"), 6)))


def gaps(lines_: DataFrame) -> DataFrame:
    """Runs of lines with words that are not offered: path, first_line, last_line, lines, preview. Lines without words neither extend nor break a run; an offered line breaks it."""
    island = F.sum(F.col("offered").cast("int")).over(Window.partitionBy("path").orderBy("line"))
    open_ = lines_.withColumn("island", island).filter("has_word and not offered")
    found = open_.groupBy("path", "island").agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("line").alias("lines"), F.min_by(T.preview(F.col("text"), PREVIEW), "line").alias("preview")
    )
    return found.drop("island")


def ranked_gaps(gaps_: DataFrame) -> DataFrame:
    """gaps with their rank in the file: most lines first, then the earliest."""
    return gaps_.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("lines"), "first_line")))


def largest_gap(gaps_: DataFrame) -> DataFrame:
    return ranked_gaps(gaps_).filter("rank = 1").drop("rank")


def coverage_report(coverage_: DataFrame, gaps_: DataFrame, least: int = LEAST_LINES, top: int = TOP_GAPS) -> DataFrame:
    """Files with a gap of at least ``least`` lines: their coverage and up to ``top`` such gaps."""
    long_ = ranked_gaps(gaps_.filter(F.col("lines") >= least)).filter(F.col("rank") <= top)
    return coverage_.join(long_, "path")


def coverage_totals(coverage_: DataFrame) -> DataFrame:
    out = coverage_.agg(F.count("path").alias("files"), F.coalesce(F.sum("word_lines"), F.lit(0)).alias("word_lines"), F.coalesce(F.sum("offered_lines"), F.lit(0)).alias("offered_lines"))
    return out.withColumn("ratio", F.when(F.col("word_lines") == 0, 1.0).otherwise(F.round(F.col("offered_lines") / F.col("word_lines"), 6)))
