"""Documents from their source and translations: only the bytes of replaced spans change."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Copies the gaps and puts each text in; a splice that starts before the last one's end is passed over and moves nothing.
_SPLICE = """
aggregate(array_sort(splices), named_struct('pos', 0L, 'out', cast('' as binary)),
  (acc, x) -> if(x.start < acc.pos, acc, named_struct('pos', x.stop, 'out',
     concat(acc.out, substring(raw, cast(acc.pos + 1 as int), cast(x.start - acc.pos as int)), encode(x.text, 'utf-8')))),
  acc -> decode(concat(acc.out, substring(raw, cast(acc.pos + 1 as int))), 'utf-8'))
"""
#: The same where no splice overlaps the one before: every piece is cut once, and all are joined once.
_PIECES = """
decode(unhex(concat(array_join(transform(pieces, (x, i) -> concat(
    hex(substring(raw, cast(if(i = 0, 0L, pieces[i - 1].stop) + 1 as int), cast(x.start - if(i = 0, 0L, pieces[i - 1].stop) as int))),
    hex(encode(x.text, 'utf-8')))), ''), hex(substring(raw, cast(element_at(pieces, -1).stop + 1 as int))))), 'utf-8')
"""


def join_translations(segments: DataFrame) -> DataFrame:
    """(path, section_idx, block_idx, text, n_translated): each block's segments(seq, source, translation), the source where there is no translation, joined by a space."""
    return segments.groupBy("path", "section_idx", "block_idx").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(seq, coalesce(translation, source) as t))), x -> x.t), ' ')").alias("text"), F.count("translation").alias("n_translated")
    )


def collect_splices(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, start, ord, stop, text) of translatable blocks with a span of which at least one segment is translated."""
    texts = join_translations(segments).filter("n_translated > 0")
    spanned = blocks.filter(F.col("translatable") & F.col("span_start").isNotNull())
    joined = spanned.join(texts, ["path", "section_idx", "block_idx"])
    order = F.col("section_idx").cast("long") * 1_000_000 + F.col("block_idx")
    return joined.select("path", F.col("span_start").cast("long").alias("start"), order.alias("ord"), F.col("span_end").cast("long").alias("stop"), "text")


def apply_splices(files: DataFrame, splices: DataFrame) -> DataFrame:
    """files(path, source) with output: source with the splices of its path put in, by byte offsets."""
    grouped = splices.groupBy("path").agg(F.collect_list(F.struct("start", "ord", "stop", "text")).alias("splices"))
    joined = files.join(grouped, "path", "left").withColumns({"raw": F.encode("source", "utf-8"), "pieces": F.array_sort("splices")})
    overlap = F.expr("exists(sequence(1, size(pieces)), i -> i < size(pieces) and pieces[i].start < pieces[i - 1].stop)")
    told = F.when(F.col("splices").isNull(), F.col("source")).when(overlap, F.expr(_SPLICE)).otherwise(F.expr(_PIECES))
    return joined.withColumn("output", told).drop("splices", "raw", "pieces")


def setext_underline(mark: Column, title: Column) -> Column:
    """The underline of a translated title: one mark for each character."""
    return F.repeat(mark, F.length(title))


def adorn_underline(mark: Column, title: Column) -> Column:
    """An adornment as wide as the title is displayed, four at least."""
    return F.repeat(mark, F.greatest(T.display_width(title), F.lit(4)))


def underline_splices(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Extra splices that redraw title lines: blocks with role_kind, mark, under_start, under_end and, for titles between two, over_start, over_end."""
    joined = blocks.filter("under_start is not null").join(texts.filter("n_translated > 0"), ["path", "section_idx", "block_idx"])
    drawn = F.when(F.col("role_kind") == "setext_title", setext_underline(F.col("mark"), F.col("text"))).otherwise(adorn_underline(F.col("mark"), F.col("text")))
    order = F.col("section_idx").cast("long") * 1_000_000 + F.col("block_idx")
    part = lambda side: joined.filter(F.col(f"{side}_start").isNotNull()).select("path", F.col(f"{side}_start").cast("long").alias("start"), order.alias("ord"), F.col(f"{side}_end").cast("long").alias("stop"), drawn.alias("text"))
    return part("under").unionByName(part("over"))


def table_splices(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Splices that draw a table anew in which a cell is translated: blocks with role_kind table_anchor, and table_cell for its cells; a table whose cells and geometry disagree stays."""
    from weftline.parsers.rst import redraw_table

    @F.pandas_udf("string")
    def redrawn(sources: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series([redraw_table(s, list(c)) for s, c in zip(sources, cells, strict=True)], dtype="object")

    place = ["path", "section_idx", "block_idx"]
    cells = blocks.filter("role_kind = 'table_cell' and span_start is null").join(texts, place, "left")
    told = F.struct("section_idx", "block_idx", F.coalesce("text", "raw_content").alias("t"))
    laid = cells.groupBy("path", "table_idx").agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]).alias("cells"), F.sum("n_translated").alias("n"))
    anchors = blocks.filter("role_kind = 'table_anchor' and span_start is not null").join(laid.filter("n > 0"), ["path", "table_idx"])
    order = F.col("section_idx").cast("long") * 1_000_000 + F.col("block_idx")
    drawn = anchors.select("path", F.col("span_start").cast("long").alias("start"), order.alias("ord"), F.col("span_end").cast("long").alias("stop"), redrawn("raw_content", "cells").alias("text"))
    return drawn.filter("text is not null")


def changed_outputs(new: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of new(path, output) whose bytes differ from current(path, output), or that are not there yet."""
    old = current.select("path", F.col("output").alias("_old"))
    return new.join(old, "path", "left").filter(~F.col("output").eqNullSafe(F.col("_old"))).drop("_old")
