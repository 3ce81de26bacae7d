"""Table groups, and rules that narrow which columns are translated.

Cells: path, section_idx, block_idx, table_idx, column_idx, label_row, header, raw_content,
translatable. Rules: rule_idx, files (glob or null), headers, translate and skip (arrays of
struct(idx, header), one of the two null).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TABLE = ("path", "section_idx", "table_idx")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, *_FOLD)


def glob_pattern(glob: str) -> str | None:
    """Regular expression of a path glob, or None where it is not valid: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", r"\\") + "]"
            i = end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def table_groups(cells: DataFrame) -> DataFrame:
    """A row a table: its headers by column, holes empty, and the number of its body cells."""
    labels = F.collect_list(F.when(F.col("label_row") & F.col("header").isNotNull(), F.struct("column_idx", "header")))
    grouped = cells.groupBy(*TABLE).agg(F.array_sort(labels).alias("named"), F.count_if(~F.col("label_row")).alias("body_cells"), F.min("block_idx").alias("first_block"))
    width = F.array_max(F.transform("named", lambda x: x["column_idx"]))
    at = lambda i: F.coalesce(F.get(F.filter("named", lambda x: x["column_idx"] == i), F.lit(0))["header"], F.lit(""))
    headers = F.when(F.size("named") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(width, F.lit(0))), at))
    return grouped.select(*TABLE, headers.alias("headers"), "body_cells", "first_block")


def subsequence(headers: Column, wanted: Column) -> Column:
    """Whether wanted, which must not be empty, occurs in headers in this order, whatever the case of A-Z."""
    step = lambda k, x: F.when(ascii_lower(x).eqNullSafe(ascii_lower(F.get(wanted, k))), k + 1).otherwise(k)
    return (F.size(wanted) > 0) & (F.aggregate(headers, F.lit(0), step) == F.size(wanted))


def rules_for(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, rule_idx, headers, translate, skip): rules without a glob, and those whose pattern matches the path or its last part.

    pattern must have been made by glob_pattern; a rule whose glob was not valid has files but no pattern and applies nowhere.
    """
    name = F.element_at(F.split("path", "/"), -1)
    applies = F.col("files").isNull() | F.rlike("path", F.col("pattern")) | F.rlike(name, F.col("pattern"))
    return paths.select("path").distinct().join(F.broadcast(rules), F.coalesce(applies, F.lit(False)))


def match_rule(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """groups with the first rule, as declared, that applies to the path and whose headers they have; rule_idx, translate and skip are null where none does."""
    wanted = F.col("wanted")
    found = groups.join(rules_for(rules, groups).withColumnRenamed("headers", "wanted"), "path").filter(subsequence(F.col("headers"), wanted))
    best = found.groupBy(*TABLE).agg(F.min_by(F.struct("rule_idx", "translate", "skip"), "rule_idx").alias("r"))
    return groups.join(best, list(TABLE), "left").select(*groups.columns, "r.rule_idx", "r.translate", "r.skip")


def column_selected(column_idx: Column, header: Column, translate: Column, skip: Column) -> Column:
    """Whether a rule keeps a column: one of translate, if there are any, or none of skip."""
    names = lambda refs: F.exists(refs, lambda r: F.coalesce(r["idx"] == column_idx, F.lit(False)) | F.coalesce(ascii_lower(r["header"]) == ascii_lower(header), F.lit(False)))
    some = F.coalesce(F.size(translate) > 0, F.lit(False))
    return F.when(some, names(translate)).otherwise(~F.coalesce(names(skip), F.lit(False)))


def apply_table_rules(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """cells with translatable cleared, and excluded set, on body cells of columns that the matched rule leaves out; labels stay."""
    groups = match_rule(table_groups(cells), rules).select(*TABLE, F.col("headers").alias("_headers"), "rule_idx", "translate", "skip")
    joined = cells.join(groups, list(TABLE), "left")
    header = F.get("_headers", F.col("column_idx"))
    out = F.col("rule_idx").isNotNull() & ~F.col("label_row") & ~column_selected(F.col("column_idx"), header, F.col("translate"), F.col("skip"))
    return joined.select(*cells.columns, "rule_idx", out.alias("excluded")).withColumn("translatable", F.col("translatable") & ~F.col("excluded"))


def inspect_tables(cells: DataFrame, samples: int = 3, width: int = 44) -> DataFrame:
    """Per table column of ruled cells: header, cells, excluded, state (kept, partly, translated), samples, and whether a rule matched."""
    from weftline.functions.text import preview

    body = F.col("label_row") == F.lit(False)
    out = cells.groupBy(*TABLE, "column_idx").agg(
        F.max(F.when(F.col("label_row"), F.col("header"))).alias("header"),
        F.count_if(body).alias("cells"),
        F.count_if(F.col("excluded")).alias("excluded"),
        F.max("rule_idx").isNotNull().alias("ruled"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(body, F.struct("block_idx", preview(F.col("raw_content"), width).alias("t"))))), 1, samples), lambda x: x["t"]).alias("samples"),
    )
    state = F.when(F.col("excluded") == 0, "translated").when(F.col("excluded") == F.col("cells"), "kept").otherwise("partly")
    return out.withColumn("state", state)
