"""Trees of files laid over each other. Layers: (layer, path, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay_layers(layers: DataFrame) -> DataFrame:
    """One row a path: the file of its highest layer."""
    return layers.groupBy("path").agg(F.max("layer").alias("layer"), F.max_by("source", "layer").alias("source"))


def require_base(overlay: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with a counterpart in base, files without, which are skipped and reported)."""
    paths = base.select("path").distinct()
    return overlay.join(paths, "path", "left_semi"), overlay.join(paths, "path", "left_anti")


def patch_targets(patches: DataFrame) -> DataFrame:
    """(name, target) of every file that the unified diffs in patches(name, patch) write."""
    found = F.regexp_extract_all("patch", F.lit(r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)"), F.lit(1))
    return patches.select("name", F.explode(found).alias("target")).filter("target <> '/dev/null'").distinct()


def assemble_report(layers: DataFrame, skipped: DataFrame, patches: DataFrame, steps: int) -> DataFrame:
    """One row: linked (base files), overlaid, skipped, patches, steps."""
    counts = layers.agg(F.count_if(F.col("layer") == 0).alias("linked"), F.count_if(F.col("layer") > 0).alias("overlaid"))
    return counts.crossJoin(skipped.agg(F.count("path").alias("skipped"))).crossJoin(patches.agg(F.count("name").alias("patches"))).withColumn("steps", F.lit(steps))
