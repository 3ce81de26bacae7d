"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import kept


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges(a, b): the least id that can be reached.

    Each round takes the least label among the neighbours, then that label's own label,
    until none changes. Labels are checkpointed, so that lineage stays short and lost
    executors do no harm.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("id"), F.col("c").alias("component")))
    while True:
        around = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(around, labels.id == around.a, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        step = kept(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("top", "component")).alias("component")))
        if step.join(labels.withColumnRenamed("component", "was"), "id").filter("component <> was").isEmpty():
            return step
        labels = step
