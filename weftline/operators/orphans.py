"""State without a source, sources without state, and which of them are one renamed file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from weftline.sources.shared import kept

#: Share of a new file's distinct hashes that an orphan must hold to count as its earlier self.
OVERLAP = 0.5
#: Holders of a hash that meet the files which ask for it in one part.
PART = 1000
#: Wishes of a file that the first round of claims reads.
WISHES = 32


def orphan_states(states: DataFrame, files: DataFrame) -> DataFrame:
    return states.join(files.select("path").distinct(), "path", "left_anti")


def stateless_files(files: DataFrame, states: DataFrame) -> DataFrame:
    return files.join(states.select("path").distinct(), "path", "left_anti")


def _sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, hashes) of each different set of hashes, and (path, rep) of the files that have it: copies are compared once."""
    sets = rows.filter("source_hash is not null").groupBy("path").agg(F.array_sort(F.collect_set("source_hash")).alias("hashes"))
    groups = kept(sets.groupBy("hashes").agg(F.min("path").alias("rep"), F.collect_list("path").alias("paths")))
    return groups.select("rep", "hashes"), groups.select("rep", F.explode("paths").alias("path"))


def _common(own: DataFrame, held: DataFrame) -> DataFrame:
    """(rep, orphan_rep, n, common) of the sets of own and held(rep, hashes) that share OVERLAP of own's n hashes at least.

    Of n hashes of which k must be shared, any n - k + 1 hold a shared one; the rarest in
    held are looked up, and the others counted only for pairs found by these. The holders
    of a frequent hash are dealt in parts of PART.
    """
    holds = held.select(F.col("rep").alias("orphan_rep"), F.explode("hashes").alias("h"))
    freq = holds.groupBy("h").agg(F.count("h").alias("f"))
    parts = lambda f: F.ceil(f / PART)
    need = F.greatest(F.ceil(OVERLAP * F.col("n")), F.lit(1)).cast("int")
    rows = own.select("rep", F.explode("hashes").alias("h")).join(freq, "h", "left")
    ranked = rows.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "h"))).alias("r"))
    ranked = ranked.select("rep", F.size("r").alias("n"), "r").withColumn("k", need)
    ranked = kept(ranked.select("rep", "n", "k", F.expr("slice(r, 1, n - k + 1)").alias("rare"), F.expr("transform(slice(r, n - k + 2, k - 1), x -> x.h)").alias("others")))
    asked = ranked.select("rep", F.explode("rare").alias("x")).select("rep", "x.h", "x.f").filter("f > 0")
    asked = asked.select("rep", "h", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("f")) - 1)).alias("part"))
    often = freq.filter(F.col("f") > PART).select("h", parts(F.col("f")).alias("parts"))
    offered = holds.join(often, "h", "left").select("h", "orphan_rep", F.pmod(F.xxhash64("orphan_rep"), F.coalesce("parts", F.lit(1))).alias("part"))
    found = asked.join(offered, ["h", "part"]).groupBy("rep", "orphan_rep").agg(F.count("h").alias("common"))
    found = found.join(ranked.select("rep", "n", "k", "others"), "rep")
    sure = found.filter("k = 1").select("rep", "orphan_rep", "n", "common")
    open_ = found.filter("k > 1").join(held.select(F.col("rep").alias("orphan_rep"), "hashes"), "orphan_rep")
    counted = open_.select("rep", "orphan_rep", "n", "k", (F.col("common") + F.size(F.array_intersect("others", "hashes"))).alias("common"))
    return sure.unionByName(counted.filter("common >= k").drop("k"))


def overlaps(new: DataFrame, orphans: DataFrame) -> DataFrame:
    """(path, orphan_path, overlap) where the orphan holds OVERLAP of the new file's distinct hashes at least."""
    (own, files), (held, olds) = _sets(new), _sets(orphans)
    found = _common(own, held).select("rep", "orphan_rep", (F.col("common") / F.col("n")).alias("overlap"))
    return found.join(files, "rep").join(olds.toDF("orphan_rep", "orphan_path"), "orphan_rep").select("path", "orphan_path", "overlap")


def candidates(new: DataFrame, orphans: DataFrame) -> DataFrame:
    """(path, orphan_path, exact, overlap) that may be one file.

    new and orphans: path, file_hash, source_hash, a row a segment (null hash for a file
    without any). Equal file hashes are exact; else the share of the new file's distinct
    hashes that the orphan holds must reach OVERLAP. No pair of files is compared without
    a hash in common.
    """
    new_files, old_files = (x.select("path", "file_hash").distinct() for x in (new, orphans))
    exact = new_files.join(old_files.withColumnRenamed("path", "orphan_path"), "file_hash").select("path", "orphan_path", F.lit(True).alias("exact"), F.lit(1.0).alias("overlap"))
    near = overlaps(new, orphans).select("path", "orphan_path", F.lit(False).alias("exact"), "overlap")
    return exact.unionByName(near).groupBy("path", "orphan_path").agg(F.max("exact").alias("exact"), F.max("overlap").alias("overlap"))


def _best(edges: DataFrame, after: Column | None, width: int) -> DataFrame:
    """(path, orphan_path, rank, upto): of each file the wishes behind rank ``after``, best first, ``width`` at most."""
    w = Window.partitionBy("path").orderBy(F.desc("exact"), F.desc("overlap"), "orphan_path")
    last = F.lit(width) if after is None else after + width
    out = edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= last)
    return (out if after is None else out.filter(F.col("rank") > after)).select("path", "orphan_path", "rank", last.alias("upto"))


def match_orphans(new: DataFrame, orphans: DataFrame) -> DataFrame:
    """(path, orphan_path): each new file, by path, claims its best unclaimed orphan: an exact one, else the largest overlap, the first path of equals.

    Claims depend on each other, so that one task makes them, from the best WISHES of each
    file. A file whose wishes have all gone to earlier ones waits, and gets more in the next
    round. It may then take what a later file has had; an orphan lost to an earlier file
    stays lost, so that each file goes on where it stopped.
    """
    edges = kept(candidates(new, orphans))
    wishes, width = kept(_best(edges, None, WISHES)), WISHES
    path, orphan = (edges.schema[c].dataType for c in ("path", "orphan_path"))
    kinds = StructType([StructField("path", path), StructField("orphan_path", orphan), StructField("rank", IntegerType()), StructField("waits", BooleanType())])

    def claim(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["path", "rank"], ignore_index=True)
        codes = pd.factorize(rows.orphan_path)[0]
        begins = np.flatnonzero((rows.path != rows.path.shift()).to_numpy())
        taken, at, got = np.zeros(len(rows), dtype=bool), [], []
        for lo, hi in zip(begins, [*begins[1:], len(rows)]):
            free = np.flatnonzero(~taken[codes[lo:hi]])
            got.append(len(free) > 0)
            at.append(lo + free[0] if len(free) else hi - 1)
            if len(free):
                taken[codes[at[-1]]] = True
        out = rows.iloc[at].reset_index(drop=True)
        out["waits"] = ~np.array(got) & (out["rank"] == out["upto"]).to_numpy()
        out["orphan_path"] = out.orphan_path.astype(object).where(np.array(got), None)
        return out[["path", "orphan_path", "rank", "waits"]]

    while True:
        made = kept(wishes.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(claim, kinds))
        has = made.filter("orphan_path is not null")
        waiting = made.filter("waits").select("path", F.col("rank").alias("_after"))
        if waiting.isEmpty():
            return has.select("path", "orphan_path")
        width *= 4
        more = _best(edges.join(waiting, "path"), F.col("_after"), width)
        held = wishes.join(has.select("path", F.col("rank").alias("_at")), "path").filter("rank >= _at").drop("_at")
        wishes = kept(held.unionByName(more))


def adopt_renamed(states: DataFrame, renames: DataFrame) -> DataFrame:
    """states under the new paths of renames(path, orphan_path); others as they are."""
    moved = renames.select(F.col("path").alias("_to"), F.col("orphan_path").alias("path"))
    return states.join(moved, "path", "left").withColumn("path", F.coalesce("_to", "path")).drop("_to")


def orphan_report(orphans: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, renamed_to): every orphan, with the file it became, if any."""
    moved = renames.select(F.col("orphan_path").alias("path"), F.col("path").alias("renamed_to"))
    return orphans.select("path").distinct().join(moved, "path", "left")
