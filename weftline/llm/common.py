"""What the operators share: the shared folder, written intermediate tables, fold tests, samples."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that one numpy pass over several documents may hold.
PASS_CHARS = 1 << 20
#: Values of a sample's column up to which their counts are sent to all executors.
SENT_VALUES = 100_000
#: Whether Spark (from 4.1 on) deletes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of each table that ``written`` or ``together`` made.
_PATHS: weakref.WeakKeyDictionary[DataFrame, list[str]] = weakref.WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a temporary folder; on a cluster, whose machines would not see it, this is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="weftline-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends here and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = [path]
    return back


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of the same columns that ``written`` made, as one such table in their place."""
    paths = [path for df in tables for path in _PATHS.pop(df)]
    back = tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)
    _PATHS[back] = paths
    return back


def forget(*tables: DataFrame | None) -> None:
    """Deletes the folders of tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        for path in _PATHS.pop(df, []) if df is not None else []:
            jvm = df.sparkSession._jvm
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def shuffles_done(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs that have ended, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a query as soon as it ends, where it knows how to; the session's own setting holds again after that."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def encoders_freed() -> None:
    """In a worker: frees the encoders that it keeps from task to task, for operators that do without; else they take memory as long as the worker is used at all."""
    held = sys.modules.get("weftline.llm.word_tokens")
    if held is None or not held._OPEN:
        return
    held._OPEN.clear()
    gc.collect()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def spread_sample(df: DataFrame, key: str, bound: int, by: str | None = None) -> DataFrame:
    """At most ``bound`` rows (for each value of ``by``), the same ones at every run: those of the smallest hash of key.

    Where a value of ``by`` has more rows, only those with a hash below about its share are ranked, so that no task gets
    many more than ``bound`` rows of a value, however frequent; by chance, in one of 10,000 samples, some rows of the bound are missing.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    if by is None:
        return df.orderBy(order, key).limit(bound)
    counts = written(df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), "sample-counts")
    # sent to all executors where values are few, so that rows are thinned before they are dealt by value
    counts = F.broadcast(counts) if counts.count() <= SENT_VALUES else counts
    few = (order.cast("double") / 2.0**64 + 0.5) * F.col("_n") <= bound + 4 * bound**0.5
    w = Window.partitionBy(by).orderBy(order, key)
    near = df.join(counts, by).filter(few).drop("_n")
    return near.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= bound).drop("_rank")


def passes(sizes: list[int], most: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``most``; one larger item gets a range of its own."""
    lo = total = 0
    for hi, n in enumerate(sizes):
        if hi > lo and total + n > most:
            yield lo, hi
            lo, total = hi, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
