"""Content and context hashes.

``native`` hashes serve one store of our own. ``compat`` hashes equal those of stored
state files: XXH64 with seed 0 over UTF-8, as signed 64-bit numbers; they use an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType


@dataclass(frozen=True)
class Store:
    """The hashes by which a store names texts and contexts."""

    content: Callable[[Column], Column]
    context: Callable[[Column], Column]


def content_hash(text: Column) -> Column:
    return F.xxhash64(text)


def neighbours(value: Column, path: str = "path", order: str = "seq") -> tuple[Column, Column]:
    """The value before and after, in document order; null at the ends."""
    w = Window.partitionBy(path).orderBy(order)
    return F.lag(value).over(w), F.lead(value).over(w)


def context_hash(hashes: Column, path: str = "path", order: str = "seq") -> Column:
    before, after = neighbours(hashes, path, order)
    return F.xxhash64(F.coalesce(before, F.lit(0)), F.coalesce(after, F.lit(0)))


def stored_context_hash(hashes: Column, path: str = "path", order: str = "seq") -> Column:
    """context_hash as stored state files have it."""
    return compat_context(*neighbours(hashes, path, order))


@pandas_udf(LongType())
def compat_hash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import xxhash

    signed = lambda t: None if t is None else (lambda h: h - (h >> 63 << 64))(xxhash.xxh64_intdigest(t.encode()))
    for batch in texts:
        yield pd.Series([signed(t) for t in batch], dtype="Int64")


@pandas_udf(LongType())
def _compat_bytes(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import xxhash

    for batch in raw:
        yield pd.Series([(lambda h: h - (h >> 63 << 64))(xxhash.xxh64_intdigest(b)) for b in batch], dtype="Int64")


def little_endian(value: Column) -> Column:
    """The eight bytes of a bigint, lowest first."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(value), 16, "0"), "(..)" * 8, "".join(f"${k}" for k in range(8, 0, -1))))


def compat_context(before: Column, after: Column) -> Column:
    return _compat_bytes(F.concat(little_endian(F.coalesce(before, F.lit(0).cast("bigint"))), little_endian(F.coalesce(after, F.lit(0).cast("bigint")))))


@pandas_udf(LongType())
def fnv1a64(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def digest(text: str) -> int:
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h - (h >> 63 << 64)

    for batch in texts:
        yield pd.Series([None if t is None else digest(t) for t in batch], dtype="Int64")


#: Hashes of our own, and those of stored state files.
NATIVE, STORED = Store(content_hash, context_hash), Store(compat_hash, stored_context_hash)
