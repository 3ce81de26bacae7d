"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

Unit vectors, padded with zeros to BITS dimensions and rotated at random, are coded by
the signs of their coordinates; stored beside the code is the factor f, the inner
product of the rotated vector with its code (as a unit vector). For vectors a and b,
<code_b, a> / f_b estimates their cosine without bias, and its error is bounded with
high confidence by CONFIDENCE * sqrt((1 - f_b^2) / f_b^2 / (BITS - 1)). Only pairs whose
upper bound reaches the threshold are computed exactly, in double precision, and only
the exact cosine makes a link.

Candidates share a band of BAND_BITS code bits in one of the bands; at cosine 0.95 a
pair misses them all with probability about 1e-4, and less above. Equal vectors go on
as one. Links inside a component are then counted block by block, so that no pair is
ever emitted.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, as do vectors of another length; repeated vectors link
with each other; a null vec_id links with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written
from weftline.llm.linking import link, shared_buckets
from weftline.llm.minhash_dedup import _binary, _first_shared, block_links, mix

BITS, BAND_BITS, BANDS = 512, 14, 36
CONFIDENCE = 5.0
#: Vectors of a component that one block of the count holds.
BLOCK = 512


@cache
def rotation(dim: int) -> np.ndarray:
    """(dim, BITS): the rows that a random rotation of BITS dimensions gives the first dim coordinates; more dimensions than BITS are projected."""
    rng = np.random.default_rng(1_000 + dim)
    q, r = np.linalg.qr(rng.normal(size=(max(BITS, dim), max(BITS, dim))))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim, :BITS], np.float32) * np.float32(np.sqrt(max(1.0, dim / BITS)))


def unit(raw: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision, or None where it cannot link."""
    if not raw or any(x is None for x in raw):
        return None
    v = np.array(raw, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, signs, factors) of unit vectors."""
    rotated = vectors.astype(np.float32) @ rotation(vectors.shape[1])
    signs = rotated > 0
    return rotated, signs, np.abs(rotated).sum(axis=1) / np.sqrt(BITS)


def upper_bounds(rotated_a: np.ndarray, signs_b: np.ndarray, factors_b: np.ndarray) -> np.ndarray:
    """Upper confidence bound of each (a, b) cosine from a's rotated vector and b's code."""
    code = np.where(signs_b, np.float32(1), np.float32(-1)) / np.float32(np.sqrt(BITS))
    f = np.clip(factors_b, 1e-3, 1)
    return rotated_a @ code.T / f + CONFIDENCE * np.sqrt(np.maximum(0, 1 - f**2) / f**2 / (BITS - 1))


def bands(packed: np.ndarray, dim: int) -> np.ndarray:
    """(vectors, BANDS) bucket keys from codes packed to bytes."""
    bits = np.unpackbits(packed, axis=1)[:, : BANDS * BAND_BITS].reshape(len(packed), BANDS, BAND_BITS)
    key = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(BAND_BITS, dtype=np.uint64))
    return mix(key + (np.arange(BANDS, dtype=np.uint64) << np.uint64(32)) + np.uint64(dim << 40)).astype(np.int64)


_CODED = "vec_id long, low long, high long, vector binary, code binary, factor float, bands array<long>, packed binary"


def code(vectors: DataFrame) -> DataFrame:
    """A row a vector of (vec_id, embedding): two sums that name the unit vector, itself (doubles), code, factor and buckets; nulls where it cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(v) for v in batch.column(1).to_pylist()]
            out: list[list] = [[None] * len(units) for _ in range(7)]
            for dim in sorted({len(u) for u in units if u is not None}):
                at = [i for i, u in enumerate(units) if u is not None and len(u) == dim]
                x = np.stack([units[i] for i in at]) + 0.0
                _, signs, factors = encode(x)
                packed = np.packbits(signs, axis=1)
                keys = bands(packed, dim)
                named = x.view(np.uint64) + mix(np.arange(dim, dtype=np.uint64) + np.uint64(1))
                low, high = mix(named).sum(axis=1, dtype=np.uint64).astype(np.int64), mix(named ^ np.uint64(0xABCDEF)).sum(axis=1, dtype=np.uint64).astype(np.int64)
                for column, values in zip(out, (low.tolist(), high.tolist(), [v.tobytes() for v in x], [p.tobytes() for p in packed], factors.tolist(), keys.tolist(), [k.tobytes() for k in keys]), strict=True):
                    for i, v in zip(at, values, strict=True):
                        column[i] = v
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float32(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[x.split()[0] for x in _CODED.split(", ")])

    return vectors.select("vec_id", "embedding").mapInArrow(run, _CODED)


def _confirm(similarity: float):
    """Of rows (a, b, x, y, code_y, factor_y), the pairs whose exact cosine reaches the threshold; computed where the bound does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = np.zeros(batch.num_rows, bool)
            for size in {len(x) for x, y in zip(xs, ys, strict=True) if len(x) == len(y)}:
                at = np.array([i for i, (x, y) in enumerate(zip(xs, ys, strict=True)) if len(x) == len(y) == size])
                x, y = (np.frombuffer(b"".join(v[i] for i in at), np.float64).reshape(len(at), -1) for v in (xs, ys))
                signs = np.unpackbits(np.frombuffer(b"".join(batch.column(4)[int(i)].as_py() for i in at), np.uint8).reshape(len(at), -1), axis=1)
                rotated = x.astype(np.float32) @ rotation(x.shape[1])
                f = np.clip(batch.column(5).to_numpy()[at], 1e-3, 1)
                estimate = (rotated * (2 * signs.astype(np.float32) - 1)).sum(axis=1) / np.sqrt(BITS) / f
                near = estimate + CONFIDENCE * np.sqrt(np.maximum(0, 1 - f**2) / f**2 / (BITS - 1)) >= similarity
                good[at[near]] = (x[near] * y[near]).sum(axis=1) >= similarity
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _count(similarity: float):
    """Counts links in blocks (component, i, j, id, slot, copies, vector): (id, links) for each member with any, copies counted."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in sorted({len(v) for v in rows["vector"]}):
            same = rows[rows["vector"].map(len) == size]
            x = np.frombuffer(b"".join(same["vector"]), np.float64).reshape(len(same), -1)
            ids, slot, copies = same["id"].to_numpy(), same["slot"].to_numpy(), same["copies"].to_numpy()
            i, j = key[1], key[2]
            left, right = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
            rotated, _, _ = encode(x[left])
            _, signs, factors = encode(x[right])
            near = upper_bounds(rotated, signs, factors) >= similarity
            a, b = np.nonzero(near)
            cosine = np.empty(len(a))
            for lo in range(0, len(a), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                cosine[part] = (x[left[a[part]]] * x[right[b[part]]]).sum(axis=1)
            ok = (cosine >= similarity) & (left[a] != right[b])
            a, b = left[a[ok]], right[b[ok]]
            links = np.bincount(a, weights=copies[b], minlength=len(x))
            if i != j:
                links += np.bincount(b, weights=copies[a], minlength=len(x))
            out.append(pd.DataFrame({"id": ids, "links": links.astype(np.int64)})[links > 0])
        return pd.concat(out)

    return run


def near_duplicates(vectors: DataFrame, similarity: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors(vec_id, embedding)."""
    coded = written(code(vectors), "coded")
    full = coded.filter("code is not null and vec_id is not null")
    named = ["low", "high"]
    classes = written(full.groupBy(*named).agg(F.min("vec_id").alias("rep"), F.count("vec_id").alias("copies")), "classes")
    whole = full.join(classes, [full[c] == classes[c] for c in named] + [full.vec_id == classes.rep], "left_semi")
    reps = written(whole.select(F.col("vec_id").alias("id"), "vector", "code", "factor", "bands", "packed").dropDuplicates(["id"]), "reps")

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(reps.select("id", "vector").toDF("a", "x"), "a").join(reps.select("id", "vector", "code", "factor").toDF("b", "y", "c", "f"), "b")
        return both.select("a", "b", "x", "y", "c", "f").mapInArrow(_confirm(similarity), "a long, b long")

    def linked_rows(table: pa.Table):
        raw = table.column(6).to_pylist()
        dims = np.fromiter(map(len, raw), np.int64, len(raw))
        codes, keys, factors = _binary(table.column(7), np.uint8), _binary(table.column(9), np.int64), np.clip(table.column(8).to_numpy(), 1e-3, 1)
        width = CONFIDENCE * np.sqrt(np.maximum(0, 1 - factors**2) / factors**2 / (BITS - 1))

        def check(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
            good = np.zeros(len(a), bool)
            same = np.flatnonzero(dims[a] == dims[b])
            same = same[_first_shared(keys, a[same], b[same], key[same])]
            for at in np.array_split(same, len(same) // 4096 + 1):
                for size in np.unique(dims[a[at]]):
                    k = at[dims[a[at]] == size]
                    x, y = (np.frombuffer(b"".join(raw[r] for r in rows), np.float64).reshape(len(rows), -1) for rows in (a[k], b[k]))
                    signs = 2 * np.unpackbits(codes[b[k]], axis=1)[:, :BITS].astype(np.float32) - 1
                    bound = ((x.astype(np.float32) @ rotation(x.shape[1])) * signs).sum(axis=1) / np.sqrt(BITS) / factors[b[k]] + width[b[k]]
                    near = bound >= similarity
                    good[k[near]] = (x[near] * y[near]).sum(axis=1) >= similarity
            return good

        return check

    def compare(rows: DataFrame) -> DataFrame:
        info = reps.select("id", "vector", "code", "factor", "packed")
        return block_links(rows.join(info, "id"), ["vector", "code", "factor", "packed"], linked_rows)

    linked = written(link(shared_buckets(reps.select(F.explode("bands").alias("key"), "id")), confirm, compare, rounds=1), "linked")
    members = linked.join(classes.select(F.col("rep").alias("id"), "copies"), "id").join(reps.select("id", "vector"), "id")
    sizes = linked.groupBy("component").agg(F.ceil(F.count("id") / BLOCK).cast("int").alias("slots"))
    members = members.join(written(sizes, "sizes"), "component").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
    members = members.select("component", "id", "slot", "copies", "vector", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other"))
    members = members.withColumns({"i": F.least("slot", "other"), "j": F.greatest("slot", "other")})
    counted = members.groupBy("component", "i", "j").applyInPandas(_count(similarity), "id long, links long")
    counted = written(counted.groupBy("id").agg(F.sum("links").alias("links")), "counted")

    found = classes.join(linked, classes.rep == linked.id, "left").drop("id").join(counted, classes.rep == counted.id, "left")
    found = found.select(*named, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = coded.join(written(found, "class-links"), named, "left")
    usable = F.col("code").isNotNull() & F.col("vec_id").isNotNull()
    component = F.when(usable, F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.when(usable, F.col("n")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
