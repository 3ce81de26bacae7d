"""Harmonic packing of token documents into fixed-length sequences.

With sequences of C ids, a length in (C/(k+1), C/k] is of class k, and a bin of class k
takes exactly k pieces; lengths under C/CLASSES are packed next-fit among themselves.
Documents may be cut: whole sequences first; then, while the rest fills less than TIGHT
of its class's share, a piece of exactly C//(k+1) ids is cut off, which wastes nothing
in class k+1. Every task fills bins of its own, in the order in which it meets pieces.
The few pieces left in bins that never filled move up a tree: FAN tasks' leftovers are
packed together by the same rule, then those of FAN such groups, up to one group, whose
last pieces (fewer than the classes' counts together, whatever the input's size) are
packed across classes, first-fit by decreasing length.

Defined results: a null text is empty, an empty text has its end id alone; repeated
doc_ids are packed as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import passes, written
from weftline.llm.word_tokens import WORD_BPE, encoder, tokenizer_path

LENGTH, END = 4096, 2
CLASSES, TIGHT = 64, 0.97
#: Groups of leftovers that are packed together at each step up the tree.
FAN = 64
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int, owner long"


def cut(n: int, room: int = LENGTH) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n ids; class 0 holds the small ones."""
    pieces = [(room, 1)] * (n // room)
    rest = n % room
    while rest:
        if rest * CLASSES < room:
            pieces.append((rest, 0))
            break
        k = room // rest
        if rest >= TIGHT * (room // k):
            pieces.append((rest, k))
            break
        pieces.append((room // (k + 1), k + 1))
        rest -= room // (k + 1)
    return pieces


class Bins:
    """Open bins by class. ``add`` returns the pieces of a bin that has just closed, each with its offset."""

    def __init__(self, room: int = LENGTH):
        self.room, self.open, self.closed = room, {}, 0

    def add(self, kind: int, piece: tuple, length: int) -> list[tuple[tuple, int, int]]:
        """piece is any tuple; (piece, bin, offset) of all pieces of a closed bin come back."""
        held, used = self.open.setdefault(kind, ([], 0))
        done = []
        if kind == 0 and used + length > self.room:
            done, held, used = self._close(held), [], 0
        held.append((piece, used))
        used += length
        self.open[kind] = (held, used)
        if kind and len(held) == kind:
            done = self._close(held)
            del self.open[kind]
        return done

    def _close(self, held: list) -> list[tuple[tuple, int, int]]:
        self.closed += 1
        return [(piece, self.closed - 1, offset) for piece, offset in held]

    def rest(self) -> Iterator[tuple[int, tuple]]:
        for kind, (held, _) in sorted(self.open.items()):
            for piece, _ in held:
                yield kind, piece


def first_fit(pieces: list[tuple[int, tuple]], room: int = LENGTH) -> list[tuple[tuple, int, int]]:
    """(piece, bin, offset) of (length, piece) by decreasing length, each in the first bin with room."""
    used: list[int] = []
    out = []
    for length, piece in sorted(pieces, key=lambda x: (-x[0], x[1])):
        k = next((i for i, u in enumerate(used) if u + length <= room), len(used))
        if k == len(used):
            used.append(0)
        out.append((piece, k, used[k]))
        used[k] += length
    return out


def _place(docs: DataFrame, tokenizer: str, spaces_kept: bool, room: int, end: int, keep_ids: bool) -> DataFrame:
    schema = _PIECE + (", ids binary" if keep_ids else "")
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task, bins = encoder(tokenizer, spaces_kept), TaskContext.get().partitionId(), Bins(room)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def row(piece: tuple, sequence: int | None, offset: int | None, kind: int) -> tuple:
            return (*piece[:5], sequence, offset, kind, task, *piece[5:])

        for batch in batches:
            sizes = [max(1, n or 0) for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for lo, hi in passes(sizes):
                doc_ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                ids, counts = own.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()], end)
                raw, at, rows = memoryview(ids.tobytes()), 0, []
                for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
                    start = 0
                    for length, kind in cut(n, room):
                        part = raw[4 * (at + start) : 4 * (at + start + length)]
                        piece = (doc_id, start, length, zlib.crc32(part), n, *([bytes(part)] if keep_ids else []))
                        rows += [row(p, (task << 32) + b, o, kind) for p, b, o in bins.add(kind, piece, length)]
                        start += length
                    at += n
                if rows:
                    yield table(rows)
        if rows := [row(p, None, None, kind) for kind, p in bins.rest()]:
            yield table(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _settle(pieces: DataFrame, level: int, last: bool, room: int) -> DataFrame:
    """Packs the leftovers of each group; what is left of them again has no sequence yet, unless this is the last step."""
    columns = pieces.columns

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["class", "doc_id", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        base, bins = (level << 56) + (int(key[0]) << 32), Bins(room)
        sequence = np.full(len(rows), -1, np.int64)
        offset = np.full(len(rows), -1, np.int64)
        lengths = rows["length"].tolist()
        done = [x for i, kind in enumerate(rows["class"].tolist()) for x in bins.add(kind, (i,), lengths[i])]
        if last:
            done += [((p[0],), bins.closed + b, o) for p, b, o in first_fit([(lengths[i], (i,)) for _, (i,) in bins.rest()], room)]
        for (i,), b, o in done:
            sequence[i], offset[i] = base + b, o
        rows["sequence_id"], rows["offset"] = pd.array(sequence, "Int64"), pd.array(offset, "Int64")
        rows.loc[sequence < 0, ["sequence_id", "offset"]] = pd.NA
        rows["owner"] = key[0]
        return rows[columns]

    return pieces.withColumn("owner", F.expr(f"owner div {FAN}")).groupBy("owner").applyInPandas(run, pieces.schema)


def pack(docs: DataFrame, tokenizer: str | None = None, spaces_kept: bool = False, room: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    placed = written(_place(docs, tokenizer or tokenizer_path(WORD_BPE), spaces_kept, room, end, keep_ids), "packed")
    out = placed.filter("sequence_id is not null")
    left = placed.filter("sequence_id is null")
    groups = 1 + (left.agg(F.max("owner")).first()[0] or 0)
    level = 0
    while True:
        level, groups = level + 1, -(-groups // FAN)
        step = _settle(left, level, groups == 1, room)
        if groups == 1:
            out = out.unionByName(step)
            break
        step = written(step, "packed")
        out = out.unionByName(step.filter("sequence_id is not null"))
        left = step.filter("sequence_id is null")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def sequences(pieces: DataFrame, room: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, used) of pieces with ids: joined in order and padded to room, unless their length is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(offset, hex(ids) as h))), x -> x.h), '')").alias("h"), F.sum("length").alias("used")
    )
    filler = F.lit(f"{pad & 0xFF:02X}{pad >> 8 & 0xFF:02X}{pad >> 16 & 0xFF:02X}{pad >> 24:02X}")
    missing = F.when(F.bit_count("used") == 1, 0).otherwise(F.lit(room) - F.col("used")).cast("int")
    return joined.select("sequence_id", F.unhex(F.concat("h", F.repeat(filler, missing))).alias("ids"), "used")
