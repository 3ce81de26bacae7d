"""Token ids in binary files with Simple-8b word-aligned coding.

A file is a sequence of segments. A segment: 8-byte magic; five unsigned 64-bit numbers
(documents, ids, ids a block, blocks, words); per document its id (signed 64-bit) and
its count of ids (unsigned 32-bit); per block the offset of its first word (unsigned
32-bit); the words. Everything is little-endian. A word's upper four bits select how
many ids of how many bits its other 60 bits hold, lowest bits first. Selector 0 is the
escape: the next word is one id as it stands, of up to 64 bits. Every block starts a
new word, so that blocks decode apart from each other and all words of one selector
decode at once.

Documents are dealt out by ranges of doc_id, so that the files in the order of their
names hold the documents in ascending order. A file is written under a name of its own
attempt and then renamed: a lost or repeated task leaves no half file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import new_folder, passes
from weftline.llm.word_tokens import BYTE_BPE, encoder, tokenizer_path

MAGIC = b"WLS8B\x00\x00\x01"
BLOCK = 256
#: Ids a word holds by selector, and their bits; selector 0 is the escape.
COUNTS = (1, 240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
BITS = (64, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<8s5Q")


#: Bits of the ids below 2**17.
_SMALL = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 0 for id 0."""
    if len(ids) and ids.max() < len(_SMALL):
        return _SMALL[ids]
    if len(ids) and ids.max() < 1 << 52:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    return np.array([int(x).bit_length() for x in ids.tolist()], np.uint8)


def _window_max(bits: np.ndarray, n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Maximum over the n ids from each one on; beyond the end counts as 0."""
    if n not in known:
        half = -(-n // 2)
        base = _window_max(bits, half, known)
        shifted = np.zeros_like(base)
        shifted[: len(base) - (n - half)] = base[n - half :]
        known[n] = np.maximum(base, shifted)
    return known[n]


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and each block's first word."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    blocks = -(-n // block)
    padded = np.zeros(blocks * block, np.uint64)
    padded[:n] = ids
    bits = _bit_lengths(padded).reshape(blocks, block)
    # the ids of a block's end may be fewer than a selector holds: zeros stand beyond
    wide = np.zeros((blocks, block + max(COUNTS)), np.uint8)
    wide[:, :block] = bits
    flat, known = wide.ravel(), {}
    known[1] = flat
    choice = np.zeros(flat.shape, np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        fits = _window_max(flat, COUNTS[s], known) <= BITS[s]
        np.copyto(choice, s, where=fits)
    # an id of 31 to 60 bits fits no shared word: the escape takes it
    width = wide.shape[1]
    count = np.array(COUNTS)
    at, left = np.zeros(blocks, np.int64), np.arange(blocks)
    begins = np.zeros(blocks * block, bool)
    while len(left):
        begins[left * block + at[left]] = True
        at[left] += count[choice[left * width + at[left]]]
        left = left[at[left] < block]
    where = np.flatnonzero(begins)
    which, owner = choice.reshape(blocks, width)[:, :block].ravel()[where], where // block
    need = np.where(which == 0, 2, 1)
    slot = np.cumsum(need) - need
    words = np.zeros(int(need.sum()), np.uint64)
    longer = np.concatenate([padded, np.zeros(max(COUNTS), np.uint64)])
    last = (owner + 1) * block
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(which == s)
        if not len(mine):
            continue
        if s == 0:
            words[slot[mine] + 1] = longer[where[mine]]
            continue
        value = np.full(len(mine), s << 60, np.uint64)
        if BITS[s]:
            for k in range(COUNTS[s]):
                i = where[mine] + k
                value |= np.where(i < last[mine], longer[i], 0).astype(np.uint64) << np.uint64(k * BITS[s])
        words[slot[mine]] = value
    starts = slot[np.r_[True, owner[1:] != owner[:-1]]].astype(np.uint32)
    return words, starts


def unpack(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of the words; all words of one selector at once."""
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # a word after an escape is an id, not a selector; escapes are rare, so they are walked
    raw = np.zeros(len(words), bool)
    escape = -2
    for i in np.flatnonzero(selector == 0).tolist():
        if i == escape + 1:
            escape = -2
        else:
            escape = i
            raw[i + 1] = True
    count = np.array(COUNTS)[selector]
    count[raw] = 0
    # where each word's ids begin: counted from its block's first word
    before = np.cumsum(count) - count
    first = np.asarray(starts, np.int64)
    per_block = np.diff(np.r_[first, len(words)])
    place = before - np.repeat(before[first], per_block) + np.repeat(np.arange(len(first)) * block, per_block)
    limit = np.repeat((np.arange(len(first)) + 1) * block, per_block)
    out = np.zeros(len(first) * block, np.uint64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero((selector == s) & ~raw)
        if not len(mine) or (s and not BITS[s]):
            continue
        if s == 0:
            out[place[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            i = place[mine] + k
            ok = i < limit[mine]
            out[i[ok]] = (words[mine[ok]] >> np.uint64(k * BITS[s])) & mask
    return out[:n]


def segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts = pack(ids)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), BLOCK, len(starts), len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_segments(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, counts, ids) of each segment of an open file."""
    while head := stream.read(_HEAD.size):
        magic, docs, n, block, blocks, words = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        doc_ids = np.frombuffer(stream.read(8 * docs), "<i8")
        counts = np.frombuffer(stream.read(4 * docs), "<u4")
        starts = np.frombuffer(stream.read(4 * blocks), "<u4")
        yield doc_ids, counts, unpack(np.frombuffer(stream.read(8 * words), "<u8"), starts, n, block)


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, spaces_kept: bool = True, end: int = 0, files: int | None = None) -> list[tuple[int, str, int, int]]:
    """Encodes docs(doc_id, text) into files below folder, in ascending doc_id order; null text counts as empty.

    Returns (file number, path, documents, ids) of each file with documents, in order.
    Documents of one doc_id stay together, ordered by their text.
    """
    tokenizer = tokenizer or tokenizer_path(BYTE_BPE)
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, own = TaskContext.get(), encoder(tokenizer, spaces_kept)
        fs, base = pa.fs.FileSystem.from_uri(folder)
        number = context.partitionId()
        path, attempt = f"{base}/ids-{number:06d}.s8b", f"{base}/.{number:06d}-{context.taskAttemptId()}"
        out, held, n_docs, n_ids = None, [], 0, 0

        def close() -> None:
            nonlocal out
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(attempt)
            out.write(segment(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held.clear()

        for batch in batches:
            doc_ids = np.asarray(batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False))
            sizes = [max(1, n or 0) for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for lo, hi in passes(sizes):
                ids, counts = own.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()], end)
                held.append((doc_ids[lo:hi], counts, ids))
                n_docs, n_ids = n_docs + hi - lo, n_ids + len(ids)
                if sum(len(x[2]) for x in held) >= SEGMENT_IDS:
                    close()
        if held:
            close()
        if out is not None:
            out.close()
            fs.move(attempt, path)
            yield pa.RecordBatch.from_pylist([{"number": number, "path": path, "docs": n_docs, "ids": n_ids}])

    dealt = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(run, "number long, path string, docs long, ids long").collect()  # a row a file
    return sorted(tuple(r) for r in rows)


def read_files(spark: SparkSession, folder: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files, ids as little-endian unsigned 32-bit integers; one task a file."""
    starts = np.cumsum([0, *(f[3] for f in files)]).tolist()
    listed = spark.createDataFrame([(f[0], f[1], s) for f, s in zip(files, starts, strict=False)], "number long, path string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = row["start"]
                with fs.open_input_stream(row["path"]) as stream:
                    for doc_ids, counts, ids in read_segments(stream):
                        ends = np.cumsum(counts.astype(np.int64))
                        raw, cuts = pa.py_buffer(ids.astype("<u4").tobytes()), np.r_[0, 4 * ends].astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc_ids, pa.int64(), mask=doc_ids == -(1 << 63)),
                                pa.array(at + ends - counts),
                                pa.array(counts.astype(np.int64)),
                                pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts.tobytes()), raw]),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        at += len(ids)

    return listed.repartition(max(1, len(files)), F.col("number")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the ids of all documents and reads the files back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have their end id alone; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    files = write_files(docs, folder)
    return read_files(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
