"""Media columns kept as deduplicated content-defined chunks.

A payload is cut where a rolling gear hash over its last 32 bytes has its upper bits
zero, between a least and a greatest chunk length. Chunks go into pack files in the
shared folder, compressed one by one; a task writes a chunk once a pack. The digests of
all tasks then elect one place for each chunk, a join gives it to all copies, and packs
with chunks that were not elected are written anew without them, so that each chunk is
stored once. The stored form of a payload is its recipe (its length and the ordered list of its chunks'
lengths and digests) followed by its chunks as stored. Reading back walks the recipes:
each chunk is fetched from its canonical place by pack and offset and checked against
its digest, and the payload against its own. Payload bytes never pass through a shuffle;
only digests and places do.

A pack is written under the name of its attempt, and only places reported by a task
that ended well are ever read, so lost tasks leave nothing but unused files. A pack is
deleted only when the places of what it held elsewhere are written.

Defined results: a null payload counts as empty and still gets its padding; equal
payloads have equal stored forms; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import new_folder, passes, written

#: Least and greatest bytes of a chunk, and bits that must be zero at a cut.
LEAST, GREATEST, CUT_BITS = 512, 16_384, 11
#: Payload lengths are a multiple of this many bytes, by padding with byte 32.
UNIT = 192
#: Bytes after which a pack file is closed, and packs that a reader holds at once.
PACK_BYTES, PACKS_HELD = 8 << 20, 4
#: Parts in which packs are written anew, and below the packs' folder the one for those: only a part is stored twice at a time.
WAVES, ANEW = 4, "anew"
DIGEST = 16
_RECIPE = struct.Struct("<4sQI")
_GEAR = (np.random.default_rng(20_240_607).integers(0, 1 << 32, 256, np.uint64)).astype(np.uint32)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at each byte: the sum of the last 32 bytes' values, each shifted left by its age (mod 2**32)."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def cuts(candidates: np.ndarray, n: int) -> list[int]:
    """Ends of the chunks of n bytes, given where the hash allows a cut (ends, ascending)."""
    ends, at, k, allowed = [], 0, 0, candidates.tolist()
    while n - at > LEAST:
        while k < len(allowed) and allowed[k] < at + LEAST:
            k += 1
        end = min(n, at + GREATEST, allowed[k] if k < len(allowed) else n)
        ends.append(end)
        at = end
    if at < n or not ends:
        ends.append(n)
    return ends


def chunk_payloads(payloads: list[bytes]) -> list[list[int]]:
    """Chunk ends of each payload. No hash before byte 32 of a payload counts, so neighbours in memory don't matter."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    if not len(data):
        return [[0] for _ in payloads]
    at = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    lens = np.fromiter(map(len, payloads), np.int64, len(payloads))
    start = np.cumsum(lens) - lens
    lo, hi = np.searchsorted(at, start + 32), np.searchsorted(at, start + lens, side="right")
    return [cuts(at[a:b] - s, n) for a, b, s, n in zip(lo, hi, start.tolist(), lens.tolist(), strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def recipe(n: int, lens: list[int], digests: list[bytes]) -> bytes:
    return _RECIPE.pack(b"WLCR", n, len(lens)) + b"".join(struct.pack("<I", k) + d for k, d in zip(lens, digests, strict=True))


_CHUNKS = "doc_id long, doc_key string, pos int, last int, n_bytes long, sha256 string, digest binary, length int, home string, pack string, offset long, stored int"


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Cuts the padded UTF-8 texts of docs(doc_id, text), writes packs below folder; a row for each chunk of each document.

    doc_key tells documents with one doc_id apart. home is the pack open when the
    document was met; pack, offset and stored say where this task's copy of the chunk lies.
    """
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        known: dict[bytes, tuple[str, int, int]] = {}
        number, out, pack, at, met = 0, None, "", 0, 0
        for batch in batches:
            sizes = [max(1, n or 0) for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for lo, hi in passes(sizes):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                payloads = [padded(t) for t in texts]
                rows = []
                for doc_id, text, payload, ends in zip(ids, texts, payloads, chunk_payloads(payloads), strict=True):
                    if out is None or at >= PACK_BYTES:
                        if out is not None:
                            out.close()
                        # chunks of closed packs are forgotten with them: the joins find their copies
                        known.clear()
                        pack, at, number = f"{context.partitionId():06d}-{context.taskAttemptId()}-{number:05d}", 0, number + 1
                        out = fs.open_output_stream(f"{base}/{pack}")
                    home, key, begin, whole = pack, f"{context.partitionId()}-{met}", 0, hashlib.sha256(payload).hexdigest()
                    met += 1
                    n_bytes = len((text or "").encode())
                    for pos, end in enumerate(ends):
                        chunk = payload[begin:end]
                        name = digest(chunk)
                        if name not in known:
                            packed = squeeze(chunk)
                            out.write(packed)
                            known[name] = (pack, at, len(packed))
                            at += len(packed)
                        rows.append((doc_id, key, pos, len(ends) - 1, n_bytes, whole, name, end - begin, home, *known[name]))
                        begin = end
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _CHUNKS.split(", ")])
        if out is not None:
            out.close()

    return docs.select("doc_id", "text").mapInArrow(run, _CHUNKS)


def canonical(chunks: DataFrame, folder: str) -> DataFrame:
    """Stores every chunk once, at the least place that any copy of it has, and gives that place to all its rows.

    Copies are counted before they meet (a row a digest and task); both sides of the join
    by digest can be split where one digest has very many rows.
    """
    place = F.struct("pack", "offset", "stored")
    elected = written(chunks.groupBy("digest").agg(F.min(place).alias("p")).select("digest", "p.*"), "chunk-places")
    sizes = chunks.groupBy("pack").agg(F.max(F.col("offset") + F.col("stored")).alias("size"))
    live = elected.groupBy("pack").agg(F.sum("stored").alias("live"))
    mixed = written(sizes.join(live, "pack", "left").filter("live is null or live < size").select("pack"), "mixed-packs")
    places = elected.join(mixed, "pack", "left_anti")
    for wave in range(WAVES):
        now = mixed.filter(F.pmod(F.xxhash64("pack"), F.lit(WAVES)) == wave)
        moved = written(_anew(elected.join(now, "pack", "left_semi"), folder), "moved-chunks")
        _delete(now, folder)
        places = places.unionByName(moved)
    return chunks.drop("pack", "offset", "stored").join(places, "digest").select(chunks.columns)


_PLACES = "digest binary, pack string, offset long, stored int"


def _anew(places: DataFrame, folder: str) -> DataFrame:
    """Copies the chunks at the places into new packs, one for each old pack; their new places. A task run again writes the same bytes."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/{ANEW}", recursive=True)
        attempt, pack, whole, parts = TaskContext.get().taskAttemptId(), None, b"", []

        def close() -> None:
            if pack is not None:
                with fs.open_output_stream(f"{base}/{ANEW}/.{pack}-{attempt}") as f:
                    f.write(b"".join(parts))
                fs.move(f"{base}/{ANEW}/.{pack}-{attempt}", f"{base}/{ANEW}/{pack}")
                parts.clear()

        at = 0
        for batch in batches:
            offsets = []
            for old, offset, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if old != pack:
                    close()
                    pack, at = old, 0
                    with fs.open_input_stream(f"{base}/{old}") as f:
                        whole = f.read()
                parts.append(whole[offset : offset + n])
                offsets.append(at)
                at += n
            packs = pa.array([f"{ANEW}/{p}" for p in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), packs, pa.array(offsets, pa.int64()), batch.column(3)], names=["digest", "pack", "offset", "stored"])
        close()

    dealt = places.select("digest", "pack", "offset", "stored").repartition("pack").sortWithinPartitions("pack", "offset")
    return dealt.mapInArrow(run, _PLACES)


def _delete(packs: DataFrame, folder: str) -> None:
    """Deletes the packs; one that is gone already is no error, so that a task can run again."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for pack in batch.column(0).to_pylist():
                if fs.get_file_info(f"{base}/{pack}").type != pa.fs.FileType.NotFound:
                    fs.delete_file(f"{base}/{pack}")
            yield batch

    packs.select("pack").mapInArrow(run, "pack string").count()


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int, verified boolean"


class _Packs:
    """Pack files held by a reader, the least recently used one dropped first; a foreign chunk is read by its range alone."""

    def __init__(self, folder: str):
        self.fs, self.base = pa.fs.FileSystem.from_uri(folder)
        self.held: OrderedDict[str, bytes] = OrderedDict()
        self.few: OrderedDict[tuple[str, int], bytes] = OrderedDict()

    def whole(self, pack: str) -> bytes:
        if pack not in self.held:
            with self.fs.open_input_stream(f"{self.base}/{pack}") as f:
                self.held[pack] = f.read()
            while len(self.held) > PACKS_HELD:
                self.held.popitem(last=False)
        return self.held[pack]

    def get(self, pack: str, offset: int, n: int, home: str) -> bytes:
        if pack in (home, f"{ANEW}/{home}") or pack in self.held:
            return self.whole(pack)[offset : offset + n]
        if (pack, offset) not in self.few:
            with self.fs.open_input_file(f"{self.base}/{pack}") as f:
                self.few[pack, offset] = f.read_at(n, offset)
            while len(self.few) > 4096:
                self.few.popitem(last=False)
        return self.few[pack, offset]


def features(payload: bytes, lens: list[int]) -> str:
    """Mean and entropy of the samples, share of samples over 127, and chunk count, as text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float(counts @ np.arange(256)) / len(payload)
    return f"mean={mean:.4f};entropy={-float(share @ np.log2(share)):.4f};high={counts[128:].sum() / len(payload):.4f};chunks={len(lens)}"


def load(chunks: DataFrame, folder: str) -> DataFrame:
    """Rebuilds and verifies each document's payload from its chunk rows; columns of _READ.

    Rows of one home pack meet in one task, in order; a pack is of bounded size.
    """
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        packs, rows = _Packs(folder), []
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                if row[2] < row[3]:
                    continue
                parts, stored, good = [], [], True
                for _, _, _, _, _, _, name, length, home, pack, offset, n in rows:
                    raw = packs.get(pack, offset, n, home)
                    part = expand(raw, max_output_size=length)
                    good &= digest(part) == name and len(part) == length
                    parts.append(part), stored.append(raw)
                doc_id, n_bytes, sha = rows[0][0], rows[0][4], rows[0][5]
                payload, lens = b"".join(parts), [r[7] for r in rows]
                got = hashlib.sha256(payload).hexdigest()
                media = recipe(len(payload), lens, [r[6] for r in rows]) + b"".join(stored)
                done.append((doc_id, n_bytes, len(payload), got, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, lens), len(lens), good and got == sha))
                rows = []
            if done:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    order = [x.split()[0] for x in _CHUNKS.split(", ")]
    dealt = chunks.select(*order).repartition("home").sortWithinPartitions("home", "doc_key", "pos")
    return dealt.mapInArrow(run, _READ)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores the texts of docs as media, deduplicates their chunks, and reads every payload back."""
    folder = new_folder(docs.sparkSession, "media-packs")
    chunks = written(store(docs, folder), "media-chunks")
    return load(canonical(chunks, folder), folder)
