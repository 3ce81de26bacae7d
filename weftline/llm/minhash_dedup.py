"""Near-duplicate documents by b-bit MinHash over word shingles.

Texts are lower-cased in A-Z and split at ASCII white space; a document's set holds the
hashes of its distinct word shingles (of all its words, where it has fewer). Documents
with one set form a class and go on as one. For each class, MINIMA minima are taken;
bands of ROWS minima are its buckets, and the lowest bits of every minimum are packed
into bit planes. Within a bucket, similarity is estimated from the planes by counting
bits, corrected for the chance that unequal minima agree in those bits; what passes with
a margin is confirmed on the full sets, and confirmed links are joined by a distributed
union-find.

At similarity 0.8 a pair misses all bands with probability below 1e-4, and less above.

Defined results: null, empty and blank texts have no shingle and link with nothing;
repeated rows are each given a row, and copies belong to one component; a null doc_id
links with nothing; an empty table gives no rows. Rows of one doc_id with other texts
have links of their own. Memory grows with the largest text: some 40 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import free_name, passes, written
from weftline.llm.linking import link, shared_buckets, sized

MINIMA, ROWS, KEPT_BITS = 128, 5, 4
BANDS = MINIMA // ROWS
#: Standard deviations of the estimate (about 0.037 at 0.8) that a candidate may lie below the threshold.
MARGIN = 0.17
_RNG = np.random.default_rng(90_210)
_MASKS = _RNG.integers(0, 1 << 64, MINIMA, np.uint64, endpoint=False)
_ODDS = _RNG.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = _RNG.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BAND_ODDS = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output (mod 2**64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, for i below n."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _UNBASE)):
            steps = np.full(max(n, 1 << 20), b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    parts = [(t or "").encode().translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    doc_end = np.cumsum(lens + 1)  # of the blank after each document
    blank = _BLANK[data]
    start = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    power, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])])
    word = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    cut = np.searchsorted(start, doc_end)
    out, lo = [], 0
    # a window's hash depends on the order of its words
    n = len(word)
    window = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words if len(window) else 0):
        window = mix(window * np.uint64(3) + word[k : n - words + 1 + k])
    for hi in cut.tolist():
        if hi - lo >= words:
            out.append(np.unique(window[lo : hi - words + 1]))
        elif hi > lo:
            h = np.full(1, hi - lo, np.uint64)
            for k in range(lo, hi):
                h = mix(h * np.uint64(5) + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
        lo = hi
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINIMA) minima; all sets must have members."""
    flat = np.concatenate(sets)
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    at = np.cumsum(lens) - lens
    out = np.empty((len(sets), MINIMA), np.uint64)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat((flat ^ _MASKS[k]) * _ODDS[k], at)
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys."""
    grouped = minima[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    return mix((grouped * _BAND_ODDS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def planes(minima: np.ndarray) -> np.ndarray:
    """(sets, KEPT_BITS * MINIMA / 64) packed planes: plane k holds bit k of what is kept of every minimum."""
    kept = (minima >> np.uint64(24)).astype(np.uint8)
    out = [np.packbits(kept >> k & 1, axis=1) for k in range(KEPT_BITS)]
    return np.ascontiguousarray(np.concatenate(out, axis=1)).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows of planes, corrected for chance agreement of unequal minima in the kept bits."""
    differ = a ^ b
    differ = np.bitwise_or.reduce(differ.reshape(len(differ), KEPT_BITS, -1), axis=1)
    agree = 1 - np.bitwise_count(differ).sum(axis=1) / MINIMA
    chance = 2.0**-KEPT_BITS
    return (agree - chance) / (1 - chance)


_SIGNED = "doc_id long, version long, n_shingles long, low long, high long, bands array<long>, packed binary, planes binary"


def sign(docs: DataFrame, words: int) -> DataFrame:
    """A row a document: set size, two sums that name its set, bucket keys (as an array, and packed) and planes (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [max(1, n or 0) for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for lo, hi in passes(sizes):
                sets = shingle_sets(batch.column(1).slice(lo, hi - lo).to_pylist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, packed, planed = ([None] * len(sets) for _ in range(3))
                if full:
                    minima = signatures([sets[i] for i in full])
                    for i, k, p in zip(full, bands(minima), planes(minima), strict=True):
                        keys[i], packed[i], planed[i] = k, k.tobytes(), p.tobytes()
                low, high = zip(*map(names, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(low, pa.int64()),
                        pa.array(high, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(packed, pa.binary()),
                        pa.array(planed, pa.binary()),
                    ],
                    names=[x.split()[0] for x in _SIGNED.split(", ")],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, _SIGNED)


def names(found: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set."""
    return int(found.sum(dtype=np.uint64).astype(np.int64)), int(mix(found + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, members): the sets of texts(text), named by their first sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [max(1, n or 0) for n in pa.compute.binary_length(batch.column(0)).to_pylist()]
            for lo, hi in passes(sizes):
                sets = shingle_sets(batch.column(0).slice(lo, hi - lo).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([pa.array([names(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])

    return texts.select("text").mapInArrow(run, "id long, members binary")


def similar(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether two sets share at least ``least`` per cent of their union."""
    if 100 * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= least * (len(x) + len(y) - both)


def _confirm_sets(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, x, y) whose full sets x and y share at least ``least`` per cent of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: What stands in front of an operator's own columns in the rows of blocks.
BLOCK_COLUMNS = ["key", "i", "j", "id", "slot", "component"]


def block_links(rows: DataFrame, own: list[str], linked) -> DataFrame:
    """Links (a, b) that join what the blocks of rows(*BLOCK_COLUMNS, *own) hold.

    linked(table) gives a function of row numbers a, b and the pairs' bucket keys that
    tells which pairs are links. Rows of a block lie together in a task, sorted; row r is
    compared with row r + d for every d that stays in its block, over all blocks at once.
    Rows that a link has joined are not compared again, so that of the links of a block
    no more come out than it has rows.
    """
    columns = [*BLOCK_COLUMNS, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, ids, slot, label = (table.column(k).to_numpy() for k in range(6))
            label, check = label.copy(), linked(table)
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            first = np.flatnonzero(new)
            last = np.repeat(np.r_[first[1:], len(ids)], np.diff(np.r_[first, len(ids)]))
            at, d = np.arange(len(ids)), 1
            while len(at := at[at + d < last[at]]):
                other = at + d
                ok = (label[at] != label[other]) & ((i[at] == j[at]) | (slot[at] != slot[other]))
                a, b = at[ok], other[ok]
                d += 1
                if not len(a):
                    continue
                good = check(a, b, key[a])
                out = []
                for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True):
                    if label[x] != label[y]:
                        label[label == label[y]] = label[x]
                        out.append((x, y))
                if out:
                    x, y = np.array(out).T
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["a", "b"])

        def of(batch: pa.RecordBatch, row: int) -> tuple:
            return tuple(batch.column(k)[row].as_py() for k in range(3))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and of(held[-1], held[-1].num_rows - 1) != of(batch, 0):
                yield from compare(pa.Table.from_batches(held))
                held = []
            # the last block of a batch may go on in the next
            key, i, j = (batch.column(k).to_numpy() for k in range(3))
            same = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            tail = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if tail:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held = []
            held.append(batch.slice(tail))
        if held:
            yield from compare(pa.Table.from_batches(held))

    dealt = rows.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInArrow(run, "a long, b long")


def _first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs of rows of keys meet in bucket key for the first time: the others are left to the bucket before."""
    return np.take_along_axis(keys[a], (keys[a] == keys[b]).argmax(axis=1)[:, None], axis=1)[:, 0] == key


def _binary(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of a column of binaries of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text).

    similarity is in per cent. component_id is the smallest doc_id that links reach.
    """
    component = _components(docs, words, similarity)
    out = component.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _components(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """doc_id, version, n_shingles, low, high and component (null for an empty set or a null doc_id) for every row of docs."""
    signed = written(sign(docs, words), "signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    named = ["n_shingles", "low", "high"]
    # a class is linked by the first sum that names its set, so that texts of one doc_id stay apart
    classes = written(full.groupBy(*named).agg(F.min("doc_id").alias("rep")), "classes")
    whole = full.join(classes, [full[c] == classes[c] for c in named] + [full.doc_id == classes.rep], "left_semi")
    reps = written(whole.select(F.col("low").alias("id"), "doc_id", "bands", "packed", "planes", "n_shingles").dropDuplicates(["id"]), "reps")
    least = similarity / 100 - MARGIN
    near = _near_planes(least)

    def sets(ids: DataFrame) -> DataFrame:
        """(id, members) of the sets of ids(id)."""
        ids = written(ids.distinct(), "wanted")
        wanted = written(reps.select("id", "doc_id").join(ids, "id").select("doc_id").distinct(), "wanted-docs")
        texts = docs.select("doc_id", "text").join(sized(wanted), "doc_id", "left_semi")
        return written(_sets(texts, words).dropDuplicates(["id"]).join(sized(ids), "id", "left_semi"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        sizes = reps.select("id", "planes", "n_shingles")
        both = pairs.join(sizes.toDF("a", "p", "m"), "a").join(sizes.toDF("b", "q", "n"), "b")
        both = both.filter(100 * F.least("m", "n") >= similarity * F.greatest("m", "n")).select("a", "b", "p", "q")
        likely = written(both.mapInArrow(near, "a long, b long"), "likely")
        found = sets(likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))))
        return _confirm_sets(likely.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b"), similarity)

    def linked_rows(table: pa.Table):
        codes, keys, members = _binary(table.column(6), np.uint64), _binary(table.column(7), np.int64), table.column(8).combine_chunks()

        def check(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
            good = np.zeros(len(a), bool)
            for at in np.array_split(np.arange(len(a)), len(a) // 65536 + 1):
                likely = at[estimate(codes[a[at]], codes[b[at]]) >= least]
                for k in likely[_first_shared(keys, a[likely], b[likely], key[likely])].tolist():
                    good[k] = similar(np.frombuffer(members[a[k]].as_buffer(), np.uint64), np.frombuffer(members[b[k]].as_buffer(), np.uint64), similarity)
            return good

        return check

    def compare(rows: DataFrame) -> DataFrame:
        info = reps.select("id", "planes", "packed").join(sets(rows.select("id")), "id")
        return block_links(rows.join(info, "id"), ["planes", "packed", "members"], linked_rows)

    members = reps.select(F.explode("bands").alias("key"), "id")
    linked = written(link(shared_buckets(members), confirm, compare, reps.select("id", F.col("n_shingles").alias("weight")), rounds=1), "linked")
    joined = classes.join(linked, classes.low == linked.id, "left").select(*named, "rep", F.coalesce("component", "low").alias("label"))
    joined = written(joined, "class-labels")
    least_id = joined.groupBy("label").agg(F.min("rep").alias("component"))
    found = written(joined.join(least_id, "label").select(*named, "component"), "class-components")
    out = signed.select("doc_id", "version", *named).join(found, named, "left")
    return out.withColumn("component", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")))


def _near_planes(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            mask = pa.array(estimate(p, q) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def keep_one(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of docs without those that repeat another document nearly: one row of each component stays, of the least doc_id.

    Rows without words, and those with a null doc_id, all stay.
    """
    version = free_name(docs, "version")
    found = _components(docs.select("doc_id", "text"), words, similarity).filter("component is not null")
    found = written(found.groupBy("doc_id", F.col("version").alias(version), "component").agg(F.count("doc_id").alias("n")), "versions")
    row = F.struct("doc_id", version)
    first = found.groupBy("component").agg(F.min(row).alias("first"))
    gone = written(found.join(first, "component").filter(row != F.col("first")).select("doc_id", version), "gone")
    kept = docs.withColumn(version, F.xxhash64("text")).join(gone, ["doc_id", version], "left_anti")
    twice = written(found.filter("n > 1").select("doc_id", version), "twice")
    if not twice.isEmpty():
        one = kept.join(twice, ["doc_id", version], "left_semi").dropDuplicates(["doc_id", version])
        kept = kept.join(twice, ["doc_id", version], "left_anti").unionByName(one)
    return kept.select(*docs.columns)
