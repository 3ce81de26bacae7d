import hashlib
import os
import random
import zlib

import numpy as np

from weftline.llm import media_chunks as m


def test_hash_looks_at_32_bytes_only():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 500, np.uint8)
    whole = m.gear_hashes(data)
    for i in (31, 40, 499):
        value = 0
        for b in data[i - 31 : i + 1]:
            value = ((value << 1) + int(m._GEAR[b])) & 0xFFFFFFFF
        assert whole[i] == value


def test_chunks_cover_payloads_and_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 256, 60_000, np.uint8).tobytes()
    payloads = [body, b"xyz" * 100 + body, b"", b"q" * 100_000, body[:192]]
    ends = m.chunk_payloads(payloads)
    for payload, e in zip(payloads, ends, strict=True):
        assert e[-1] == len(payload) and e == sorted(set(e))
        sizes = np.diff([0, *e])
        assert all(s <= m.GREATEST for s in sizes) and all(s >= m.LEAST for s in sizes[:-1])
    assert ends == [m.chunk_payloads([p])[0] for p in payloads]  # neighbours don't matter
    names = [{m.digest(p[a:b]) for a, b in zip([0, *e], e, strict=False)} for p, e in zip(payloads[:2], ends[:2], strict=True)]
    assert len(names[0] & names[1]) > 0.8 * len(names[0])  # an insertion moves few cuts


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(m, "PACK_BYTES", 20_000)
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh \n") for _ in range(9000))
    texts = [None, "", "short", base, base, base + "tail", "é" * 70_000, "x" * 192] + [base] * 40
    rows = [(i // 2 if i < 4 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, b"z", 3) for i, t in rows], "doc_id long, text string, digest binary, pos int").repartition(4)
    got = m.round_trip(docs).collect()
    assert sorted((r.doc_id, r.payload_sha256) for r in got) == sorted((i, hashlib.sha256(m.padded(t)).hexdigest()) for i, t in rows)
    by_payload = {}
    for r in got:
        assert r.verified and r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes)
        by_payload.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature, r.tail_crc32))
    assert all(len(v) == 1 for v in by_payload.values())
    assert {r.tail_crc32 for r in got if r.n_bytes == 0} == {zlib.crc32(b" " * 16)}
    assert m.round_trip(docs.limit(0)).count() == 0


def test_each_chunk_is_stored_once(spark, monkeypatch, tmp_path):
    """Copies in several tasks and packs: the files hold each distinct chunk once, and all payloads come back."""
    monkeypatch.setattr(m, "PACK_BYTES", 20_000)
    rnd = random.Random(9)
    bases = ["".join(rnd.choice("abcdefgh \n") for _ in range(rnd.randint(100, 30_000))) for _ in range(12)]
    texts = [rnd.choice(bases) + rnd.choice(["", "tail"]) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    folder = str(tmp_path / "packs")
    chunks = m.written(m.store(docs, folder), "chunks")

    def on_disk():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if not f.endswith(".crc"))

    before = on_disk()
    stored = m.written(m.canonical(chunks, folder), "stored")
    places = {}
    for r in stored.collect():
        places.setdefault(bytes(r.digest), set()).add((r.pack, r.offset, r.stored))
    assert all(len(p) == 1 for p in places.values())
    assert on_disk() == sum(n for p in places.values() for _, _, n in p) < before
    got = m.load(stored, folder).collect()
    assert all(r.verified for r in got)
    assert sorted((r.doc_id, r.payload_sha256) for r in got) == [(i, hashlib.sha256(m.padded(t)).hexdigest()) for i, t in enumerate(texts)]
