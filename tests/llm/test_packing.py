import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import packing
from weftline.llm.word_tokens import WORD_BPE, tokenizer_path


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 1365, 1366, 2047, 2048, 2049, 4095, 4096, 4097, 50_001])
def test_pieces_cover_a_document(n):
    pieces = packing.cut(n)
    assert sum(length for length, _ in pieces) == n
    for length, kind in pieces:
        assert 0 < length <= 4096
        if kind:
            assert length * kind <= 4096 and length >= packing.TIGHT * (4096 // kind)
        else:
            assert length < 64


def test_bins_close_with_their_count():
    bins = packing.Bins(100)
    assert bins.add(3, ("a",), 33) == [] and bins.add(3, ("b",), 30) == []
    assert bins.add(3, ("c",), 31) == [(("a",), 0, 0), (("b",), 0, 33), (("c",), 0, 63)]
    assert list(bins.rest()) == []
    assert bins.add(0, ("d",), 60) == [] and bins.add(0, ("e",), 50) == [(("d",), 1, 0)]
    assert list(bins.rest()) == [(0, ("e",))]


def check(rows, texts, room=4096):
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= room
    return by_sequence


def test_table_is_packed_tightly(spark):
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choice(["alpha", "of", "the", "Beta,", "x"]) for _ in range(rnd.choice([3, 50, 700, 3000]))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "word " * 20_000}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, length string").repartition(5)
    rows = packing.pack(docs).collect()
    found = check(rows, texts)
    used = sum(r.length for r in rows)
    assert used / (4096 * len(found)) > 0.97
    assert packing.pack(docs.limit(0)).count() == 0


def test_tree_of_leftovers(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    texts = {i: "one two three " * (i % 90) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9)
    found = check(packing.pack(docs).collect(), texts)
    assert len(found) < 10


def test_sequences_are_padded(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d " * 5000)], "doc_id long, text string")
    pieces = packing.pack(docs, keep_ids=True)
    out = packing.sequences(pieces, pad=9).collect()
    assert all(len(r.ids) == 4 * 4096 or r.used & (r.used - 1) == 0 and len(r.ids) == 4 * r.used for r in out)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4")[: r.used] for r in out])
    assert len(ids) == sum(r.length for r in pieces.collect())
