import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from weftline.llm.piece_codec import PieceCodec, encode_column, model_path

BITS = ["a", "b", "th", "e", " ", "  ", "\n", "é", "é", "ﬁ", "▁", "\t", "\xa0", "😀", "<s>", "<0x41>", "ing", "日本", "\x00", "==", "--", " " * 17]


@pytest.fixture(scope="module")
def both():
    return PieceCodec(), sentencepiece.SentencePieceProcessor(model_file=model_path())


def texts():
    rnd = random.Random(7)
    yield from ("", " ", "▁", "a" * 3000, "ab" * 2000, "=" * 777, "\n" * 50, "<0x20>", "\n a", "日 x", "a" + " " * 500 + "b")
    yield from (" " * k + tail for k in range(60, 120) for tail in ("", "ab"))
    for _ in range(1500):
        yield "".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 40)))


def test_same_ids_and_text_as_the_library(both):
    own, library = both
    every = list(texts())
    for lo in range(0, len(every), 100):
        for text, ids in zip(every[lo : lo + 100], own.encode(every[lo : lo + 100]), strict=True):
            want = library.encode(text, add_bos=True, add_eos=True)
            assert ids.tolist() == want, text[:60]
            assert own.decode(ids) == library.decode(want), text[:60]


def test_broken_bytes_decode_like_the_library(both):
    own, library = both
    for ids in ([1, 2], [5, 200, 201, 300], [231, 300], [300, 231, 175, 300], [35, 300], [1, 29871, 29871, 300, 2]):
        assert own.decode(ids) == library.decode(ids)


def test_column_keeps_every_row(spark):
    rows = [(1, None), (2, ""), (3, "A word"), (3, "A word"), (4, "x" * 70_000)]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, n_tokens string, ids int")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded, np.frombuffer(r.ids, "<u4").tolist()) for r in encode_column(docs, keep_ids=True).collect())
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t or "", ids))
    assert got == sorted(want)
    assert encode_column(docs.limit(0)).count() == 0
