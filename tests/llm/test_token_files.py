import gc
import io
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm.token_files import crc32, pack, read_segments, round_trip, segment, unpack
from weftline.llm.word_tokens import BYTE_BPE, WORD_BPE, WordTokens, tokenizer_path

BITS = ["a", "The", "ing", " ", " ", "  ", "\n", "\n\n", " \n", "é", "é", "\t", "\xa0", "😀", "<|endoftext|>", "'s", "'LL", "123", "日本", "\x00", "--", "İ", "Σ", "　", "Straße", "ÑANDÚ,", "l'été", "x²", "½", "\xad", "a_b", "Ǆ"]


@pytest.mark.parametrize("high", [1, 2, 300, 1 << 15, 50_257, 1 << 30, 1 << 60, 1 << 63])
@pytest.mark.parametrize("n", [0, 1, 7, 255, 256, 257, 5000])
def test_ids_come_back(high, n):
    rnd = random.Random(n)
    ids = np.array([rnd.randrange(high) if rnd.random() < 0.7 else rnd.randrange(2) for _ in range(n)], np.uint64)
    words, starts = pack(ids)
    assert unpack(words, starts, n).tolist() == ids.tolist()


def test_runs_are_short():
    words, _ = pack(np.zeros(240 * 16, np.uint64))
    assert len(words) == 2 * 15  # a block of 256: one word of 240, one of the rest
    words, _ = pack(np.full(256, 30_000, np.uint64))
    assert len(words) == 64


def test_segments_follow_each_other():
    parts = [(np.array([1, 2]), np.array([3, 1]), np.array([5, 6, 7, 0])), (np.array([9]), np.array([2]), np.array([70_000, 1 << 61]))]
    stream = io.BytesIO(b"".join(segment(*p) for p in parts))
    got = list(read_segments(stream))
    assert [[x.tolist() for x in g] for g in got] == [[x.tolist() for x in p] for p in parts]
    with pytest.raises(ValueError):
        list(read_segments(io.BytesIO(b"x" * 60)))


@pytest.mark.parametrize(("name", "kept"), [(BYTE_BPE, True), (WORD_BPE, False)])
def test_stretches_have_the_ids_of_whole_texts(name, kept):
    own, library = WordTokens(tokenizer_path(name), kept), Tokenizer.from_file(tokenizer_path(name))
    library.encode_special_tokens = True
    rnd = random.Random(3)
    texts = ["", " ", "\n", "a b", " a", "a ", "x" * 5000] + ["".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 25))) for _ in range(3000)]
    for lo in range(0, len(texts), 150):
        part = texts[lo : lo + 150]
        ids, counts = own.encode(part, 7)
        want = [e.ids + [7] for e in library.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_runs_of_white_space_are_cut_as_the_library_cuts_them():
    """Every white-space character, and the separators that are none, in runs between words: blank and indented lines above all."""
    own, library = WordTokens(tokenizer_path(BYTE_BPE), True), Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    white = [chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
    bits = white + ["\x1c", "\x1f", "\u180e", "\u200b", "\ufeff", " ", " ", "\n", "\n", "  ", "\n\n", "\n    ", "word", "'s", "é!", "12", "日本"]
    rnd = random.Random(11)
    texts = [a + b + c for a in white for b in white for c in ("", "x", "!")] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(6000)]
    ids, counts = own.encode(texts, 7)
    want = [e.ids + [7] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert own.stretches("A b.\n\n    c d\n") == ["A", " b.", "\n\n   ", " c", " d", "\n"]


def test_round_trip_of_a_table(spark):
    texts = {5: "A b.\nC", 3: None, 4: "", 9: "word " * 30_000, 1: "The end"}
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts.items()], "doc_id long, text string, ids int, start string").repartition(3)
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    want, at = [], 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert crc32(np.array(ids)) == want[-1][3]
        at += len(ids)
    assert sorted(tuple(r) for r in round_trip(docs).collect()) == want
    assert round_trip(docs.limit(0)).count() == 0


def test_a_stretch_takes_little_memory():
    """What a worker remembers of 60,000 different words, in bytes a word: 237 when texts and ids were held by dictionaries of strings."""
    rnd = random.Random(17)
    words = sorted({"".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(6, 12))) for _ in range(60_000)})
    own = WordTokens(tokenizer_path(WORD_BPE), False)
    own.encode(["warm up"], 7)
    tracemalloc.start()
    own.encode([" ".join(words)], 7)
    gc.collect()
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 100 * len(words)


def test_regular_texts_are_cut_all_at_once():
    """A text without runs of white space costs no string a stretch: only those not met before are cut out one by one."""
    own, library = WordTokens(tokenizer_path(BYTE_BPE), True), Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    texts = ["Two words, \u00e9t\u00e9's 12.\nA line", "", " a ", "x\x00 x " + "y" * 40]
    own.stretches = None  # the cut of one text
    ids, counts = own.encode(texts, 7)
    want = [e.ids + [7] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_other_white_space_before_a_space():
    own, library = WordTokens(tokenizer_path(BYTE_BPE), True), Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    texts = [" \u65e5\u672c\u8a9e \xa0 \xa0", "a\xa0 \xa0 \xa0 b", "a\t \t \t", "a\xa0\n", "a\xa0 b \xa0c"]
    ids, _ = own.encode(texts, 7)
    assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in (*e.ids, 7)]
