import random

import pytest
from tokenizers import Tokenizer

from weftline.llm.word_tokens import BYTE_BPE, WORD_BPE, encoder, tokenizer_path

BITS = ["a", "The", " ", "  ", "\n", "\n\n", "é", "日本", "123", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", "text|>", "'s"]


@pytest.mark.parametrize(("name", "kept"), [(BYTE_BPE, True), (WORD_BPE, False)])
def test_ids_are_those_of_the_unmodified_library(name, kept):
    """The encoder of op4_token_files and op8_packing against the library with the file alone."""
    own, library = encoder(tokenizer_path(name), kept), Tokenizer.from_file(tokenizer_path(name))
    rnd = random.Random(8)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y"] + ["".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 20))) for _ in range(1500)]
    ids, counts = own.encode(texts, 7)
    want = [e.ids + [7] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_encoders_are_freed_for_operators_without_them():
    from weftline.llm import common, word_tokens

    path = word_tokens.tokenizer_path(word_tokens.WORD_BPE)
    first = word_tokens.encoder(path, False)
    ids = first.encode(["a line of text", ""], 2)
    common.encoders_freed()
    assert not word_tokens._OPEN
    again = word_tokens.encoder(path, False)
    assert again is not first and all((x == y).all() for x, y in zip(ids, again.encode(["a line of text", ""], 2), strict=True))
