"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Text is cut into words where no piece of the vocabulary can cross: before a run of
space marks, and around line feeds. Distinct words not seen before are encoded
together: all their symbols lie in one flat array; each round finds each word's best
pair rank by a segmented minimum, merges in all words at once, and compacts, until no
pair remains. Where a merge could give rise to a pair that ranks before further copies
of itself, a round merges only the leftmost copy in a word, as a queue would.

Defined results: null text counts as empty; empty text gives the begin and end ids
alone and decodes to the empty text; characters outside the vocabulary become their
UTF-8 bytes' pieces; the names of control pieces within a text are ordinary text.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import passes

MODEL = "piece_bpe_32k.model"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words that a worker remembers; beyond, it starts anew.
REMEMBERED = 800_000
SPACE = "▁"
_WORD = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_NO_RANK = np.iinfo(np.int32).max

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _PairTable:
    """Static map of symbol pairs to merged pieces: two hash tables and, for the few keys left, binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        for bits, odd in ((20, 0x9E3779B97F4A7C15), (18, 0xC2B2AE3D27D4EB4F)):
            slot = self._slot(keys, bits, odd)
            table_key = np.full(1 << bits, -1, np.int64)
            table_value = np.full(1 << bits, -1, np.int32)
            table_key[slot[::-1]] = keys[::-1]
            inside = table_key[slot] == keys
            table_value[slot[inside]] = values[inside]
            self.levels.append((bits, odd, table_key, table_value))
            keys, values = keys[~inside], values[~inside]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, odd: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int32)
        for bits, odd, table_key, table_value in self.levels:
            slot = self._slot(keys, bits, odd)
            np.copyto(found, table_value[slot], where=table_key[slot] == keys)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            np.copyto(found, self.values[at], where=self.keys[at] == keys)
        return found


class PieceCodec:
    """Encodes and decodes as the library does with the model at ``path``; merges are computed here, the model file gives pieces and scores."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        n = model.vocab_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.ids = ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        _, rank = np.unique([-model.get_score(i) for i in range(n)], return_inverse=True)
        self.rank = rank.astype(np.int32)
        left, right, whole = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(i)
        left, right, whole = (np.array(x, np.int64) for x in (left, right, whole))
        self.n, self.pairs = n, _PairTable(left * n + right, whole.astype(np.int32))
        #: Pieces that, once made, may at once form a pair ranked before or with their own.
        self.one_by_one = np.zeros(n, bool)
        for part in (left, right):
            self.one_by_one[part[self.rank[whole] <= self.rank[part]]] = True
        same = np.bincount(self.rank[list(ids.values())], minlength=n)
        self.one_by_one |= same[self.rank] > 1
        self.of_code = -1 - np.arange(1 << 16)
        for p, i in ids.items():
            if len(p) == 1 and ord(p) < 1 << 16:
                self.of_code[ord(p)] = i
        self.longest_run = max((len(p) for p in ids if set(p) == {SPACE}), default=1)
        raw = [b"" if special[i] and not model.is_byte(i) else bytes([int(p[3:5], 16)]) if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.word_at, self.word_len = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32)

    def words(self, text: str) -> list[str]:
        """Words of the text with its leading space mark; marks are written as spaces."""
        if not text:
            return []
        found = _WORD.findall(" " + text.replace(SPACE, " "))
        if " " * (4 * self.longest_run) in text.replace(SPACE, " "):
            found = [x for w in found for x in self._cut_run(w)]
        return found

    def _cut_run(self, word: str) -> list[str]:
        """A long run of spaces is merged from the left, in runs of the longest piece; the last ones stay with the word."""
        run = len(word) - len(word.lstrip(" "))
        k = max(0, run // self.longest_run - 2)
        return [" " * self.longest_run] * k + [word[k * self.longest_run :]]

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        text = "".join(words).replace(" ", SPACE)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sym = self.of_code[np.minimum(code, 0xFFFF)]
        for i in np.flatnonzero(code > 0xFFFF).tolist():
            sym[i] = self.ids.get(chr(code[i]), -1 - int(code[i]))
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done_sym, done_word, done_pos = [], [], []
        pos = np.arange(len(sym))
        while len(sym):
            # ranks of pairs within a word
            inner = (word[1:] == word[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0)
            at = np.flatnonzero(inner)
            made = self.pairs.find(sym[at] * self.n + sym[at + 1])
            at, made = at[made >= 0], made[made >= 0]
            if not len(at):
                done_sym.append(sym), done_word.append(word), done_pos.append(pos)
                break
            rank, owner = self.rank[made], word[at]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(at)]))
            keep = rank == best
            at, made, owner = at[keep], made[keep], owner[keep]
            first = np.r_[True, owner[1:] != owner[:-1]]
            # copies of one pair merge together, the overlapping ones of a run in turn from the left
            run = np.flatnonzero(first | (np.r_[0, np.diff(at)] != 1))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            keep = first | (~self.one_by_one[made] & (place % 2 == 0))
            at, made = at[keep], made[keep]
            sym[at] = made
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            # words without a pair in this round are finished
            active = np.zeros(len(words), bool)
            active[owner] = True
            finished = ~active[word]
            if finished.any():
                done_sym.append(sym[finished]), done_word.append(word[finished]), done_pos.append(pos[finished])
                stay &= ~finished
            sym, word, pos = sym[stay], word[stay], pos[stay]
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        sym, word, pos = (np.concatenate(x) for x in (done_sym, done_word, done_pos))
        order = np.argsort(pos, kind="stable")
        sym, word = sym[order], word[order]
        counts = np.ones(len(sym), np.int64)
        odd = np.flatnonzero(sym < 0)
        if len(odd):
            as_bytes = [chr(-1 - s).encode("utf-8", "replace") for s in sym[odd].tolist()]
            counts[odd] = [len(b) for b in as_bytes]
            out = np.repeat(sym, counts)
            start = (np.cumsum(counts) - counts)[odd]
            for s, b in zip(start.tolist(), as_bytes, strict=True):
                out[s : s + len(b)] = self.byte_ids[np.frombuffer(b, np.uint8)]
            word = np.repeat(word, counts)
            sym = out
        return sym.astype(np.int32), np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        flat, lens = self.merge_rounds(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        k = len(self.known)
        while k + len(words) > len(self.word_at):
            self.word_at = np.concatenate([self.word_at, np.empty_like(self.word_at)])
            self.word_len = np.concatenate([self.word_len, np.empty_like(self.word_len)])
        self.word_at[k : k + len(words)] = self.used + np.cumsum(lens) - lens
        self.word_len[k : k + len(words)] = lens
        self.used += len(flat)
        self.known.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end ids."""
        if len(self.known) > REMEMBERED:
            self._forget()
        by_text = [self.words(t) for t in texts]
        every = list(chain.from_iterable(by_text))
        at = list(map(self.known.get, every))
        if None in at:
            self._learn(list(dict.fromkeys(w for w, a in zip(every, at, strict=True) if a is None)))
            at = list(map(self.known.get, every))
        at = np.array(at, np.int64)
        lens = self.word_len[at].astype(np.int64)
        ids = self.flat[_ranges(self.word_at[at], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *map(len, by_text)])]
        return [np.concatenate([[self.bos], ids[a:b], [self.eos]]).astype("<u4") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces' bytes joined, the leading space mark dropped, control pieces silent, each broken byte U+FFFD."""
        ids = np.asarray(ids, np.int64)
        raw = self.raw[_ranges(self.raw_at[ids], self.raw_len[ids])].tobytes()
        seen = ids[self.raw_len[ids] > 0]
        if len(seen) and raw[:1] == b" " and seen[0] != self.byte_ids[32]:
            raw = raw[1:]
        return raw.decode("utf-8", "each_byte")


def _ranges(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (lens[0] of them), start[1], ..."""
    total = int(lens.sum())
    shift = start - (np.cumsum(lens) - lens)
    return np.repeat(shift, lens) + np.arange(total)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's own codec, made once and kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_column(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encodes ``text`` of docs(doc_id, text) and decodes it again; one row out for each row in.

    Columns: doc_id, n_tokens, ids_sha256 and decoded_sha256, with keep_ids also ids
    (little-endian unsigned 32-bit) and decoded. Null text counts as empty.
    """
    path = path or model_path()
    schema = SCHEMA + (", ids binary, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            doc_ids, column = batch.column(0), batch.column(1)
            sizes = [max(1, n or 0) for n in pa.compute.binary_length(column).to_pylist()]
            for lo, hi in passes(sizes):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                all_ids = own.encode(texts)
                raw = [x.tobytes() for x in all_ids]
                decoded = [own.decode(x) for x in all_ids]
                out = [
                    doc_ids.slice(lo, hi - lo),
                    pa.array([len(x) for x in all_ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                if keep_ids:
                    out += [pa.array(raw, pa.binary()), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
