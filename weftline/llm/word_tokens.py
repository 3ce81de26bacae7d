"""Ids of the ``tokenizers`` library for whole texts, each distinct stretch of text encoded once a worker.

Pre-tokenisation of the two supported vocabularies never joins characters across the
cuts made here, so the ids of a text are its stretches' ids one after another. Where
white space is part of tokens, a run of it gives its last character to what follows (as
one stretch if that is a space, as a stretch of its own if not) and is a stretch without
it; where it is dropped, texts are cut at every space and line feed. A text that holds
an added token's string goes to the library whole. A stretch of plain letters, digits and
signs is cut into words by the pre-tokeniser's own pattern, and a word not met before goes
to the library's model; any other stretch goes through all of the library's steps.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import regex

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Stretches that a worker remembers; beyond, it starts anew.
REMEMBERED = 1_200_000
#: Neighbours that make a run of white space; so does other white space after a line feed, or before that or a space.
_RUNS = ("  ", " \n", "\n ", "\n\n")
_RUN_AFTER = re.compile(r"[^\S ](?:(?<=\n)[^\S \n]|(?<!\n)[ \n])")
#: White space as Unicode defines it, inside a character class.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches of characters that normalisation keeps (but for case) and that both sides class alike: letters, signs and digits below U+0250.
_PLAIN = re.compile(r" ?[!-~\xa1-\u012f\u0131-\u024f]+")
_SPACED = re.compile(r" ?[^ \n]+|\n| ")
_WITH_RUNS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
_DROPPED = re.compile(r"[^ \n]+")
#: The commonest stretches that are one word.
_LETTERS = re.compile(r" ?[A-Za-z]+")

# The pre-tokenisers' patterns, as in the tokenizer files
_KEPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_DROPPED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Line feeds stand between words here.
_BYTE_LETTERS = _byte_letters() | {10: "\n"}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Odd numbers that mix the bits of a key; and masks of the first n of eight bytes
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class _Numbers:
    """Numbers stretches of bytes in the order in which they are first asked for.

    A stretch of at most 16 bytes is held as two whole numbers in a hash table of numpy arrays, which takes a fraction of
    the memory of a dictionary of strings and is asked for all stretches of a pass at once; longer ones are in a dictionary.
    """

    def __init__(self) -> None:
        self.count, self.long = 0, {}
        self.low, self.high = np.empty(1 << 15, np.uint64), np.empty(1 << 15, np.uint64)
        self.slots = np.full(1 << 16, -1, np.int32)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low * _MIX[0]) ^ ((high + _MIX[2]) * _MIX[1])
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[2]
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _found(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for those that have none."""
        at = self._home(low, high)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            now = self.slots[at]
            out[left] = now
            more = (now >= 0) & ((self.low[now] != low[left]) | (self.high[now] != high[left]))
            left, at = left[more], at[more]
        return out

    def _settle(self, numbers: np.ndarray) -> None:
        """Gives distinct keys that have none a slot each."""
        at = self._home(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            out = self.slots[at] != numbers
            numbers, at = numbers[out], (at[out] + 1) & (len(self.slots) - 1)

    def _room(self, more: int) -> None:
        while self.count + more > len(self.low):
            self.low, self.high = (np.concatenate([x, np.empty_like(x)]) for x in (self.low, self.high))
        size = len(self.slots)
        while 5 * (self.count + more) > 3 * size:
            size *= 2
        if size > len(self.slots):
            held = self.slots[self.slots >= 0]
            self.slots = np.full(size, -1, np.int32)
            self._settle(held)

    def ask(self, data: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of data, behind which 16 bytes stand that belong to none; and where those that had none before are first, by number."""
        every = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low, high = every[starts] & _FIRST[np.minimum(lens, 8)], every[starts + 8] & _FIRST[np.clip(lens - 8, 0, 8)]
        short = lens <= 16
        zeros = np.flatnonzero(np.frombuffer(data, np.uint8)[:-16] == 0)
        if len(zeros):  # as the bytes beyond a stretch are taken for zeros
            short &= np.searchsorted(zeros, starts) == np.searchsorted(zeros, starts + lens)
        mine = np.flatnonzero(short)
        if len(mine) < len(starts):
            low, high = low[mine], high[mine]
        found = self._found(low, high)
        unmet, fresh = np.flatnonzero(found < 0), []
        if len(unmet):
            order = unmet[np.lexsort((high[unmet], low[unmet]))]
            low, high = low[order], high[order]
            new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
            found[order] = self.count + np.cumsum(new) - 1
            fresh = mine[order[new]].tolist()
            self._room(len(fresh))
            self.low[self.count : self.count + len(fresh)], self.high[self.count : self.count + len(fresh)] = low[new], high[new]
            self._settle(np.arange(self.count, self.count + len(fresh), dtype=np.int32))
            self.count += len(fresh)
        numbers = np.empty(len(starts), np.int64)
        numbers[mine] = found
        for i in np.flatnonzero(~short).tolist():
            key = data[starts[i] : starts[i] + lens[i]]
            if key not in self.long:
                self._room(1)
                self.long[key] = self.count
                self.count += 1
                fresh.append(i)
            numbers[i] = self.long[key]
        return numbers, np.array(fresh, np.int64)


class _Ids:
    """Ids of numbered stretches, in one array."""

    def __init__(self) -> None:
        self.known = _Numbers()
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.at, self.len = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)

    def put(self, numbers: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.known.count > len(self.at):
            self.at, self.len = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.len))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[numbers] = self.used + np.cumsum(lens) - lens
        self.len[numbers] = lens
        self.used += len(flat)

    def put_lists(self, numbers: np.ndarray, lists: list[list[int]]) -> None:
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        self.put(numbers, np.fromiter(chain.from_iterable(lists), np.int32, int(lens.sum())), lens)

    def take(self, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The lens[i] ids from at[i] on, one after another."""
        place = np.cumsum(lens) - lens
        return self.flat[np.repeat(at - place, lens) + np.arange(int(lens.sum()))]


class WordTokens:
    """Encoder for one tokenizer file; ``spaces_kept`` says whether white space is part of its tokens (byte-level) or dropped.

    With ``added``, as the library does by itself, the string of an added token in a text is that token; without, it is text like any other.
    """

    def __init__(self, path: str, spaces_kept: bool, added: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()] if added else []
        self.model = self.library.model
        self.spaces_kept = spaces_kept
        self.pattern = regex.compile(_KEPT_PATTERN if spaces_kept else _DROPPED_PATTERN + r"|\n")
        self.ids = _Ids()

    def _has_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def _regular(self, text: str) -> bool:
        """Whether the text is cut at every space and line feed."""
        return not (self._has_added(text) or (self.spaces_kept and (any(x in text for x in _RUNS) or _RUN_AFTER.search(text))))

    def stretches(self, text: str) -> list[str]:
        if self._has_added(text):
            return [text]
        if not self.spaces_kept:
            return _DROPPED.findall(text)
        return (_SPACED if self._regular(text) else _WITH_RUNS).findall(text)

    def _cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes with 16 more, where in them stretches begin and how long they are, and how many there are up to each text's end."""
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data, ends = b"".join([*raw, bytes(16)]), np.cumsum(sizes)
        some = sizes > 0
        first, last = (ends - sizes)[some], ends[some] - 1
        letters = np.frombuffer(data, np.uint8)[:-16]
        feed = letters == 10
        gap = feed | (letters == 32)
        odd = [(i, int(ends[i] - sizes[i]), int(ends[i])) for i, t in enumerate(texts) if not self._regular(t)]
        if self.spaces_kept:
            begins = gap
            begins[1:] |= feed[:-1]
            begins[first] = True
            for i, lo, hi in odd:
                begins[lo:hi] = False
                begins[lo + np.cumsum([0, *(len(x.encode()) for x in self.stretches(texts[i])[:-1])])] = True
            starts = np.flatnonzero(begins)
            lens = np.diff(starts, append=len(letters))
        else:
            begins, stops = ~gap, ~gap
            begins[1:] &= gap[:-1]
            stops[:-1] &= gap[1:]
            begins[first], stops[last] = ~gap[first], ~gap[last]
            for _, lo, hi in odd:
                begins[lo:hi] = stops[lo:hi] = False
                begins[lo] = stops[hi - 1] = True
            starts = np.flatnonzero(begins)
            lens = np.flatnonzero(stops) + 1 - starts
        return data, starts, lens, np.searchsorted(starts, ends)

    def _words(self, numbers: np.ndarray, words: list[str]) -> None:
        """Puts the ids of words, which go to the library's model one by one."""
        letters = "\n".join(words).encode().decode("latin-1").translate(_BYTE_LETTERS).split("\n") if words else []
        of_word = self.model.tokenize
        self.ids.put_lists(numbers, [[x.id for x in of_word(w)] for w in letters])

    def _learn(self, fresh: list[str], first: int) -> None:
        """Puts the ids of stretches not met before, numbered from first on. Where its letters leave no doubt how a stretch is normalised and cut, its words go to the library's model one by one, each once."""
        added = self._has_added("\n".join(fresh))
        kind = np.empty(len(fresh), np.uint8)
        for i, x in enumerate(fresh):
            if added and self._has_added(x):
                kind[i] = 0
            elif _LETTERS.fullmatch(x):
                kind[i] = 1
            elif not _PLAIN.fullmatch(x):
                kind[i] = 0
            else:
                kind[i] = 1 if self.pattern.fullmatch(x if self.spaces_kept else x.lower()) else 2
        odd, one, more = (np.flatnonzero(kind == k) for k in range(3))
        self.ids.put_lists(first + odd, [self.library.encode(fresh[i], add_special_tokens=False).ids for i in odd.tolist()])
        words = [fresh[i] for i in one.tolist()]
        self._words(first + one, words if self.spaces_kept else [x.lower() for x in words])
        if not len(more):
            return
        # a word of several is a stretch too, and one that has its ids by now
        joined = "\n".join([fresh[i] for i in more.tolist()])
        data = "\0".join([*self.pattern.findall((joined if self.spaces_kept else joined.lower()) + "\n"), ""]).encode() + bytes(16)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8)[:-16] == 0)
        starts = np.r_[0, ends[:-1] + 1]
        between = np.frombuffer(data, np.uint8)[starts] == 10
        starts, lens = starts[~between], (ends - starts)[~between]
        before = self.ids.known.count
        number, unmet = self.ids.known.ask(data, starts, lens)
        self._words(np.arange(before, self.ids.known.count), [data[lo:hi].decode() for lo, hi in zip(starts[unmet].tolist(), (starts + lens)[unmet].tolist(), strict=True)])
        lens = self.ids.len[number].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(~between)[between]]
        self.ids.put(first + more, self.ids.take(self.ids.at[number], lens), np.diff(upto, prepend=0))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by ``end``, in one array; and how many ids each text has with that id."""
        if self.ids.known.count > REMEMBERED or self.ids.used > 8 * REMEMBERED:
            self.ids = _Ids()
        data, starts, lens, cuts = self._cut(texts)
        before = self.ids.known.count
        number, fresh = self.ids.known.ask(data, starts, lens)
        if len(fresh):
            self._learn([data[lo:hi].decode() for lo, hi in zip(starts[fresh].tolist(), (starts + lens)[fresh].tolist(), strict=True)], before)
        lens = self.ids.len[number].astype(np.int64)
        counts = np.diff(np.concatenate([[0], np.cumsum(lens)])[np.r_[0, cuts]]) + 1
        ids = self.ids.take(np.insert(self.ids.at[number], cuts, 0), np.insert(lens, cuts, 1)).astype("<u4")
        ids[np.cumsum(counts) - 1] = end
        return ids, counts


_OPEN: dict[tuple[str, bool], WordTokens] = {}


def encoder(path: str, spaces_kept: bool) -> WordTokens:
    """The worker's own encoder, made once and kept from task to task."""
    if (path, spaces_kept) not in _OPEN:
        _OPEN[path, spaces_kept] = WordTokens(path, spaces_kept, added=True)
    return _OPEN[path, spaces_kept]
