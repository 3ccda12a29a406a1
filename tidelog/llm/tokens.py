"""Encoding whole texts with a public tokenizer, each distinct piece of text once.

The pre-tokenizers of these vocabularies begin a new token at a single space or line break
between words, and where ASCII punctuation follows an ASCII letter or digit (apostrophes apart).
So a text is cut there; each distinct piece is encoded by the tokenizers library once for each
worker, and the ids are laid together by array operations. Texts for which this isn't certain
(runs of white space, other white space, special tokens) are given to the library whole.

Pieces are known by their bytes. One of up to PACKED bytes is its own key: two numbers hold its
bytes and its length. The few longer ones are looked up one by one.
"""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer

from .words import _MASKS, Words, lanes, mix

#: Bytes of text that are encoded at a time.
SLICE_BYTES = 1_000_000
#: Slots of a worker's table; it starts anew when half of them are used.
SLOTS = 1 << 21
#: Bytes of longer pieces after which it starts anew, too.
LONG_BYTES = 1 << 23
#: Bytes that a key holds, beside one for the length.
PACKED = 15
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[[0x20, 0x0A]] = False
_ALNUM_ASCII = np.zeros(256, bool)
_ALNUM_ASCII[0x30:0x3A] = _ALNUM_ASCII[0x41:0x5B] = _ALNUM_ASCII[0x61:0x7B] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[0x21:0x7F] = ~_ALNUM_ASCII[0x21:0x7F]
_PUNCTUATION[0x27] = False
#: White space apart from the space and the line break.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _slots(key: np.ndarray) -> np.ndarray:
    return (mix(key[:, 0] ^ mix(key[:, 1])) & np.uint64(SLOTS - 1)).astype(np.int64)


class _Table:
    """Ids by key, in open addressing; -1 marks a free slot. ``long`` has the numbers of longer pieces."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(SLOTS, -1, np.int32)
        self.key = np.zeros((0, 2), np.uint64)
        self.number = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        at = _slots(key)
        while len(left):
            row = self.slot[at]
            used = row >= 0
            left, at, row = left[used], at[used], row[used]
            same = (self.key[row] == key[left]).all(axis=1)
            out[left[same]] = self.number[row[same]]
            left, at = left[~same], (at[~same] + 1) & (SLOTS - 1)
        return out

    def _hold(self, ids: list[list[int]]) -> int:
        """Put ids behind all others; the number of the first."""
        first, sizes = len(self.begin) - 1, np.fromiter(map(len, ids), np.int64, len(ids))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))))
        return first

    def add(self, key: np.ndarray, ids: list[list[int]]) -> None:
        """Add keys that differ from each other and from all before."""
        first = self._hold(ids)
        row = np.arange(len(self.key), len(self.key) + len(key), dtype=np.int32)
        self.key = np.concatenate((self.key, key))
        self.number = np.concatenate((self.number, np.arange(first, first + len(key), dtype=np.int32)))
        at = _slots(key)
        while len(row):
            free = np.flatnonzero(self.slot[at] < 0)
            where, one = np.unique(at[free], return_index=True)
            self.slot[where] = row[free[one]]
            left = np.ones(len(row), bool)
            left[free[one]] = False
            row, at = row[left], (at[left] + 1) & (SLOTS - 1)

    def add_long(self, pieces: list[bytes], ids: list[list[int]]) -> None:
        """Add longer pieces that differ from each other and from all before."""
        first = self._hold(ids)
        self.long.update((x, first + n) for n, x in enumerate(pieces))
        self.long_bytes += sum(map(len, pieces))


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, json: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(json)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.table = _Table()

    def _plain(self, text: str) -> bool:
        """Whether the text may be cut."""
        if self.special is not None and self.special.search(text):
            return False
        if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return False
        return _OTHER_SPACE.search(text) is None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8)."""
        strings = [t.decode() for t in texts]
        plain = [self._plain(s) for s in strings]
        out: list[bytes | None] = [None] * len(texts)
        other = [k for k, p in enumerate(plain) if not p]
        for k, e in zip(other, self.tokenizer.encode_batch_fast([strings[k] for k in other], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4").tobytes()
        if len(other) < len(texts):
            cut = self._encode_cut([t for t, p in zip(texts, plain) if p])
            for k, ids in zip((k for k, p in enumerate(plain) if p), cut):
                out[k] = ids
        return out

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """The library's ids of some pieces."""
        out = []
        for at in range(0, len(pieces), 20_000):
            some = [x.decode() for x in pieces[at : at + 20_000]]
            out += [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def _numbers(self, padded: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number in the table of each piece; new pieces are encoded and added."""
        table, size = self.table, end - begin
        if len(table.key) > SLOTS // 2 or table.long_bytes > LONG_BYTES:
            table.clear()
        raw, cut = padded.tobytes(), lambda at: [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())]
        short, from_place = np.flatnonzero(size <= PACKED), lanes(padded)
        key = np.empty((len(short), 2), np.uint64)
        own, at = size[short], begin[short]
        key[:, 0] = from_place[at] & _MASKS[np.minimum(own, 8)]
        # what a short piece lacks in the second number are zeros, and the place may lie behind the buffer
        key[:, 1] = from_place[np.minimum(at + 8, len(from_place) - 1)] & _MASKS[np.maximum(own - 8, 0)]
        key[:, 1] |= own.astype(np.uint64) << np.uint64(56)
        number = np.empty(len(size), np.int64)
        known = table.find(key)
        unknown = np.flatnonzero(known < 0)
        if len(unknown):
            _, one = np.unique(key[unknown], axis=0, return_index=True)
            new = unknown[one]
            table.add(key[new], self._ids(cut(short[new])))
            known[unknown] = table.find(key[unknown])
        number[short] = known
        long = np.flatnonzero(size > PACKED)
        pieces = cut(long)
        new = list(dict.fromkeys(x for x in pieces if x not in table.long))
        if new:
            table.add_long(new, self._ids(new))
        number[long] = [table.long[x] for x in pieces]
        return number

    def _encode_cut(self, texts: list[bytes]) -> list[bytes]:
        words = Words(texts, _NOT_BREAK, lower=False)
        data = words.data
        tail = np.flatnonzero(_PUNCTUATION[data[1:]] & _ALNUM_ASCII[data[:-1]]) + 1
        # a piece takes the one space or line break before it along, but for a text's first
        begin = words.start - 1
        begin[words.first[:-1]] += 1
        begin = np.concatenate((begin, tail))
        order = np.argsort(begin, kind="stable")
        begin = begin[order]
        # each piece ends where the next begins or where its word ends
        word_end = np.concatenate((words.end, words.end[np.searchsorted(words.start, tail, "right") - 1]))[order]
        end = np.minimum(word_end, np.append(begin[1:], len(data)))
        first = np.searchsorted(begin, words.text_start)
        number = self._numbers(words.padded, begin, end)
        table = self.table
        size = table.begin[number + 1] - table.begin[number]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = table.ids[np.arange(total[-1]) + np.repeat(table.begin[number] - total[:-1], size)]
        bounds = total[first].tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(json: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer, kept between tasks with its table."""
    key = (json, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(json, special_as_text)
    return _ENCODERS[key]


def tokenizer_json(path: str) -> str:
    """The tokenizer's file, read on the driver and sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()
