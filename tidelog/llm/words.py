"""Vectorised word scanning over Arrow batches.

A batch of texts becomes one byte buffer with a separator after every text. Word bounds come
from a byte-class table. Words are hashed eight bytes at a time, all words at once; windows of
words by doubling, from windows of half the size. No hash is a polynomial, for which texts with
equal hashes can be built from repetition alone; words of up to eight bytes and of one length
never share a hash. There is no Python step per word, but for words over LONG bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

SPACE = 0x20
#: Bytes of text that are scanned at a time; one longer text is scanned alone.
SLICE_BYTES = 2_000_000
#: What a longer word has beyond so many bytes is hashed by XXH3.
LONG = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Start values of independent hashes.
_SEEDS = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lanes(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number; the buffer ends in eight spare bytes."""
    return np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))


def hash_spans(padded: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    from_place, size = lanes(padded), end - start
    out = mix(size.astype(np.uint64) * _ODD + _SEEDS[seed])
    left, done = np.flatnonzero(size > 0), 0
    while len(left) and done < LONG:
        room = size[left] - done
        lane = from_place[start[left] + done] & _MASKS[np.minimum(room, 8)]
        out[left] = mix(out[left] ^ lane)
        left, done = left[room > 8], done + 8
    for k in left.tolist():
        rest = xxhash.xxh3_64_intdigest(padded[start[k] + LONG : end[k]].tobytes(), int(_SEEDS[seed]))
        out[k] ^= np.uint64(rest)
    return out


#: Bytes that are part of words, as the class [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: As [^\x00-\x2F\x3A-\x60\x7B-\x7F], for text whose A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of some texts: ``start``/``end`` bytes in ``data``, and ``first`` word of each text."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray, lower: bool):
        buffer = b" ".join(texts) + b" " + bytes(8)
        padded = np.frombuffer(buffer, np.uint8)
        self.padded = padded = LOWER[padded] if lower else padded
        self.data = data = padded[:-8]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        inside = word_bytes[data].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def positions(self) -> np.ndarray:
        """The number of each word in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return hash_spans(self.padded, self.start, self.end)


def window_hashes(hashes: np.ndarray, size: int, at: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``size`` word hashes from each word number in ``at``.

    Windows of 1, 2, 4, ... words are hashed at every place, each from two of half its size, and
    those that make up ``size`` are taken together.
    """
    out = np.full(len(at), _SEEDS[family], np.uint64)
    level, width, done = mix(hashes + _SEEDS[family]), 1, 0
    while done < size:
        if size & width:
            out = mix(out * _ODD + level[at + done])
            done += width
        if done < size:
            level = mix(level[:-width] * _ODD + level[width:])
            width *= 2
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges between the bounds ``first``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into parts of about ``size`` bytes of text; null texts become empty."""
    texts = batch.column(column).cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    part = np.cumsum(sizes) // size
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo), [x or b"" for x in texts.slice(lo, hi - lo).to_pylist()]
