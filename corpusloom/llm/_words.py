"""Word spans and hashes of whole Arrow batches, computed with numpy inside Spark tasks."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
_BASE2 = 0xC2B2AE3D27D4EB4F
#: Bytes of a word that are mixed in numpy, and masks of the low bytes of eight.
LONGEST = 64
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: The separators of words, ASCII space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n and the inverses, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        m = max(n + 1, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(m, b, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[base] = have = (out[0], out[1])
    return have


def new_key() -> int:
    """A random key for the hashes of one run, drawn on the driver: texts can't be made to collide beforehand."""
    return secrets.randbits(64)


def keyed_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of the bytes data[s:e] for every pair of start and end.

    Eight bytes at a time go through a bijective mix, so that spans of up to eight bytes never collide; what is beyond
    LONGEST bytes goes through BLAKE2b with the same key.
    """
    size = (end - start).astype(np.int64)
    h = mix(size.astype(U64) * U64(0x165667B19E3779F9) ^ U64(key))
    if not len(size):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero(size)
    for at in range(0, LONGEST, 8):
        live = live[size[live] > at]
        if not len(live):
            return h
        chunk = eight[start[live] + at] & _LOW[np.minimum(size[live] - at, 8)]
        h[live] = mix(h[live] ^ chunk)
    for i in live[size[live] > LONGEST].tolist():
        rest = hashlib.blake2b(data[start[i] + LONGEST : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
        h[i] = mix(h[i : i + 1] ^ np.frombuffer(rest, "<u8"))[0]
    return h


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of the short runs values[s:e] of hashes, for every pair of starts and ends."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x165667B19E3779F9))


class Words:
    """Words of the texts of one slice: byte spans (start, end), hash, and offsets: text i has words offsets[i] to offsets[i + 1]."""

    __slots__ = ("data", "text_at", "start", "end", "offsets", "rows", "key", "_hash")

    def __init__(self, texts: pa.Array, rows: slice, lower: bool, key: int = 0):
        self.rows, self.key, self._hash = rows, key, None
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, np.uint8)[at[0] : at[-1]] if buf is not None else np.zeros(0, np.uint8)
        self.text_at = at - at[0]
        self.data = LOWER[data] if lower else data
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~IS_SPACE[data]
        # a text's end also ends a word: cut at text borders
        step = np.diff(word.view(np.int8))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cut = self.text_at[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[word[cut] & word[cut + 1]]  # inside a run of word bytes
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        self.start, self.end = start, end
        self.offsets = np.searchsorted(start, self.text_at)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = keyed_hash(self.data, self.start, self.end, self.key)
        return self._hash

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every run of k words within one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        last = np.repeat(self.offsets[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + k <= last)
        return at, span_hash(self.hash, at, at + k, _BASE2)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", lower: bool = False, most: int = 1 << 20, key: int = 0) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batches cut so that each piece has about `most` bytes of text, or one longer text."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
        total, i = np.cumsum(sizes), 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most)))
            piece = batch.slice(i, j - i)
            yield piece, Words(piece.column(column), slice(i, j), lower, key)
            i = j
        pa.default_memory_pool().release_unused()


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost position of the least of values[i : i + width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        have += step
    return at[:n]
