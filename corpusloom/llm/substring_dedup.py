"""Substring dedup with a compressed FM-index per shard.

Segments of documents that may repeat (see _repeats) are dealt to shards. A shard sorts the suffixes of its segments,
keeps their Burrows-Wheeler transform in a wavelet matrix with rank directories, and streams every segment through it
by backward search: each step extends the match to the left by a word and trims it to `length` words, so that after
each step the interval of the current window, its matching statistic capped at `length`, is known. Intervals of two or
more occurrences are reported with their earliest one; windows that start later are removed.

Null texts have no words. Documents of fewer than `length` words lose none. Rows that share an id are judged as one
document. Rows without an id are kept whole. Repeated texts lose all words after the first copy. An empty table gives
an empty result. Extra columns are dropped. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats
from ._words import slices

LENGTH, GRAM = 20, 6


class FMIndex:
    """Of segments laid end to end in `words` (ids from 1 on), each closed by a mark of its own."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, length: int):
        m, n = len(sizes), len(words) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        is_mark = np.zeros(n, bool)
        is_mark[ends] = True
        text = np.zeros(n, np.int64)
        text[~is_mark] = words
        rank = np.zeros(n, np.int64)
        rank[ends] = np.arange(m)
        rank[~is_mark] = m + words
        # suffixes sorted by doubled prefixes; a mark ends the comparison, as each differs from all others
        step, trim, sa = 1, None, np.argsort(rank, kind="stable")
        while step <= int(sizes.max()):
            if step <= length < 2 * step:
                trim = (step, rank)
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * (n + m + int(words.max()) + 2) + ahead
            sa = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[sa[1:]] != key[sa[:-1]]
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(new) - 1
            step *= 2
        self.n, self.sa = n, sa
        # intervals of suffixes that agree on `length` words
        power, by = trim
        tail = np.minimum(sa + length - power, n - 1)
        differs = np.ones(n, bool)
        differs[1:] = (by[sa[1:]] != by[sa[:-1]]) | (by[tail[1:]] != by[tail[:-1]])
        self.first = np.flatnonzero(differs)
        self.interval = np.cumsum(differs) - 1
        self.end = np.append(self.first[1:], n)
        bwt = text[sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(words.max()) + 1))])
        self.bits = max(1, int(words.max()).bit_length())
        self.planes, self.ones, self.zeros = [], [], []
        x = bwt
        for level in reversed(range(self.bits)):
            bit = (x >> level) & 1 != 0
            plane = np.packbits(np.append(bit, np.zeros(64 - n % 64, bool)), bitorder="little").view(np.uint64)
            self.planes.append(plane)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        symbols, first = np.unique(x, return_index=True)
        self.bottom = np.zeros(int(words.max()) + 1, np.int64)
        self.bottom[symbols] = first

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each place i."""
        for level, plane, ones, zeros in zip(reversed(range(self.bits)), self.planes, self.ones, self.zeros, strict=False):
            word = i >> 6
            one = ones[word] + np.bitwise_count(plane[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> level) & 1 != 0, zeros + one, i - one)
        return i - self.bottom[symbol]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one more word on their left."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.less[symbol], 2)
        return both[: len(lo)], both[len(lo) :]


def shard(ids: np.ndarray, starts: np.ndarray, words: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, length: int) -> np.ndarray:
    """For each window of each segment: whether an equal one is earlier."""
    _, words = np.unique(words, return_inverse=True)
    words = words + 1
    index = FMIndex(words, sizes, length)
    first = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    window_at = np.cumsum(windows) - windows
    found = np.zeros(int(windows.sum()), np.int64)
    lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.n, np.int64)
    for step in range(int(sizes.max())):
        live = np.flatnonzero(sizes > step)
        place = sizes[live] - 1 - step
        lo[live], hi[live] = index.extend(words[first[live] + place], lo[live], hi[live])
        if step >= length - 1:
            at = index.interval[lo[live]]
            lo[live], hi[live] = index.first[at], index.end[at]
            found[window_at[live] + place] = at
    row = np.repeat(np.arange(len(sizes)), windows)
    nth = np.arange(len(row)) - window_at[row]
    return _repeats.earliest(found, ids[row], starts[row] + nth)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept): kept holds the words left, joined by a blank."""
    spans = _repeats.find(docs, length, gram, shard, id_col=id_col, text_col=text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, w in slices(batches, "t"):
            counts, removed, kept = w.counts, [], []
            for i, spans in enumerate(piece.column("spans").to_pylist()):
                a = w.offsets[i]
                gone = _repeats.covered(spans, int(counts[i]))
                removed.append(int(gone.sum()))
                keep = np.flatnonzero(~gone) + a
                kept.append(b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)).decode())
            yield pa.record_batch([piece.column(id_col), pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [id_col, "n_words", "n_removed", "kept"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("t")).join(spans.withColumnRenamed("id", "_id"), F.col(id_col).cast("bigint") == F.col("_id"), "left").select(id_col, "t", "spans")
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_words bigint, n_removed bigint, kept string")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return dedup(docs, length).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
