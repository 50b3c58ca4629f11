"""Parts shared by the two set-similarity joins: rarity sketches, set signatures, parity sketches and the pair filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import U64, mix

#: Buckets of the rarity sketch: at most 2^SKETCH_BITS heavy ones (an id and a level each) reach the driver.
SKETCH_BITS = 20
#: Longs of a parity sketch; a join uses the first two or all four.
LANES = ("k1", "k2", "k3", "k4")


def totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, counts[i] of them each, modulo 2^64."""
    run = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    end = np.cumsum(counts)
    return run[end] - run[end - counts]


def signatures(token: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on the set alone."""
    return totals(mix(token), counts).view(np.int64), totals(mix(token ^ U64(0x5851F42D4C957F2D)), counts).view(np.int64)


def parity(token: np.ndarray, counts: np.ndarray, lanes: int) -> list[np.ndarray]:
    """The first `lanes` LANES of each set: bit i tells whether an odd number of its tokens falls on i. Two sets that differ in d tokens differ in at most d bits."""
    run = np.zeros(len(token) + 1, U64)
    end = np.cumsum(counts)
    place = mix(token ^ U64(0xA5A5A5A55A5A5A5A))
    out = []
    for lane in range(lanes):
        bit = np.where((place >> U64(6)) & U64(lanes - 1) == U64(lane), U64(1) << (place & U64(63)), U64(0))
        np.bitwise_xor.accumulate(bit, out=run[1:])
        out.append((run[end] ^ run[end - counts]).view(np.int64))
    return out


def overlap_needed(percent: int) -> str:
    """SQL: the tokens that sets x and y must share."""
    return f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"


def near_enough(percent: int, lanes: tuple[str, ...]) -> Column:
    """Of entries x and y: sizes that can reach the similarity (length filter), and parity sketches that don't rule it out."""
    differ = " + ".join(f"bit_count(x.{k} ^ y.{k})" for k in lanes)
    return F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {differ} <= x.n + y.n - 2 * {overlap_needed(percent)}")


class Tally:
    """Counts tokens of a task in the sketch's buckets."""

    def __init__(self):
        self.sketch, self.seen = np.zeros(1 << SKETCH_BITS, np.int64), 0

    def add(self, token: np.ndarray) -> None:
        np.add.at(self.sketch, (token >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
        self.seen += len(token)

    def heavy(self) -> tuple[pa.Array, pa.Array]:
        """The buckets that stand out in this task, and their counts."""
        at = np.flatnonzero(self.sketch > 8 + 2 * self.seen / len(self.sketch))
        return pa.array(at), pa.array(self.sketch[at])


def rarity(heavy: DataFrame) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Made on the driver from rows (bucket, heavy), opened in a task: estimates of the tokens' frequencies."""
    sums = heavy.groupBy("bucket").agg(F.sum("heavy").alias("heavy")).toPandas()
    shared = heavy.sparkSession.sparkContext.broadcast((sums["bucket"].to_numpy(np.int32), np.minimum(sums["heavy"].to_numpy(np.int64), 1 << 30).astype(np.int32)))

    def opened() -> Callable[[np.ndarray], np.ndarray]:
        frequency = np.zeros(1 << SKETCH_BITS, np.int32)
        frequency[shared.value[0]] = shared.value[1]
        return lambda token: frequency[(token >> U64(64 - SKETCH_BITS)).astype(np.int64)]

    return opened


def tallied(df: DataFrame, tokens: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> DataFrame:
    """(bucket, heavy) of every task over the arrays of tokens that tokens(batches) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for token in tokens(batches):
            tally.add(token)
        yield pa.record_batch(list(tally.heavy()), ["bucket", "heavy"])

    return df.mapInArrow(run, "bucket bigint, heavy bigint")
