"""Bitmaps of fixed size that tell which 64-bit keys may be wanted, so that the others needn't travel."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import discard, written

#: The bitmap has 2^WORD_BITS longs: 8 million bits in one megabyte. Fuller bitmaps let more keys pass, and lose none.
WORD_BITS = 17
#: The broadcast bitmap has 2^FILTER_BITS bits, eight megabytes, gathered in blocks of 2^BLOCK_BITS.
FILTER_BITS, BLOCK_BITS = 26, 15


def bitmap_of(df: DataFrame, place: Column) -> Broadcast:
    """A broadcast bitmap of 2^FILTER_BITS bits with those at the given places set."""
    size = 1 << (BLOCK_BITS - 3)
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    blocks = df.select(place.alias("p")).groupBy(F.shiftright("p", BLOCK_BITS).alias("b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << BLOCK_BITS) - 1)).alias("m"))
    blocks = written(blocks, "bitmap")  # a written job's shuffle files are gone when it ends
    for r in blocks.toLocalIterator():
        bitmap[r.b * size : (r.b + 1) * size] = np.frombuffer(r.m, np.uint8)
    discard(blocks)
    return df.sparkSession.sparkContext.broadcast(bitmap)


def held(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the top bits of each key are set in a bitmap made by `bitmap_of`."""
    p = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0


def may_hold(wanted: DataFrame, wanted_key: Column, key: Column, word_bits: int = WORD_BITS) -> Column:
    """Whether key may be among the wanted keys, by a bitmap of 2^word_bits longs; keys are hashes whose top bits are spread evenly."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(k, 58 - word_bits).bitwiseAND(63).cast("int"))
    place = lambda k: F.shiftrightunsigned(k, 64 - word_bits)
    words = wanted.groupBy(place(wanted_key).alias("b")).agg(F.bit_or(bit(wanted_key)).alias("m"))
    every = wanted.sparkSession.range(1 << word_bits).withColumnRenamed("id", "b").join(words, "b", "left")
    bitmap = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", F.coalesce("m", F.lit(0).cast("bigint")).alias("m")))), lambda x: x["m"]).alias("m"))
    return F.get(written(bitmap, "wanted").scalar(), place(key).cast("int")).bitwiseAND(bit(key)) != 0
