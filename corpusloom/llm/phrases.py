"""Phrase collocation mining in shards: partition, mine locally, count globally.

Texts are lower-cased (A-Z), split into pieces at BREAKS and into words at blanks and tabs. Counts are per language; a
null language is `und`. A phrase is 2 to `longest` words in a row within a piece, and a candidate if it occurs
`support` times or more, overlaps included.

Rows are dealt into `shards` shards by a hash of their id. A phrase with `support` occurrences in a language of W words
must have at least ceil(support * w / W) in some shard that holds w of the words; so each shard is mined completely at
that lowered support: first words, then pairs of words that are frequent there, then longer phrases whose pairs all are.
The union of what is frequent in some shard holds every candidate, and one pass counts it in all rows by the words
themselves. The number of shards is fixed, so that the lowered support stays well over 1 for any size of the corpus; a
shard is mined by many tasks, which add up their own counts before a shuffle.

Hashes with a key drawn for each run only choose what is counted: two phrases of one hash make the mining count too
much, never too little, and the global count goes by the phrases' own text. (Inside one task's slice of about a million
words, phrases are told apart by 64 bits.) Of all that is frequent, one bitmap of fixed size travels between levels.

A cut of a candidate after k words has the score floor(1000 * a * n / (l * r)), computed in decimals of 38 digits; the
lowest score counts. Null texts have no words; rows without an id are mined as any other; extra columns are ignored,
whatever their names; an empty table has no phrases. Repeated rows count as often as they occur. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bitmap import bitmap_of, held
from ._store import discard, written
from ._words import _BASE2, U64, Words, mix, new_key, span_hash

#: What ends a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SHARDS = 8
#: Bytes of text looked at together, and different phrases that a task keeps before it passes their counts on.
SLICE, KEPT = 1 << 20, 1 << 20
#: Parts in which each language's best phrases are found before they meet.
PARTS = 64
#: Bytes as they are compared: A-Z lowered, and every break a line feed.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(BREAKS)] = 10


class Slice:
    """Words of some texts: their rows, the pieces they stand in, and runs of them."""

    def __init__(self, batch: pa.RecordBatch, key: int):
        texts = batch.column("t").cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        buf = texts.buffers()[2]
        data = _FOLD[np.frombuffer(buf, np.uint8)[at[0] : at[-1]]] if buf is not None else np.zeros(0, np.uint8)
        folded = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at - at[0]), pa.py_buffer(data)])
        self.words = Words(folded, slice(0, len(texts)), False, key)
        self.row = self.words.owner()
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        self.piece = breaks[self.words.start] + self.row
        #: what a row's language adds to the hashes of its phrases, and its shard and language
        self.lang, self.group = batch.column("lang_key").to_numpy().view(U64), batch.column("group").to_numpy().view(U64)

    def runs(self, k: int) -> np.ndarray:
        """Where runs of k words within a piece start."""
        n = len(self.piece)
        return np.flatnonzero(self.piece[: n - k + 1] == self.piece[k - 1 :]) if n >= k else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """A hash of language and words of the runs of k words from each place on."""
        return mix(span_hash(self.words.hash, at, at + k, _BASE2) ^ self.lang[self.row[at]])

    def frequent(self, at: np.ndarray, key: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        return held(bitmap, local(key, self.group[self.row[at]]))


def local(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The hash of a phrase in a shard."""
    return mix(key ^ group)


def sliced(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("t")), 0), np.int64)
        total, i = np.cumsum(sizes), 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE)))
            piece = batch.slice(i, j - i)
            yield piece, Slice(piece, key)
            i = j
        pa.default_memory_pool().release_unused()


class Counts:
    """Counts of phrases by shard in a task."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, key: np.ndarray, group: np.ndarray, n: np.ndarray | None = None) -> None:
        own, first, where = np.unique(local(key, group), return_index=True, return_inverse=True)
        n = np.bincount(where, n, len(own)).astype(np.int64)
        self.parts.append((key[first], group[first], n))
        self.held += len(own)

    def flush(self) -> pa.RecordBatch:
        key, group, n = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        if len(key):
            self.add(key, group, n)
            ((key, group, n),) = self.parts
            self.parts, self.held = [], 0
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(group.view(np.int64)), pa.array(n)], ["key", "group", "n"])


def counted(docs: DataFrame, key: int, lengths: list[int], known: Broadcast | None) -> DataFrame:
    """(key, group, n), a row a task and phrase at least: runs of the lengths whose parts are frequent in their shard.

    Parts are single words for runs of two, and pairs for longer ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for _, s in sliced(batches, key):
            part = 1 if lengths[0] == 2 else 2
            if known is None:
                good = None
            else:
                at = s.runs(part)
                good = np.zeros(len(s.piece) + 1, np.int64)
                good[at + 1] = s.frequent(at, s.keys(at, part), known.value)
                good = np.cumsum(good)
            for k in lengths:
                at = s.runs(k)
                if good is not None:
                    at = at[good[at + k - part + 1] - good[at] == k - part + 1]
                if len(at):
                    counts.add(s.keys(at, k), s.group[s.row[at]])
            if counts.held > KEPT:
                yield counts.flush()
        yield counts.flush()

    return docs.mapInArrow(run, "key bigint, group bigint, n bigint")


def in_all(docs: DataFrame, key: int, longest: int, chosen: Broadcast) -> DataFrame:
    """(lang, phrase, n), a row a slice and phrase: the runs of 1 to `longest` words that the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, s in sliced(batches, key):
            rows, texts, numbers = [], [], []
            for k in range(1, longest + 1):
                at = s.runs(k)
                keys = s.keys(at, k)
                keep = held(chosen.value, keys)
                at = at[keep]
                _, first, n = np.unique(keys[keep], return_index=True, return_counts=True)
                first = at[first]
                w = s.words
                bounds = [w.start[first + i].tolist() for i in range(k)] + [w.end[first + i].tolist() for i in range(k)]
                data = w.data.tobytes()
                texts += [b" ".join([data[x[i] : x[k + i]] for i in range(k)]).decode() for x in zip(*bounds, strict=True)]
                rows.append(s.row[first])
                numbers.append(n)
            yield pa.record_batch([piece.column("lang").take(pa.array(np.concatenate(rows))), pa.array(texts, pa.string()), pa.array(np.concatenate(numbers))], ["lang", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def frequent(docs: DataFrame, support: int = 100, longest: int = 5, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all runs of 1 to `longest` words with f >= support, and (lang, n) of each language's words."""
    key = new_key()
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(F.col(text_col).alias("t"), lang.alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards)).alias("shard"))
    salt = F.lit(key - (1 << 63))
    rows = rows.select("t", "lang", F.xxhash64(salt, "lang").alias("lang_key"), F.xxhash64(salt, "shard", "lang").alias("group"))
    words = written(counted(rows, key, [1], None).groupBy("key", "group").agg(F.sum("n").alias("n")), "words")
    names = rows.select("lang", "group").distinct()
    by_group = words.groupBy("group").agg(F.sum("n").alias("w"))
    sizes = written(names.join(by_group, "group"), "sizes")
    n = sizes.groupBy("lang").agg(F.sum("w").alias("n"))
    # exact: support * w / W rounded up, in decimals
    lowered = F.expr(f"cast({support} as decimal(38,0)) * w").alias("need_n")
    least = written(sizes.join(n, "lang").select("group", lowered, F.col("n").alias("of")), "sizes")

    def kept(counts: DataFrame) -> DataFrame:
        """Those with n >= support * w / W in their shard."""
        return counts.join(least, "group").where(F.expr("cast(n as decimal(38,0)) * of >= need_n")).select("key", "group")

    ones = written(kept(words), "ones")
    discard(words)
    pairs = written(kept(counted(rows, key, [2], bitmap_of(locals_of(ones), F.shiftrightunsigned("key", 38))).groupBy("key", "group").agg(F.sum("n").alias("n"))), "pairs")
    levels = [ones, pairs]
    if longest > 2:
        longer = counted(rows, key, list(range(3, longest + 1)), bitmap_of(locals_of(pairs), F.shiftrightunsigned("key", 38)))
        levels.append(written(kept(longer.groupBy("key", "group").agg(F.sum("n").alias("n"))), "longer"))
    union = levels[0].select("key")
    for level in levels[1:]:
        union = union.unionByName(level.select("key"))
    chosen = bitmap_of(union, F.shiftrightunsigned("key", 38))
    found = written(in_all(rows, key, longest, chosen).where(F.col("f") >= support), "frequent")
    discard(*levels, least)
    return found, n


def locals_of(level: DataFrame) -> DataFrame:
    """The hashes of phrases in their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = local(b.column("key").to_numpy().view(U64), b.column("group").to_numpy().view(U64))
            yield pa.record_batch([pa.array(x.view(np.int64))], ["key"])

    return level.mapInArrow(run, "key bigint")


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, most: int = 2000, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best candidates, by score, then a, then phrase.

    a, l and r are the occurrences of the phrase and of its two parts at the cut of the lowest score (the first such
    cut), n the language's words. A candidate inside a longer one that occurs as often is left out.
    """
    found, n = frequent(docs, support, longest, shards, id_col, text_col, lang_col)
    all_ = found.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w"))
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    # one longer by a word is enough: what occurs as often inside a longer phrase does so in every one between
    inside = all_.where("k > 2").select("lang", F.explode(F.array_distinct(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1)))).alias("phrase"), F.col("f").alias("g"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("g").alias("longer"))
    good = all_.where("k > 1").join(inside, ["lang", "phrase"], "left").where("longer is null or longer < f")
    cuts = good.select("lang", "phrase", F.col("f").alias("a"), "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda c, f: found.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(n, "lang")
    score = F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
    top = ranked(best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part").drop("part", "rank")
    return ranked(top, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
