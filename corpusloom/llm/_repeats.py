"""Routing of repeated word windows to shards, shared by the two substring operators.

Every window of `length` words has an anchor: the leftmost run of `gram` words with the least hash in it. Equal windows
have equal anchors, so a maximal run of windows with one anchor (a segment) can be compared in the shard of that
anchor, and nowhere else. Anchors are counted over the whole corpus first; only segments whose anchor occurs twice or
more travel. Which those are is told by a bitmap of fixed size; when it fills up at very large inputs, more segments
travel and results stay the same. Equal segments are merged in each task, so a passage that is copied into a third of
all documents sends a row per task. Anchors with many occurrences are parted further, window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import binary_column
from ._store import written
from ._words import U64, Words, mix, new_key, slices, span_hash, window_min

BITS, BLOCK_BITS = 26, 15
#: An anchor with more occurrences than this, and than this share of all, is parted window by window.
HOT_COUNT, HOT_SHARE = 4096, 1 / 65536
#: Different segments that a task remembers, and rows of a shard that are indexed at once if their anchors allow it.
REMEMBERED, INDEXED = 200_000, 24_000
#: Words travel as the low six bytes of their hashes, whose key is drawn for each run; the anchor's words agree in 64 bits.
WIDTH = 6
SEGMENTS = "id bigint, start int, end int, shard bigint, anchor_at int, words binary"


def segments(w: Words, length: int, gram: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(first word, end word, anchor's place, anchor) of the segments of a slice; those of hot anchors hold one window each."""
    at, value = w.grams(gram)
    wide = length - gram + 1
    least = window_min(value, wide)
    if not len(least):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U64),)
    first = at[: len(least)]
    fits = first + length <= np.repeat(w.offsets[1:], w.counts)[first]
    first, least = first[fits], least[fits]
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U64),)
    new = np.ones(len(first), bool)
    new[1:] = (least[1:] != least[:-1]) | (first[1:] != first[:-1] + 1)
    if hot is not None and len(hot):
        new |= np.isin(value[least], hot)
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(first)) - 1
    return first[i], first[last] + length, at[least[i]], value[least[i]]


def repeated_anchors(docs: DataFrame, length: int, gram: int, lower: bool, key: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of anchors that occur twice or more, and the hot ones (at most 1 / HOT_SHARE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in slices(batches, "t", lower, key=key):
            anchor, n = np.unique(segments(w, length, gram)[3], return_counts=True)
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    counts = docs.mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts, "anchors")
    block = F.shiftrightunsigned("anchor", 64 - BITS + BLOCK_BITS)
    place = F.shiftrightunsigned("anchor", 64 - BITS).bitwiseAND((1 << BLOCK_BITS) - 1)
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for r in counts.groupBy(block.alias("b")).agg(F.bitmap_construct_agg(place).alias("m")).collect():
        bitmap[r.b * size : (r.b + 1) * size] = np.frombuffer(r.m, np.uint8)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > int(max(HOT_COUNT, total * HOT_SHARE))).select("anchor").collect()
    return bitmap, np.array([r.anchor for r in hot], np.int64).view(U64)


def find(docs: DataFrame, length: int, gram: int, shard: Callable, lower: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): of every document with words in a window whose words also start earlier, the covered word spans.

    Earlier is: of a smaller id, or of the same id with a smaller start. shard(ids, starts, words, sizes, anchors) gets
    the segments of whole anchors and returns a flag for each of their windows, laid end to end.
    """
    spark, key = docs.sparkSession, new_key()
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    shared = spark.sparkContext.broadcast(repeated_anchors(docs, length, gram, lower, key))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        seen: dict[int, tuple[int, int]] = {}
        for piece, w in slices(batches, "t", lower, key=key):
            a, b, anchor_at, anchor = segments(w, length, gram, hot)
            place = (anchor >> U64(64 - BITS)).astype(np.int64)
            live = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0
            a, b, anchor_at, anchor = a[live], b[live], anchor_at[live], anchor[live]
            if not len(a):
                continue
            names = piece.column("id").to_numpy()
            row = np.searchsorted(w.offsets, a, side="right") - 1
            ids, start = names[row], a - w.offsets[row]
            same = span_hash(w.hash, a, b, 0xA24BAED4963EE407) ^ mix(anchor + (anchor_at - a).astype(U64))
            order = np.lexsort((start, ids, same))
            lead = np.ones(len(order), bool)
            lead[1:] = same[order[1:]] != same[order[:-1]]
            # equal places (an id that has several rows) are not later than one another
            tie = ~lead
            tie[1:] &= (ids[order[1:]] == ids[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
            later = np.ones(len(a), bool)
            first = order[lead]
            for i, known, place in zip(first.tolist(), same[first].tolist(), zip(ids[first].tolist(), start[first].tolist(), strict=True), strict=True):
                if known not in seen or place <= seen[known]:
                    seen[known] = place
                    later[i] = False
            if tie.any():
                for i, j in zip(order[:-1][tie[1:]].tolist(), order[1:][tie[1:]].tolist(), strict=True):
                    later[j] = later[i]
            if len(seen) > REMEMBERED:
                seen.clear()
            # what is known to be later, joined to spans of words
            mark = np.zeros(len(w.hash) + 1, np.int32)
            np.add.at(mark, a[later], 1)
            np.add.at(mark, b[later], -1)
            hit = np.zeros(len(w.hash) + 1, bool)
            hit[:-1] = np.cumsum(mark)[:-1] > 0
            cut = hit.copy()
            cut[1:] = hit[1:] & hit[:-1]
            cut[w.offsets[w.offsets < len(cut)]] = False
            begin = np.flatnonzero(hit & ~cut)
            after = hit & ~np.append(cut[1:], False)
            end = np.flatnonzero(after) + 1
            r = np.searchsorted(w.offsets, begin, side="right") - 1
            n, none = len(begin), pa.nulls
            yield pa.record_batch([pa.array(names[r]), pa.array((begin - w.offsets[r]).astype(np.int32)), pa.array((end - w.offsets[r]).astype(np.int32)), pa.array(mix(names[r].view(U64)).view(np.int64)), none(n, pa.int32()), none(n, pa.binary())], ["id", "start", "end", "shard", "anchor_at", "words"])
            a, b, anchor_at, anchor, ids, start = (x[~later] for x in (a, b, anchor_at, anchor, ids, start))
            if len(hot):
                is_hot = np.isin(anchor, hot)
                anchor = np.where(is_hot, mix(anchor ^ span_hash(w.hash, a, b, 0xD6E8FEB86659FD93)), anchor)
            sizes = b - a
            total = np.cumsum(sizes)
            flat = np.arange(total[-1] if len(a) else 0) + np.repeat(a - (total - sizes), sizes)
            words = w.hash.view(np.uint8).reshape(-1, 8)[flat, :WIDTH]
            yield pa.record_batch([pa.array(ids), pa.array(start.astype(np.int32)), pa.array((start + sizes).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array((anchor_at - a).astype(np.int32)), binary_column(words, sizes * WIDTH)], ["id", "start", "end", "shard", "anchor_at", "words"])

    # spans known to be later travel along with the segments, without words
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def judge(t: pa.Table) -> pa.RecordBatch:
            ids, start = t["id"].to_numpy(), t["start"].to_numpy().astype(np.int64)
            sizes = t["end"].to_numpy() - start
            raw = np.frombuffer(b"".join(t["words"].to_pylist()), np.uint8).reshape(-1, WIDTH)
            words = np.zeros((len(raw), 8), np.uint8)
            words[:, :WIDTH] = raw
            flags = shard(ids, start, words.view(np.int64).ravel(), sizes, t["anchor_at"].to_numpy().astype(np.int64), length)
            n = sizes - length + 1
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            row, nth = row[flags], nth[flags]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(row)) - 1 if len(i) else i
            return pa.record_batch([pa.array(ids[row[i]]), pa.array((start[row[i]] + nth[i]).astype(np.int32)), pa.array((start[row[j]] + nth[j] + length).astype(np.int32))], ["id", "start", "end"])

        for batch in batches:
            known = pa.compute.is_null(batch.column("anchor_at"))
            yield batch.filter(known).select(["id", "start", "end"])
            batch = batch.filter(pa.compute.invert(known))
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows < INDEXED:
                continue
            t = pa.Table.from_batches(held)
            place = t["shard"].to_numpy()
            edge = np.flatnonzero(place[1:] != place[:-1])
            if len(edge):
                cut = int(edge[-1]) + 1
                yield judge(t.slice(0, cut))
                held, rows = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if rows:
            yield judge(pa.Table.from_batches(held))

    sent = docs.mapInArrow(send, SEGMENTS).repartition("shard").sortWithinPartitions("shard")
    found = sent.mapInArrow(compare, "id bigint, start int, end int")
    return found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int32)
    for s in spans or ():
        mark[min(n, s["start"])] += 1
        mark[min(n, s["end"])] -= 1
    return np.cumsum(mark)[:n] > 0


def earliest(group: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a window's group has a window that is earlier than it."""
    order = np.lexsort((start, ids, group))
    g = group[order]
    lead = np.ones(len(g), bool)
    lead[1:] = g[1:] != g[:-1]
    first = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
    out = np.zeros(len(g), bool)
    out[order] = (ids[order] != ids[first]) | (start[order] != start[first])
    return out
