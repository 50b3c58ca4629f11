"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

A document's set holds its different runs of `width` words. Two documents link when their sets' Jaccard similarity is
at least `percent` / 100; the documents of a component keep the one with the smallest id.

A sketch has COORDINATES places. In round i < COORDINATES every token of the set is hashed to a place and a value; in
round COORDINATES + j all tokens go to place j. A place takes the least value of the first round that reaches it, and
the rounds end once every place is filled, so that a set of n tokens costs about n + COORDINATES * ln(COORDINATES)
hashes, every coordinate is filled for any n, and the share of equal coordinates is concentrated about the similarity
at least as closely as with independent MinHashes. BAND coordinates make a band key. Two sets of similarity 0.85 miss
each other in all 40 bands with a chance of (1 - 0.85^5)^40 = 7e-11 (at 0.8: 1.3e-7); every candidate is confirmed on
the full sets, made anew from the texts.

Sets that are equal form one class and are sketched once a task; sets too small to be near any other set are not
sketched. Band keys that only one class has don't travel. To learn components not every link is needed: each document
is first compared with the first document of its blocks that shares most bands with it; then only pairs of one block
that are still in different components are joined, after length and parity filters (see `ngram_join`). So a block of
near copies costs a row for each, not one for each pair, and no candidate that could join components is lost.

Words are hashed with a key drawn for each run. Documents without words (null, empty or white space) have an empty set,
link with nothing and are their own component. Rows that share an id are one node, with the links of all of them; rows
without an id have a null component and are kept. An empty table gives an empty result. Extra columns are dropped by
`link` and kept by `keep_one`, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import bitmap_of, held
from ._components import components
from ._sets import LANES, near_enough, parity, signatures
from ._store import discard, fresh, written
from ._words import U64, mix, new_key, slices
from .ngram_join import REMEMBERED, SLICE, TEXT_ROWS, joined_up, possible, sets, verify, wide_parity

#: Places of a sketch, and how many of them make a band.
COORDINATES, BAND = 200, 5
ENTRY = ["token", "id", "s1", "n", *LANES]
_LANES = ", ".join(f"{k} bigint" for k in LANES)


def sketches(owner: np.ndarray, token: np.ndarray, many: int, key: int, places: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketches, one row of `places` values each, of sets 0 to many - 1; owner is each token's set, and no set is empty."""
    value = np.full(many * places, np.iinfo(np.uint64).max, U64)
    full = np.zeros(many * places, bool)
    seeds = mix(np.arange(2 * places, dtype=U64) * U64(0x9E3779B97F4A7C15) ^ U64(key))
    for i in range(2 * places):
        if not len(token):
            break
        h = mix(token ^ seeds[i])
        place = ((h >> U64(32)) * U64(places) >> U64(32)).astype(np.int64) if i < places else i - places
        at = owner * places + place
        empty = ~full[at]
        np.minimum.at(value, at[empty], h[empty])
        full[at] = True
        open_ = ~full.reshape(many, places).all(1)
        if not open_.all():
            still = open_[owner]
            owner, token = owner[still], token[still]
    return value.reshape(many, places)


def band_keys(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key for each run of `band` coordinates."""
    parts = sketch.reshape(len(sketch), sketch.shape[1] // band, band)
    keys = np.broadcast_to(mix(np.arange(parts.shape[1], dtype=U64)), parts.shape[:2])
    for j in range(band):
        keys = mix(keys ^ parts[:, :, j])
    return keys


def profile(docs: DataFrame, width: int, percent: int, key: int) -> DataFrame:
    """(id, n, s1, s2, bands, wide, LANES) of every row; one of a task's equal sets, of the least id so far, has bands and a wide parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for piece, w in slices(batches, "t", True, 4 * SLICE, key):
            row, token, counts = sets(w, width)
            s1, s2 = signatures(token, counts)
            lanes = parity(token, counts, len(LANES))
            live = np.zeros(len(counts), bool)
            for i, (a, b, name, n) in enumerate(zip(s1.tolist(), s2.tolist(), piece.column("id").to_pylist(), counts.tolist(), strict=True)):
                if 100 * n >= percent * (n + 1) and name is not None and ((a, b) not in seen or name < seen[a, b]):
                    seen[a, b] = name
                    live[i] = True
            if len(seen) > REMEMBERED:
                seen.clear()
            mine = live[row]
            number = np.cumsum(live) - 1
            keys = band_keys(sketches(number[row[mine]], token[mine], int(live.sum()), key))
            at = pa.array(np.concatenate([[0], np.cumsum(live)]) * keys.shape[1], pa.int32(), mask=np.append(~live, False))
            bands = pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(keys).ravel().view(np.int64)))
            columns = [piece.column("id"), pa.array(counts.astype(np.int64)), pa.array(s1), pa.array(s2), bands, wide_parity(row, token, live), *map(pa.array, lanes)]
            yield pa.record_batch(columns, ["id", "n", "s1", "s2", "bands", "wide", *LANES])

    return written(docs.mapInArrow(run, f"id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, wide array<bigint>, {_LANES}"), "profile", batch_rows=TEXT_ROWS)


def entries(prof: DataFrame) -> DataFrame:
    """ENTRY: the band keys that different sets have, and a few others that share their place in a bitmap."""
    prof = prof.where("bands is not null")
    shared = prof.select(F.explode("bands").alias("token"), "s1").groupBy("token").agg(F.min("s1").alias("least"), F.max("s1").alias("most")).where("least <> most")
    bitmap = bitmap_of(shared, F.shiftrightunsigned("token", 38))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            token = lists.flatten().to_numpy().view(U64)
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            keep = held(bitmap.value, token)
            yield pa.record_batch([pa.array(token[keep].view(np.int64)), *(batch.column(c).take(pa.array(row[keep])) for c in ENTRY[1:])], ENTRY)

    return prof.select("bands", "id", "s1", F.col("n").cast("int").alias("n"), *LANES).mapInArrow(run, f"token bigint, id bigint, s1 bigint, n int, {_LANES}")


def link(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every document; component_id is the smallest id reachable over links."""
    docs, key = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")), new_key()
    prof = profile(docs, width, percent, key)
    rows = prof.select("id", "n", "s1", "s2")
    classes = written(rows.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("d")), "classes")
    later = rows.join(classes, ["s1", "s2"]).where("id > d").select("id", "s1").distinct()
    sent = written(entries(prof).join(later, ["id", "s1"], "left_anti").drop("s1"), "postings")

    def check(pairs: DataFrame) -> DataFrame:
        return verify(pairs, docs, width, percent, key)

    hubs = sent.groupBy("token").agg(F.min(F.struct("id", "n", *LANES)).alias("h"), F.count("*").alias("many")).where("many > 1").select("token", "h.*")
    near = sent.alias("x").join(hubs.alias("y"), F.expr("x.token = y.token and x.id <> y.id") & near_enough(percent, LANES)).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).count()
    near = written(near.groupBy("a").agg(F.max(F.struct("count", "b")).alias("best")).select("a", "best.b"), "pairs")
    first = components(check(near))
    discard(near)
    marked = written(sent.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "postings")
    discard(sent)
    hub_class = marked.groupBy("token").agg(F.min(F.struct("id", "c")).alias("h")).select("token", F.col("h.c").alias("hc"))
    open_ = marked.join(hub_class, "token").where("c <> hc").drop("hc")
    pairs = open_.alias("x").join(marked.alias("y"), F.expr("x.token = y.token and x.c <> y.c") & near_enough(percent, LANES))
    ends = F.array_sort(F.array(F.struct("x.id", "x.c"), F.struct("y.id", "y.c")))
    pairs = pairs.select(ends.alias("e"), "x.token").groupBy("e").agg(F.countDistinct("token").alias("shared"))
    pairs = written(pairs.select(*(F.col("e")[i][k].alias(c) for i, k, c in ((0, "id", "a"), (0, "c", "ca"), (1, "id", "b"), (1, "c", "cb"))), "shared"), "pairs")
    discard(marked)
    if not pairs.isEmpty():
        was, pairs = pairs, written(possible(pairs, prof, percent), "pairs")
        discard(was)
    found = first if pairs.isEmpty() else joined_up(first, pairs, check)
    # an id whose rows hold different sets ties their classes together
    several = rows.where("n > 0 and id is not null").groupBy("id").agg((F.min("s1") != F.max("s1")).alias("differ")).where("differ").select("id")
    ties = written(rows.join(several, "id").join(classes, ["s1", "s2"]).select(F.col("id").alias("a"), F.col("d").alias("b")), "ties")
    if not ties.isEmpty():
        found = components(ties.unionByName(found.toDF("a", "b")))
    named = classes.join(found.withColumnRenamed("node", "d"), "d", "left").select("s1", "s2", F.coalesce("component", "d").alias("component_id"))
    out = rows.join(named, ["s1", "s2"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    name = fresh(docs.columns, "gone_id")
    gone = link(docs, width, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
