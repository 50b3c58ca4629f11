"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its different runs of `width` words. Two documents link when their sets' Jaccard similarity is
at least `percent` / 100. Sets that are equal form one class and are compared once.

Tokens are ordered by an estimate of their document frequency, rare ones first, then by hash. A sketch of fixed size,
counted over the whole corpus, gives the estimates: each partition reports the buckets that are heavy in it. A set of n
tokens that must share at least o tokens with a partner shares at least m of its first n - o + m ones. Each document
picks its own m (up to MOST_MATCHES): the longer prefix costs the estimated postings of its added tokens, and in turn
candidates must share m prefix tokens, which divides the estimated number of sets to compare. A pair is held to the
smaller m of the two.

To learn components not every link is needed: first each document is compared with the most central document of its
blocks; then only pairs of one block that are still in different components are joined, counted and verified. So a
block of near copies costs a row for each, not one for each pair, and no link that could join components is lost. In
both rounds a pair must pass the length filter, the positional filter and parity sketches of 256 bits, which bound how
many tokens two sets share, before texts travel; then the sets are made anew from the texts and compared.

Words are hashed with a key drawn for each run. Documents without words have an empty set, link with nothing and are
their own component. Rows that share an id are one node, with the links of all of them; rows without an id have a null
component. An empty table gives an empty result. Extra columns are dropped by `link` and kept by `keep_one`, whatever
their names. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import bitmap_of, held, may_hold
from ._components import components
from ._sets import LANES, near_enough, overlap_needed, parity, rarity, signatures, tallied
from ._store import discard, fresh, written
from ._words import _BASE2, U64, Words, new_key, slices, span_hash

MOST_MATCHES = 4
#: Comparing two sets costs as much as reading this many postings.
COMPARE_COST = 16
REMEMBERED = 50_000
#: Pairs in an Arrow batch, each with two texts, and texts in one.
PAIR_ROWS, TEXT_ROWS = 200, 2000
#: Bytes of text that a task looks at together.
SLICE = 1 << 18
#: Bits of the wide parity sketch that pairs of different components must pass before their texts travel.
WIDE = 4096
ENTRY = ["token", "pos", "id", "s1", "n", "m", *LANES]


def sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token) of the different tokens of every text of a slice, sorted, and the number of each text's tokens."""
    at, token = w.grams(width)
    row = np.searchsorted(w.offsets, at, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    token = np.concatenate([token, span_hash(w.hash, w.offsets[short], w.offsets[short + 1], _BASE2)])
    row = np.concatenate([row, short])
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[new], token[new]
    return row, token, np.bincount(row, minlength=len(w.counts))


def prefixes(counts: np.ndarray, often: np.ndarray, percent: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matches m and the prefix length of every live set; often has the tokens' frequencies, rare ones first."""
    end = np.cumsum(counts)
    m, size = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(live).tolist():
        n = int(counts[i])
        a = int(end[i]) - n
        least = -(-percent * n // 100)
        m[i], size[i] = 1, n - least + 1
        cost = int(often[a : a + n - least + 1].sum())
        if cost:
            best = cost * (1 + COMPARE_COST)
            for k in range(2, min(MOST_MATCHES, least) + 1):
                cost += int(often[a + n - least + k - 1])
                if cost * (1 + COMPARE_COST / k) < best:
                    best, m[i], size[i] = cost * (1 + COMPARE_COST / k), k, n - least + k
    return m, size


def wide_parity(row: np.ndarray, token: np.ndarray, live: np.ndarray) -> pa.Array:
    """For each live set WIDE bits as longs: bit i tells whether an odd number of its tokens falls on i; null for others."""
    at = np.where(live, np.cumsum(live) - 1, -1)
    mine = live[row]
    flat = at[row[mine]] * WIDE + (token[mine] & U64(WIDE - 1)).astype(np.int64)
    odd = (np.bincount(flat, minlength=int(live.sum()) * WIDE) & 1).astype(np.uint8)
    longs = np.packbits(odd, bitorder="little").view(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(live)]) * (WIDE // 64), pa.int32(), mask=np.append(~live, False))
    return pa.ListArray.from_arrays(offsets, pa.array(longs))


def profile(docs: DataFrame, width: int, percent: int, key: int) -> DataFrame:
    """(id, n, s1, s2, m, prefix, wide, LANES) of every row; one of a task's equal sets, of the least id so far, has a prefix and a wide sketch."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (sets(w, width)[1] for _, w in slices(batches, "t", True, SLICE, key))

    often = rarity(tallied(docs, tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimate = often()
        seen: dict[tuple[int, int], int] = {}
        for piece, w in slices(batches, "t", True, SLICE, key):
            row, token, counts = sets(w, width)
            s1, s2 = signatures(token, counts)
            sketch = parity(token, counts, len(LANES))
            frequency = estimate(token)
            live = np.zeros(len(counts), bool)
            for i, (a, b, name, n) in enumerate(zip(s1.tolist(), s2.tolist(), piece.column("id").to_pylist(), counts.tolist(), strict=True)):
                if n and name is not None and ((a, b) not in seen or name < seen[a, b]):
                    seen[a, b] = name
                    live[i] = True
            if len(seen) > REMEMBERED:
                seen.clear()
            wide = wide_parity(row, token, live)
            order = np.lexsort((token, frequency, row))
            token, frequency = token[order], frequency[order]
            m, size = prefixes(counts, frequency, percent, live)
            total = np.cumsum(size)
            flat = np.arange(total[-1] if len(total) else 0) + np.repeat(np.cumsum(counts) - counts - (total - size), size)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], total]).astype(np.int32)), pa.array(token[flat].view(np.int64)))
            columns = [piece.column("id"), pa.array(counts.astype(np.int64)), pa.array(s1), pa.array(s2), pa.array(m.astype(np.int32)), prefix, wide, *map(pa.array, sketch)]
            yield pa.record_batch(columns, ["id", "n", "s1", "s2", "m", "prefix", "wide", *LANES])

    lanes = ", ".join(f"{k} bigint" for k in LANES)
    return written(docs.mapInArrow(run, f"id bigint, n bigint, s1 bigint, s2 bigint, m int, prefix array<bigint>, wide array<bigint>, {lanes}"), "profile", batch_rows=TEXT_ROWS)


def entries(prof: DataFrame) -> DataFrame:
    """ENTRY: the prefix tokens that different sets have, and a few others that share their place in a bitmap."""
    prof = prof.where("size(prefix) > 0")
    shared = prof.select(F.explode("prefix").alias("token"), "s1").groupBy("token").agg(F.min("s1").alias("least"), F.max("s1").alias("most")).where("least <> most")
    bitmap = bitmap_of(shared, F.shiftrightunsigned("token", 38))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            size = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy().view(U64)
            row = np.repeat(np.arange(len(batch)), size)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            keep = held(bitmap.value, token)
            yield pa.record_batch([pa.array(token[keep].view(np.int64)), pa.array(pos[keep].astype(np.int32)), *(batch.column(c).take(pa.array(row[keep])) for c in ENTRY[2:])], ENTRY)

    lanes = ", ".join(f"{k} bigint" for k in LANES)
    return prof.select("prefix", "id", "s1", F.col("n").cast("int").alias("n"), "m", *LANES).mapInArrow(run, f"token bigint, pos int, id bigint, s1 bigint, n int, m int, {lanes}")


def close(percent: int) -> Column:
    """Of entries x and y of a block: a token within the pair's prefixes, and sets that may be near enough."""
    need = overlap_needed(percent)
    return F.expr(f"x.pos < x.n - {need} + least(x.m, y.m) and y.pos < y.n - {need} + least(x.m, y.m)") & near_enough(percent, LANES)


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int, key: int) -> DataFrame:
    """The pairs (a, b) whose sets, made from their texts, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.record_batch([pa.concat_arrays([batch.column("x"), batch.column("y")])], ["t"])
            found: list[np.ndarray] = []
            for _, w in slices(iter([both]), "t", True, SLICE, key):
                _, token, counts = sets(w, width)
                found.extend(np.split(token, np.cumsum(counts)[:-1]))
            good = []
            for x, y in zip(found[: len(batch)], found[len(batch) :], strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = docs.where(may_hold(pairs.select(F.explode(F.array("a", "b")).alias("p")), F.xxhash64("p"), F.xxhash64("id")))
    x, y = texts.select(F.col("id").alias("a"), F.col("t").alias("x")), texts.select(F.col("id").alias("b"), F.col("t").alias("y"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "links", batch_rows=PAIR_ROWS)


def possible(pairs: DataFrame, prof: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ..) whose wide sketches don't rule the similarity out; sketches travel, texts don't."""
    held = prof.where("wide is not null").select("id", "n", "wide")
    held = held.where(may_hold(pairs.select(F.explode(F.array("a", "b")).alias("p")), F.xxhash64("p"), F.xxhash64("id")))
    x, y = (held.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"w_{c}")) for c in ("a", "b"))
    differ = F.aggregate(F.zip_with("w_a", "w_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    both = pairs.join(x, "a").join(y, "b").where(differ <= F.col("n_a") + F.col("n_b") - 2 * need)
    return both.select(*pairs.columns).distinct()


def joined_up(first: DataFrame, pairs: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The components (node, component) after comparing pairs (a, ca, b, cb, shared) of different ones.

    Of two components the pair that shares most goes first; the others are compared only if the two stay apart.
    """
    lead = pairs.groupBy(F.least("ca", "cb").alias("p"), F.greatest("ca", "cb").alias("q")).agg(F.max(F.struct("shared", "a", "b")).alias("x")).select("x.a", "x.b")
    lead = written(lead, "pairs")
    stars = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    second = components(stars.unionByName(check(lead)))
    name = lambda c: second.select(F.col("node").alias(c), F.col("component").alias(f"now_{c}"))
    apart = F.coalesce("now_a", "a") != F.coalesce("now_b", "b")
    rest = written(pairs.join(name("a"), "a", "left").join(name("b"), "b", "left").where(apart).select("a", "b").join(lead, ["a", "b"], "left_anti"), "pairs")
    discard(lead)
    if rest.isEmpty():
        return second
    stars = second.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(check(rest)))


def link(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every document; component_id is the smallest id reachable over links."""
    docs, key = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")), new_key()
    prof = profile(docs, width, percent, key)
    rows = prof.select("id", "n", "s1", "s2")
    classes = written(rows.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("d")), "classes")
    later = rows.join(classes, ["s1", "s2"]).where("id > d").select("id", "s1").distinct()
    sent = written(entries(prof).join(later, ["id", "s1"], "left_anti").drop("s1"), "postings")

    def check(pairs: DataFrame) -> DataFrame:
        return verify(pairs, docs, width, percent, key)

    # the most central document of a block is the one whose prefix has least before the block's token
    hubs = sent.groupBy("token").agg(F.min(F.struct("pos", "id", "n", "m", *LANES)).alias("h"), F.count("*").alias("many")).where("many > 1").select("token", "h.*")
    near = sent.alias("x").join(hubs.alias("y"), F.expr("x.token = y.token and x.id <> y.id") & close(percent)).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).count()
    near = written(near.groupBy("a").agg(F.max(F.struct("count", "b")).alias("best")).select("a", "best.b"), "pairs")
    first = components(check(near))
    discard(near)
    marked = written(sent.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "postings")
    discard(sent)
    hub_class = marked.groupBy("token").agg(F.min(F.struct("pos", "id", "c")).alias("h")).select("token", F.col("h.c").alias("hc"))
    open_ = marked.join(hub_class, "token").where("c <> hc").drop("hc")
    pairs = open_.alias("x").join(marked.alias("y"), F.expr("x.token = y.token and x.c <> y.c") & close(percent))
    ends = F.array_sort(F.array(F.struct("x.id", "x.c"), F.struct("y.id", "y.c")))
    pairs = pairs.select(ends.alias("e"), "x.token", F.least("x.m", "y.m").alias("m")).groupBy("e").agg(F.countDistinct("token").alias("shared"), F.min("m").alias("need")).where("shared >= need")
    pairs = written(pairs.select(*(F.col("e")[i][k].alias(n) for i, k, n in ((0, "id", "a"), (0, "c", "ca"), (1, "id", "b"), (1, "c", "cb"))), "shared"), "pairs")
    discard(marked)
    if not pairs.isEmpty():
        was, pairs = pairs, written(possible(pairs, prof, percent), "pairs")
        discard(was)
    found = first if pairs.isEmpty() else joined_up(first, pairs, check)
    named = classes.join(found.withColumnRenamed("node", "d"), "d", "left").select("s1", "s2", F.coalesce("component", "d").alias("component_id"))
    out = rows.join(named, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose component has a smaller id, with all their columns."""
    name = fresh(docs.columns, "gone_id")
    gone = link(docs, width, percent, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
