"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line's set holds its different words. A line goes when an earlier one (of a smaller document id, or of the same
document further up) has a Jaccard similarity of at least `percent` / 100 (over 50) with it. Lines are judged on the
input: a line that goes still counts as an earlier one. Every line with a word takes part, however short.

Words are ordered by their frequency in all documents, rare ones first, as buckets of words have it; any order gives
the same result, so the counts decide only how many lines meet in vain. Keyed hashes break ties. Single words of a
prefix are in too many lines of a large corpus, so the prefix holds runs of k words that are next to each other in this
order. A word that one of two sets lacks breaks up to k of the other's runs, so of two sets that are similar enough one
of the first kn (100 - percent) / 100 + 1 runs of the one is among those of the other. Runs are pairs where the smaller
set is large enough for them (`tiers`; at 80 percent from 4 words on), else single words. Sets that share a prefix run
meet in a block, and must pass the length filter and parity sketches of 64 bits (128 where both sets are long), which
bound how many words they share. Then the words themselves are compared.

Equal sets form one class with its earliest line, which alone sends its runs. A run is first looked for in a bitmap of
those that several classes have. A window over each block compares every class with the earliest and the two before it
by sketches, and each class with the earliest line found so by words. Classes that found no match there are looked up
among all earlier ones of their blocks, by semi-joins that end at the first match: first by sketches, then by words. So
a block of near copies isn't paired out, even if its first line is none of them.

Null texts have no lines and stay null. Rows that share an id are judged as one document: a line's number goes in all
of them or in none. Rows without an id stay as they are. Lines without words stay. An empty table gives an empty
result. Extra columns are kept by `dedup`, whatever their names, and dropped by `report`. Texts of any length are read
whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bitmap import may_hold
from ._sets import LANES as _FOUR
from ._sets import overlap_needed
from ._store import discard, fresh, written
from ._words import new_key

PERCENT = 80
#: Sketches: k1 has all words, k2 half of them, and only in sets of more than LONG words.
LANES, LONG = _FOUR[:2], 64
#: Words of the longest runs.
LONGEST_RUN = 2
#: All words are counted in 2^ORDER_BITS buckets; the top LEVEL_BITS of a word's place in the order tell the count's size, in units of UNIT words.
ORDER_BITS, UNIT, LEVEL_BITS = 16, 16, 4
#: The bitmap of shared runs has 2^RUN_BITS longs, eight megabytes; that of runs still looked up 2^OPEN_BITS, two.
RUN_BITS, OPEN_BITS = 20, 18
_PART = "[\\x20\\x09-\\x0D]+"


def tiers(percent: int) -> list[tuple[int, int]]:
    """(k, n): runs of k words are sure to meet when the smaller set has n words or more; the longest first."""
    miss = 100 - percent
    sure = [k for k in range(LONGEST_RUN, 1, -1) if k * percent >= 100 * (k - 1) and k * miss < 100]
    return [*((k, -(-100 * k // (100 - k * miss))) for k in sure), (1, 1)]


def run_sizes(percent: int, n: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each tier k, how many runs each set of n words sends: its prefix where a set it may match has the tier, else 0."""
    out, below = [], np.full(len(n), 1 << 62, np.int64)
    least = -(-percent * n // 100)  # of the smallest set that it may match
    near = 100 * n >= percent * (n + 1)  # smaller ones match equal sets only
    for k, n0 in tiers(percent):
        uses = near & (n >= n0) & (least < below)
        out.append((k, np.where(uses, np.minimum(n - k + 1, k * n * (100 - percent) // 100 + 1), 0)))
        below = np.full(len(n), n0, np.int64)
    return out


def trimmed(line: str) -> Column:
    return F.btrim(F.col(line), F.lit(" \t\n\x0b\x0c\r"))


def keyed(key: int, value: str) -> str:
    """SQL: a hash that depends on the key as well."""
    return f"xxhash64({key}L, {value})"


def prefix_runs(percent: int, key: int) -> Column:
    """The runs that a set with n words sends, by `run_sizes`; w has its words' places, in order."""
    least, near, below, parts = f"({percent} * n + 99) div 100", f"100L * n >= {percent}L * (n + 1)", None, []
    for k, n0 in tiers(percent):
        uses = f"{near} and n >= {n0}" + (f" and {least} < {below}" if below else "")
        size = f"least(n - {k - 1}, cast({k * (100 - percent)}L * n div 100 + 1 as int))"
        run = keyed(key + k, ", ".join(f"w[i + {j}]" for j in range(k)))
        parts.append(f"case when {uses} then transform(sequence(0, {size} - 1), i -> {run}) else cast(array() as array<bigint>) end")
        below = n0
    return F.expr(f"concat({', '.join(parts)})")


def bucket(key: int, word: str) -> Column:
    return F.shiftrightunsigned(F.expr(keyed(key, word)), 64 - ORDER_BITS)


def levels(docs: DataFrame, key: int) -> bytes:
    """For each bucket, the size of its count of words, as a power of two."""
    words = docs.select(F.explode(F.split("t", _PART)).alias("x")).where("x <> ''")
    counts = words.groupBy(bucket(key, "x").alias("b")).agg(F.count("*").alias("c"))
    every = docs.sparkSession.range(1 << ORDER_BITS).withColumnRenamed("id", "b").join(counts, "b", "left")
    level = F.least(F.ceil(F.log2(1 + F.coalesce("c", F.lit(0)) / UNIT)), F.lit((1 << LEVEL_BITS) - 1))
    text = every.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", F.char(level).alias("c")))), lambda x: x["c"]), "").alias("levels"))
    return written(text, "levels").first().levels.encode("ascii")


def places(key: int, level_of: bytes) -> Column:
    """The words' places in the order, from the array x of words."""

    def place(word: Column) -> Column:
        value = F.xxhash64(F.lit(key), word)
        level = F.ascii(F.substring(F.lit(level_of), F.shiftrightunsigned(value, 64 - ORDER_BITS).cast("int") + 1, F.lit(1)).cast("string"))
        return F.shiftleft(level.cast("bigint"), 63 - LEVEL_BITS).bitwiseOR(F.shiftrightunsigned(value, LEVEL_BITS + 1))

    return F.sort_array(F.array_distinct(F.transform("x", place)))


def close(percent: int) -> Column:
    """Of entries x and y: sizes that can reach the similarity, and sketches that don't rule it out."""
    differ = f"case when least(x.n, y.n) > {LONG} then bit_count(x.k1 ^ x.k2 ^ y.k1 ^ y.k2) + bit_count(x.k2 ^ y.k2) else bit_count(x.k1 ^ y.k1) end"
    return F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {differ} <= x.n + y.n - 2 * {overlap_needed(percent)}")


def profile(docs: DataFrame, percent: int) -> DataFrame:
    """(id, line, n, s1, s2, LANES, runs) of every line with a word: its number of different words, signatures of its set, parity sketches, prefix runs."""
    key = new_key() >> 2
    # two sets that differ in d words differ in at most d bits
    lanes = ["aggregate(w, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))", f"case when n > {LONG} then aggregate(w, 0L, (a, x) -> a ^ shiftleft(shiftrightunsigned(x, 6) & 1L, cast(x & 63 as int))) else 0L end"]
    lines = docs.select("id", F.posexplode(F.split("t", "\n")).alias("line", "x")).select("id", "line", trimmed("x").alias("x")).where("x <> ''")
    sets = lines.select("id", "line", F.split("x", _PART).alias("x")).select("id", "line", places(key, levels(docs, key)).alias("w")).select("id", "line", "w", F.size("w").alias("n"))
    found = [F.expr(keyed(key + 8 + i, "w")).alias(f"s{i + 1}") for i in range(2)] + [F.expr(x).alias(k) for k, x in zip(LANES, lanes, strict=True)]
    return written(sets.select("id", "line", "n", *found, prefix_runs(percent, key + 16).alias("runs")), "lines")


def entries(lines: DataFrame) -> DataFrame:
    """(run, id, line, n, LANES): the prefix runs that several sets have, and a few others that share their place in a bitmap."""
    shared = lines.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("many")).where("many > 1")
    every = lines.select(F.explode("runs").alias("run"), "id", "line", "n", *LANES)
    return every.where(may_hold(shared, F.col("run"), F.col("run"), RUN_BITS))


def met(sent: DataFrame, percent: int) -> DataFrame:
    """Entries with their number in the block (nth), and the first that passes the filters of the block's earliest and the two before (id2, line2)."""
    by = Window.partitionBy("run").orderBy("id", "line")
    one = F.struct("id", "line", "n", *LANES)
    ahead = [F.first(one).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lag(one, 1).over(by), F.lag(one, 2).over(by)]
    rows = sent.select("*", one.alias("x"), F.row_number().over(by).alias("nth"), *(x.alias(f"y{i}") for i, x in enumerate(ahead)))
    for i in range(len(ahead)):
        rows = rows.withColumn("y", F.col(f"y{i}")).withColumn(f"y{i}", F.when(F.expr("x.id > y.id or x.id = y.id and x.line > y.line") & close(percent), F.struct("y.id", "y.line")))
    found = F.coalesce(*(F.col(f"y{i}") for i in range(len(ahead))))
    return rows.select(*sent.columns, "nth", found["id"].alias("id2"), found["line"].alias("line2"))


def texts(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, line, x): the lines that ends (id, line) names, and a few others."""
    lines = docs.where(may_hold(ends, F.xxhash64("id"), F.xxhash64("id"))).select("id", F.posexplode(F.split("t", "\n")).alias("line", "x"))
    return lines.where(may_hold(ends, F.xxhash64("id", "line"), F.xxhash64("id", "line")))


def words(line: str) -> Column:
    return F.array_distinct(F.split(trimmed(line), _PART))


def alike(percent: int, x: str, y: str) -> Column:
    """Whether two arrays of different words are similar enough."""
    shared = F.size(F.array_intersect(x, y))
    return 100 * shared >= percent * (F.size(x) + F.size(y) - shared)


def similar(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, line) of the pairs whose words are similar enough to those of (id2, line2); the words are read from the texts."""
    ends = pairs.select("id", "line").unionByName(pairs.select(F.col("id2").alias("id"), F.col("line2").alias("line"))).distinct()
    x = written(texts(docs, ends).select("id", "line", words("x").alias("x")), "words")
    both = pairs.join(x, ["id", "line"]).join(x.withColumnsRenamed({"id": "id2", "line": "line2", "x": "y"}), ["id2", "line2"])
    out = written(both.where(alike(percent, "x", "y")).select("id", "line"), "done")
    discard(x)
    return out


def find(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines): the numbers, from 0, of each document's lines that go."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    lines = profile(docs, percent)
    classes = written(lines.groupBy("s1", "s2").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("lines")).where("lines > 1"), "classes")
    again = written(lines.select("id", "line", "s1", "s2").join(classes, ["s1", "s2"]), "again")
    discard(classes)
    later = again.where(F.struct("id", "line") > F.col("first")).select("id", "line").distinct()
    # only the first line of a class sends its runs; most lines are told to be no later ones by a bitmap, and don't travel
    sending = lines.where("size(runs) > 0").drop("s1", "s2")
    perhaps = may_hold(later, F.xxhash64("id", "line"), F.xxhash64("id", "line"))
    sending = sending.where(~perhaps).unionByName(sending.where(perhaps).join(later, ["id", "line"], "left_anti"))
    blocks = written(met(entries(sending), percent), "blocks")
    discard(lines)

    near = written(blocks.where("id2 is not null").groupBy("id", "line").agg(F.min(F.struct("id2", "line2")).alias("y")).select("id", "line", "y.id2", "y.line2"), "near")
    done = similar(near, docs, percent)
    # the rest looks among all earlier lines of its blocks; those from the fifth on were not compared with all of them yet.
    # Semi-joins end at a line's first match, so groups of near copies aren't paired out: first by sketches, then by words
    mine = ["run", "id", "line", "n", *LANES]
    left = written(blocks.where("id2 is not null or nth > 4").select(*mine).join(done, ["id", "line"], "left_anti"), "left")
    others = blocks.where(may_hold(left, F.col("run"), F.col("run"), OPEN_BITS)).select(*mine)
    earlier = F.expr("x.run = y.run and (x.id > y.id or x.id = y.id and x.line > y.line)") & close(percent)
    maybe = written(left.alias("x").join(others.alias("y"), earlier, "left_semi"), "maybe")
    # of the earlier lines only those that pass the filters with one of these, so that few words travel
    others = written(others.alias("y").join(maybe.alias("x"), earlier, "left_semi"), "others")
    ends = maybe.unionByName(others).select("id", "line").distinct()
    known = written(texts(docs, ends).select("id", "line", words("x").alias("w")), "words")
    x, y = maybe.join(known, ["id", "line"]), others.join(known, ["id", "line"])
    deep = written(x.alias("x").join(y.alias("y"), earlier & alike(percent, "x.w", "y.w"), "left_semi").select("id", "line").distinct(), "deep")
    discard(blocks, near, left, maybe, others, known)
    gone = done.unionByName(deep)
    # all lines of a class that goes, and those after the first of every class
    members = again.join(gone.join(again.select("id", "line", "s1", "s2"), ["id", "line"]).select("s1", "s2").distinct(), ["s1", "s2"], "left_semi").select("id", "line")
    out = written(gone.unionByName(later).unionByName(members).groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("lines")), "gone")
    discard(again)
    return out


def dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, their texts without the lines that go."""
    name, lines = fresh(docs.columns, "gone_id"), fresh(docs.columns, "gone_lines")
    gone = find(docs, percent, id_col, text_col).withColumnsRenamed({"id": name, "lines": lines})
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n")
    df = docs.join(gone, F.col(id_col).cast("bigint") == F.col(name), "left")
    return df.select(*(F.when(F.col(lines).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every document; removed has the numbers of the lines that go, from 0."""
    gone = find(docs, percent).withColumnRenamed("id", "_id")
    rows = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"))
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return rows.join(gone, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_lines", F.size(lines).cast("bigint").alias("n_removed"), F.array_join(lines.cast("array<string>"), ",").alias("removed"))
