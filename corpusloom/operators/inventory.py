"""Inventory and identity: snapshots compared, copies and moves inferred, tables brought up to date.

All functions take and give DataFrames. Keys decide what is the same row; ties are broken by stated columns, never by
the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(files: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """(by.., n, first_id, last_id): groups of rows that agree on `by`."""
    return files.groupBy(*by).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where(F.col("n") >= least)


def twins(files: DataFrame) -> DataFrame:
    """(path, twins): how many other paths hold the same content; a count, not the pairs themselves."""
    one = files.select("hash", "path").distinct()
    n = one.groupBy("hash").agg((F.count("*") - 1).alias("twins")).where("twins > 0")
    return one.join(n, "hash").select("path", "twins")


def infer_events(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, event): rescanned, modified, probable_copy, probable_move or created, against an earlier snapshot."""
    old = before.groupBy("path").agg(F.max("hash").alias("old_hash"))
    there = now.select(F.col("path").alias("there")).distinct()
    known = before.select("hash", F.col("path").alias("old_path")).distinct().join(there, F.col("old_path") == F.col("there"), "left")
    known = known.groupBy("hash").agg(F.bool_or(F.col("there").isNotNull()).alias("still"))
    new = now.groupBy("path").agg(F.max("hash").alias("hash"))
    df = new.join(old, "path", "left").join(known, "hash", "left")
    event = F.when(F.col("old_hash") == F.col("hash"), "rescanned").when(F.col("old_hash").isNotNull(), "modified").when(F.col("still"), "probable_copy").when(F.col("still").isNotNull(), "probable_move").otherwise("created")
    return df.select("path", event.alias("event"))


def snapshot_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(event, path, old_path): created, deleted, modified and moved between snapshots (path, hour, size).

    A vanished and a new path with the same time and size are one move; several of them are matched in path order.
    """
    a = before.groupBy("path").agg(F.max("hour").alias("hour_a"), F.max("size").alias("size_a"))
    b = now.groupBy("path").agg(F.max("hour").alias("hour_b"), F.max("size").alias("size_b"))
    both = a.join(b, "path", "full")
    changed = both.where("hour_a <> hour_b or size_a <> size_b").select(F.lit("modified").alias("event"), "path", F.lit(None).cast("string").alias("old_path"))
    rank = lambda side: F.row_number().over(Window.partitionBy(f"hour_{side}", f"size_{side}").orderBy("path"))
    gone = both.where("hour_b is null").select(F.col("path").alias("old_path"), F.col("hour_a").alias("hour"), F.col("size_a").alias("size"), rank("a").alias("nth"))
    new = both.where("hour_a is null").select("path", F.col("hour_b").alias("hour"), F.col("size_b").alias("size"), rank("b").alias("nth"))
    pairs = new.join(gone, ["hour", "size", "nth"], "full")
    event = F.when(F.col("old_path").isNull(), "created").when(F.col("path").isNull(), "deleted").otherwise("moved")
    moved = pairs.select(event.alias("event"), F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"))
    return changed.unionByName(moved)


def unseen(now: DataFrame, before: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose path and time aren't in the earlier snapshot."""
    old = before.select(F.col("path").alias("_path"), F.col("hour").alias("_hour"))
    return now.join(old, (F.col("path") == F.col("_path")) & (F.abs(F.col("hour") - F.col("_hour")) <= tolerance), "left_anti")


def to_sync(now: DataFrame, state: DataFrame, drift: float = 0.5) -> DataFrame:
    """(path, reason): files that are new, or differ in size, or in time by more than drift."""
    old = state.groupBy("path").agg(F.max("hour").alias("_hour"), F.max("size").alias("_size"))
    new = now.groupBy("path").agg(F.max("hour").alias("hour"), F.max("size").alias("size"))
    reason = F.when(F.col("_size").isNull(), "new").when(F.col("size") != F.col("_size"), "size").when(F.abs(F.col("hour") - F.col("_hour")) > drift, "time")
    return new.join(old, "path", "left").select("path", reason.alias("reason")).where("reason is not null")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by `order`."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def upsert_seen(table: DataFrame, batch: DataFrame, key: str, value: str, now: int) -> DataFrame:
    """(key, value, first_seen, last_seen): the batch replaces values, keeps first_seen and moves last_seen."""
    new = batch.groupBy(key).agg(F.max(value).alias("_new"))
    df = table.join(new, key, "full")
    return df.select(key, F.coalesce("_new", value).alias(value), F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(F.col("_new").isNull(), F.col("last_seen")).otherwise(F.lit(now)).alias("last_seen"))


def insert_absent(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The rows of the batch whose key the table lacks."""
    return batch.join(table.select(key).distinct(), key, "left_anti")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with the changes' values that aren't null; keys that only the changes have are left out."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    df = table.join(new, key, "left")
    return df.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in table.columns))


def profile_of(paths: DataFrame, profiles: DataFrame, default: str) -> DataFrame:
    """(path, profile): the profile with the longest root above the path.

    The path's ancestors are exploded and joined by equality, so no pair of path and unrelated root is looked at.
    """
    parts = F.split("path", "/")
    above = paths.select("path").distinct().select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "prefix"))
    found = above.join(profiles, F.col("prefix") == F.col("profile_root")).groupBy("path").agg(F.max_by("profile", "depth").alias("found"))
    return paths.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("found", F.lit(default)).alias("profile"))


def drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, state) of paths that one copy lacks or holds with other content."""
    a, b = left.groupBy("path").agg(F.max("hash").alias("a")), right.groupBy("path").agg(F.max("hash").alias("b"))
    state = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("a") != F.col("b"), "diverged")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state is not null")


def copies_compared(files: DataFrame, copy: str, rel: str) -> DataFrame:
    """(rel, copies, contents): in how many copies of a tree a relative path is, and how many contents it has."""
    return files.groupBy(rel).agg(F.countDistinct(copy).alias("copies"), F.countDistinct("hash").alias("contents"))


def folder_trees(files: DataFrame) -> DataFrame:
    """(copy, dir, parent, n, t1, t2) of every folder of trees (copy, rel, hash), the root's dir is "": n files below, and 128 bits that depend on their relative paths and contents alone.

    A file adds the hash of its path below the folder and its content to each folder above it by exclusive or, so that
    tasks add up parts of a large tree in any order, and no folder's files are gathered.
    """
    parts = F.split("rel", "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("inside")))
    each = files.select("copy", "hash", F.explode(levels).alias("x")).select("copy", "x.dir", F.sha2(F.concat_ws("\n", "x.inside", "hash"), 256).alias("h"))
    bits = lambda at: F.conv(F.substring("h", at, 16), 16, -10).cast("bigint")
    trees = each.groupBy("copy", "dir").agg(F.count("*").alias("n"), F.bit_xor(bits(1)).alias("t1"), F.bit_xor(bits(17)).alias("t2"))
    parent = F.when(F.contains("dir", F.lit("/")), F.regexp_replace("dir", "/[^/]*$", "")).when(F.col("dir") != "", "")
    return trees.select("copy", "dir", parent.alias("parent"), "n", "t1", "t2")


def same_trees(files: DataFrame) -> DataFrame:
    """(copy, dir, n, first): folders whose whole tree is found elsewhere too, named by the first place (copy:dir) that has it; only the topmost of nested ones.

    files: (copy, rel, hash), one row a copy and path. A tree below one that is itself repeated is left out.
    """
    trees = folder_trees(files)
    place = F.concat_ws(":", "copy", "dir")
    groups = trees.groupBy("t1", "t2", "n").agg(F.count("*").alias("many"), F.min(place).alias("first")).where("many > 1")
    found = trees.join(groups, ["t1", "t2", "n"]).select("copy", "dir", "parent", "n", "first")
    above = found.select("copy", F.col("dir").alias("parent"))
    return found.join(above, ["copy", "parent"], "left_anti").select("copy", "dir", "n", "first")


def tree_differences(files: DataFrame) -> DataFrame:
    """(rel, copy, state): `unique` files that one copy alone has, and `divergent` ones that several have with different contents; a row a copy."""
    counts = files.groupBy("rel").agg(F.count("*").alias("copies"), (F.min("hash") != F.max("hash")).alias("differ"))
    state = F.when(F.col("copies") == 1, "unique").when(F.col("differ"), "divergent")
    return files.join(counts.withColumn("state", state).where("state is not null").select("rel", "state"), "rel").select("rel", "copy", "state")


def folder_fingerprint(files: DataFrame) -> DataFrame:
    """(root, dir, n_files, fingerprint): the hash of a folder's sorted names."""
    names = F.array_sort(F.collect_set("name"))
    return files.groupBy("root", "dir").agg(F.countDistinct("name").alias("n_files"), names.alias("names")).select("root", "dir", "n_files", F.substring(F.sha1(F.array_join("names", "\n").cast("binary")), 1, 16).alias("fingerprint"))


def histograms(files: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): counts of each column's values, in one pass over the rows."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return files.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def folder_summary(files: DataFrame) -> DataFrame:
    """(root, dir, n, bytes, n_ext, top_ext, oldest, newest, duplicate_share, strategy) of each folder."""
    exts = latest(files.groupBy("root", "dir", "ext").agg(F.count("*").alias("k")), ["root", "dir"], F.desc("k"), F.col("ext")).select("root", "dir", F.col("ext").alias("top_ext"))
    sums = files.groupBy("root", "dir").agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"), F.countDistinct("ext").alias("n_ext"), F.min("day").alias("oldest"), F.max("day").alias("newest"), F.countDistinct("hash").alias("h"))
    tier = F.when(F.col("n") <= 10, "every_file").when(F.col("n") <= 100, "sampled").otherwise("statistics")
    return sums.join(exts, ["root", "dir"]).select("root", "dir", "n", "bytes", "n_ext", "top_ext", "oldest", "newest", F.round((F.col("n") - F.col("h")) / F.col("n"), 6).alias("duplicate_share"), tier.alias("strategy"))


def folder_distributions(files: DataFrame, columns: list[str]) -> DataFrame:
    """(root, dir, part, value, n, share): how often each value of the columns is in each folder, null as `none`."""
    values = F.array(*(F.struct(F.lit(c).alias("part"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns))
    counts = files.select("root", "dir", F.explode(values).alias("x")).groupBy("root", "dir", "x.part", "x.value").agg(F.count("*").alias("n"))
    total = files.groupBy("root", "dir").agg(F.count("*").alias("total"))
    return counts.join(total, ["root", "dir"]).select("root", "dir", "part", "value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def folder_diagnosis(files: DataFrame, families: dict[str, list[str]], least: float = 0.6) -> DataFrame:
    """(root, dir, family, share): the family of content that makes up at least `least` of a folder, or mixed."""
    share = {k: F.count_if(F.col("ext").isin(v)) / F.count("*") for k, v in families.items()}
    df = files.groupBy("root", "dir").agg(*(s.alias(k) for k, s in share.items()))
    family = F.lit("mixed")
    top = F.greatest(*(F.col(k) for k in families)) if len(families) > 1 else F.col(next(iter(families)))
    for k in reversed(families):
        family = F.when((F.col(k) >= least) & (F.col(k) == top), k).otherwise(family)
    return df.select("root", "dir", family.alias("family"), F.round(top, 6).alias("share"))


def sample_large(files: DataFrame, ends: int = 50, share: float = 0.05, danger: str = "(?i)(password|secret|final)") -> DataFrame:
    """(root, dir, path): of each folder the first and last names, the largest files and dangerous names."""
    w = Window.partitionBy("root", "dir")
    df = files.withColumns({"up": F.row_number().over(w.orderBy("name", "doc_id")), "down": F.row_number().over(w.orderBy(F.desc("name"), F.desc("doc_id"))), "rank": F.percent_rank().over(w.orderBy(F.desc("size")))})
    return df.where((F.col("up") <= ends) | (F.col("down") <= ends) | (F.col("rank") <= share) | F.col("name").rlike(danger)).select("root", "dir", "path")


def facets(items: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, vals): the sorted different values of each column, arrays exploded by the caller."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return items.select(each.alias("x")).select("x.*").where("value is not null").distinct().groupBy("facet").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("vals"))


def next_codes(batch: DataFrame, used: DataFrame, code: str, order: str, floor: int) -> DataFrame:
    """The batch with codes that go on from the largest used one, in `order`, whose values differ; rows without an order come first.

    The batch is parted by range; a small table of the partitions' sizes gives each its first number.
    """
    top = used.agg(F.greatest(F.coalesce(F.max(code), F.lit(floor - 1)), F.lit(floor - 1)).alias("top"))
    parts = batch.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    bounds = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min(order).alias("least"))
    before = bounds.select("least", (F.sum("n").over(Window.orderBy("least")) - F.col("n")).alias("before"), F.lead("least").over(Window.orderBy("least")).alias("next"))
    # the first range is open below, so that it holds rows without an order too
    before = before.withColumn("least", F.when(F.row_number().over(Window.orderBy("before")) > 1, F.col("least")))
    mine = batch.join(F.broadcast(before), (F.col("least").isNull() | (F.col(order) >= F.col("least"))) & (F.col("next").isNull() | F.coalesce(F.col(order) < F.col("next"), F.lit(True))))
    nth = F.row_number().over(Window.partitionBy("least").orderBy(order))
    return mine.withColumn("_nth", nth + F.col("before")).crossJoin(F.broadcast(top)).withColumn(code, F.col("top") + F.col("_nth")).select(*batch.columns, code)


def state_log(events: DataFrame) -> DataFrame:
    """(key, seq, from_kind, kind, attempts): each event with the one before and the number of modified ones so far."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    return events.select("key", "seq", F.lag("kind").over(w).alias("from_kind"), "kind", F.count_if(F.col("kind") == "modified").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("attempts"))
