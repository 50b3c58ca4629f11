"""Folders and clusters: pressures, health, plans, identities, kill conditions, behaviour; names and records of files."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of equal pressures; kinds of files by first bytes (hex), by suffix and by marks of code; codes and thresholds of names.
PRESSURES = ["rename_cleanup", "duplicate_cleanup", "archive_pressure", "routing_pressure", "metadata_fill_pressure", "manual_review_pressure"]
SIGNATURES = [
    ("255044462D", "document", "pdf_signature"), ("504B0304", "archive", "zip_signature"), ("89504E470D0A1A0A", "media", "png_signature"), ("FFD8FF", "media", "jpeg_signature"),
    ("474946383761", "media", "gif_signature"), ("474946383961", "media", "gif_signature"), ("1F8B", "archive", "gzip_signature"),
]
CATEGORIES = {
    "text": [".txt", ".md", ".rst", ".log"], "code": [".py", ".js", ".ts", ".html", ".css"], "data": [".json", ".csv", ".xml", ".yaml", ".yml", ".sql"], "document": [".pdf", ".doc", ".docx", ".rtf", ".xlsx"],
    "media": [".jpg", ".jpeg", ".png", ".gif", ".mp3", ".mp4"], "archive": [".zip", ".gz", ".tar", ".7z", ".rar"],
}
CODE_MARKS = ["#!/usr/bin/env", "#!/bin/", "import ", "def ", "function ", "const ", "class "]
TYPE_CODES = {"document": "DOC", "code": "COD", "data": "DAT", "note": "NOT", "config": "CFG", "paper": "PAP", "image": "IMG", "video": "VID", "audio": "AUD", "binary": "BIN"}
STATE_CODES = {"draft": "DR", "active": "AC", "final": "FN", "archive": "AR", "review": "RV"}
CERTAIN = [".py", ".js", ".ts", ".ahk", ".json", ".csv", ".sqlite", ".db", ".md", ".txt", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".mp4", ".mov", ".avi", ".mkv", ".mp3", ".wav", ".flac"]
PROVENANCE = ["staging", "draft", "work", "temp", "tmp", "old", "backup", "bak"]
LAYERS = ["story", "highschool", "college", "phd", "doctoral", "technical", "reading_layers"]
MARKERS = [".git", "package.json", "requirements.txt", "pyproject.toml", "cargo.toml"]
APPROVE, QUEUE, REJECTED, LONGEST_NAME = 0.72, 0.45, 0.25, 180
WEIGHTS = {"F": 2, "N": 3, "E": 1, "C": 3, "H": 5, "T": 1, "P": 2, "Role": 1}


def pressures(records: DataFrame) -> DataFrame:
    """(root, dir, n, pressures.., dominant, health, churn, drivers) of folders.

    records: (root, dir, name, ext, hash, hour, tagged, routed, queued). Health loses the share of repeated and queued
    files, at most 0.7; churn is the spread of the times for each file; the dominant pressure is the first of equals.
    """
    d = records.groupBy("root", "dir").agg(
        F.count("*").alias("n"), F.count_if(F.contains("name", F.lit(" "))).alias("rename_cleanup"), (F.count("*") - F.countDistinct("hash")).alias("duplicate_cleanup"), F.count_if(F.col("ext").isin(".zip", ".rar", ".7z", ".tar", ".gz")).alias("archive_pressure"),
        F.count_if(~F.col("routed")).alias("routing_pressure"), F.count_if(~F.col("tagged")).alias("metadata_fill_pressure"), F.count_if("queued").alias("manual_review_pressure"), F.max("hour").alias("newest"), F.min("hour").alias("oldest"),
    )
    scores = F.array(*PRESSURES)
    dominant = F.element_at(F.array(*map(F.lit, PRESSURES)), F.array_position(scores, F.array_max(scores)).cast("int"))
    health = F.round(1 - F.least(F.lit(0.7), (F.col("duplicate_cleanup") + F.col("manual_review_pressure")) / F.col("n")), 3)
    churn = F.when(F.col("n") < 2, 0.0).otherwise(F.round((F.col("newest") - F.col("oldest")) / F.col("n"), 3))
    drivers = F.array_join(F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(x)) for c, x in (("duplicate_cleanup", "duplicates"), ("manual_review_pressure", "manual_review_queue"), ("metadata_fill_pressure", "missing_metadata"))))), ",")
    return d.select("root", "dir", "n", *PRESSURES, dominant.alias("dominant"), health.alias("health"), churn.alias("churn"), drivers.alias("drivers"))


def score_changes(scans: DataFrame) -> DataFrame:
    """(root, scanned_at, score, change): against the scan before; null for the first."""
    return scans.select("root", "scanned_at", "score", (F.col("score") - F.lag("score").over(Window.partitionBy("root").orderBy("scanned_at"))).alias("change"))


def identities(now: DataFrame, before: DataFrame) -> DataFrame:
    """(folder_id, dir, moved, previous): folders by their id; a moved one keeps the id and adds its earlier path to the previous ones."""
    old = before.select("folder_id", F.col("dir").alias("old"), "previous")
    df = now.join(old, "folder_id", "left")
    moved = F.coalesce(F.lower("old") != F.lower("dir"), F.lit(False))
    previous = F.coalesce("previous", F.array().cast("array<string>"))
    return df.select("folder_id", "dir", moved.alias("moved"), F.array_join(F.when(moved, F.array_union(previous, F.array("old"))).otherwise(previous), ",").alias("previous"))


def plans(findings: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """(root, symptoms, plan): a folder's symptoms with their counts, and the steps (symptom, step) that they call for, in order."""
    counts = findings.groupBy("root", "symptom").agg(F.countDistinct("unit").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("symptom", "n")))
    df = counts.groupBy("root").agg(rows.alias("a"))
    has = lambda s: F.exists("a", lambda x: x["symptom"] == s)
    plan = F.array_join(F.array_compact(F.array(F.lit("back up"), *(F.when(has(s), F.lit(step)) for s, step in steps))), "; ")
    return df.select("root", F.array_join(F.transform("a", lambda x: F.concat_ws("=", x["symptom"], x["n"].cast("string"))), ",").alias("symptoms"), plan.alias("plan"))


def simple_symptoms(files: DataFrame) -> DataFrame:
    """(root, dir, symptoms): the second, coarser set of detectors, in one pass over the folders.

    Six or more extensions (S01), 200 files (S04), three versions of one stem (S02), repeated contents (C01), seven
    tenths media among ten files (C05), six tenths documents among 25 (C04).
    """
    stem = F.lower(F.regexp_replace("stem", r"(?i)[_\-\s]*(v\d+|final|copy|\(\d+\))$", ""))
    versions = files.groupBy("root", "dir", stem.alias("s")).count().groupBy("root", "dir").agg(F.max("count").alias("versions"))
    n = F.count("*")
    share = lambda exts: F.count_if(F.col("ext").isin(exts)) / n
    d = files.groupBy("root", "dir").agg(n.alias("n"), F.countDistinct("ext").alias("exts"), F.countDistinct("hash").alias("hashes"), share([".jpg", ".jpeg", ".png", ".gif", ".mp4", ".mov", ".mp3", ".wav"]).alias("media"), share([".md", ".txt", ".pdf", ".doc", ".docx", ".html"]).alias("docs")).join(versions, ["root", "dir"])
    found = F.array_compact(F.array(
        F.when(F.col("exts") >= 6, F.lit("S01")), F.when(F.col("n") >= 200, F.lit("S04")), F.when(F.col("versions") >= 3, F.lit("S02")), F.when(F.col("hashes") < F.col("n"), F.lit("C01")),
        F.when((F.col("n") >= 10) & (F.col("media") >= 0.7), F.lit("C05")), F.when((F.col("n") >= 25) & (F.col("docs") >= 0.6), F.lit("C04")),
    ))
    return d.select("root", "dir", F.array_join(found, ",").alias("symptoms")).where("symptoms <> ''")


def kills(pairs: DataFrame, files: DataFrame, roots: DataFrame, least: float = 0.12, words: list[str] | None = None, layers: list[str] | None = None) -> DataFrame:
    """(source, target, kills): why the folders of a pair (source, target, margin) must not be joined, sorted.

    roots (dir) are folders that hold a marker of a program; words are those of paths that tell of copies on their
    way, layers the folder names of reading levels, which two folders must have alike if both have some.
    """
    words, layers = words or PROVENANCE, layers or LAYERS
    e = files.select("dir", F.lower("name").alias("low"), F.replace(F.lower("stem"), F.lit(".canonical"), F.lit("")).alias("stem"), F.lower("ext").alias("ext"), "hash", "hour")
    src, tgt = e.withColumnRenamed("dir", "source"), e.withColumnRenamed("dir", "target")
    names = lambda df, key: df.groupBy(key).agg(F.count_distinct("low").alias("n"))
    one = lambda df, key: df.groupBy(key, "low").agg(F.min("hash").alias("h0"), F.max("hash").alias("h1"), F.max("hour").alias("hour"))
    a, b = one(src, "source"), one(tgt, "target").withColumnsRenamed({"h0": "g0", "h1": "g1", "hour": "later"})
    key = pairs.select("source", "target")
    both = key.join(a, "source").join(b, ["target", "low"]).groupBy("source", "target").agg(F.count("*").alias("same"), F.bool_or(F.least("h0", "g0") != F.greatest("h1", "g1")).alias("clash"), F.bool_or((F.col("later") > F.col("hour")) & ((F.col("h0") != F.col("g0")) | (F.col("h1") != F.col("g1")))).alias("newer"))
    inner = lambda k: one(e.withColumnRenamed("dir", k), k).groupBy(k).agg(F.bool_or(F.col("h0") != F.col("h1")).alias(f"own_{k}"))
    stems = lambda k: e.withColumnRenamed("dir", k).select(k, "stem", "ext").distinct()
    forms = key.join(stems("source"), "source").unionByName(key.join(stems("target"), "target").select("source", "target", "stem", "ext")).groupBy("source", "target", "stem").agg(F.countDistinct("ext").alias("x")).groupBy("source", "target").agg((F.max("x") > 1).alias("forms"))
    df = pairs.join(both, ["source", "target"], "left").join(forms, ["source", "target"], "left").join(inner("source"), "source", "left").join(inner("target"), "target", "left").join(names(src, "source"), "source", "left")
    path = F.lower(F.concat_ws("/", "dir", "name"))
    flags = files.groupBy("dir").agg(F.bool_or(path.rlike("|".join(words))).alias("passing"))
    level = F.array_join(F.array_sort(F.array_intersect(F.split(F.lower("dir"), "/"), F.array(*map(F.lit, layers)))), ",")
    flags = flags.withColumn("level", level).join(roots.select("dir").distinct().withColumn("program", F.lit(True)), "dir", "left")
    for k in ("source", "target"):
        df = df.join(flags.select(F.col("dir").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("passing", "level", "program"))), k, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    conflict = (F.col("source_level") != "") & (F.col("target_level") != "") & (F.col("source_level") != F.col("target_level"))
    found = F.array(
        F.when(yes("forms"), F.lit("format_variants_detected")), F.when(F.coalesce("same", F.lit(0)) == F.col("n"), F.lit("incoming_folder_subset_of_target")), F.when(F.col("margin") < least, F.lit("multiple_targets_low_rival_margin")),
        F.when(yes("source_program") | yes("target_program"), F.lit("protected_program_root_detected")), F.when(yes("source_passing"), F.lit("provenance_penalty_path_signal")), F.when(conflict, F.lit("reading_layer_conflict")),
        F.when(yes("clash") | yes("own_source") | yes("own_target"), F.lit("same_filename_different_hash")), F.when(yes("newer"), F.lit("target_newer_than_incoming")),
    )
    return df.select("source", "target", F.array_join(F.array_compact(found), ",").alias("kills"))


def behaviour(clusters: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(key, confidence, behaviour, kind) of clusters (key, the components F N E C H T P Role, safety, variants)."""
    weights = weights or WEIGHTS
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 * sum((w * F.coalesce(k, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)) / sum(weights.values())).cast("int")))
    c, s = F.col("confidence"), F.col("safety")
    act = F.when((c >= 90) & (s >= 90), "auto_execute_reversible").when((c >= 90) & (s >= 50), "stage_require_batch_approval").when(c >= 90, "link_logically_do_not_move").when(c >= 50, "suggest_cluster_no_destructive_action").otherwise("quarantine_logically")
    kind = F.when(F.col("H") > 0, "IDENTITY").when(F.col("variants") | (F.col("C") >= 0.45), "FAMILY").otherwise("PROJECT")
    return clusters.withColumn("confidence", confidence).select("key", "confidence", act.alias("behaviour"), kind.alias("kind"))


def manifest_report(actions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(part, value, n): actions by behaviour and resolutions by state."""
    one = lambda df, c, part: df.groupBy(F.lit(part).alias("part"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return one(actions, "behaviour", "behaviour").unionByName(one(resolutions, "state", "state"))


def first_of(rows: DataFrame, by: list[str], order: list[Column], most: int, parts: int = 64) -> DataFrame:
    """The first `most` rows of each group, with their place `nth`: first in parts, so that no group is ranked whole in one task."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    some = rows.withColumn("_part", part).withColumn("nth", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("nth") <= most).drop("_part", "nth")
    return some.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= most)


def node_summaries(matches: DataFrame, nodes: list[str], total: DataFrame, most: int = 30) -> DataFrame:
    """(node, n, share, top): documents that match each node, their share of all, and the best ones; nodes without any are there too."""
    spark = matches.sparkSession
    best = first_of(matches.select("node", "doc_id", "score"), ["node"], [F.desc("score"), F.asc("doc_id")], most)
    best = best.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("top"))
    sums = matches.groupBy("node").agg(F.count("*").alias("n")).join(best, "node")
    every = spark.createDataFrame([(n,) for n in nodes], "node string").join(sums, "node", "left").crossJoin(F.broadcast(total.agg(F.count("*").alias("total"))))
    n = F.coalesce("n", F.lit(0))
    return every.select("node", n.alias("n"), F.round(n / F.col("total"), 6).alias("share"), F.coalesce("top", F.lit("")).alias("top"))


def gate_report(gated: DataFrame, docs: DataFrame) -> DataFrame:
    """(category, overridden, n, sources): gate results counted, with the sources that they come from."""
    return gated.join(docs.select("doc_id", "source"), "doc_id").groupBy("category", "overridden").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def corpus(approved: DataFrame, reference: DataFrame, least: int, most: int = 300) -> DataFrame:
    """(ext, doc_id, origin): approved items of each extension; where there are fewer than `least`, reference ones as well; the surest `most` (a top-k)."""
    enough = approved.groupBy("ext").count().where(F.col("count") >= least).select("ext")
    both = approved.withColumn("origin", F.lit("approved")).unionByName(reference.join(enough, "ext", "left_anti").withColumn("origin", F.lit("reference")))
    nth = F.row_number().over(Window.partitionBy("ext").orderBy("origin", F.desc("confidence"), "doc_id"))
    return both.withColumn("nth", nth).where(F.col("nth") <= most).select("ext", "doc_id", "origin")


def file_kind(files: DataFrame, head: int = 4096, printable: float = 0.85) -> DataFrame:
    """(doc_id, label, confidence, reason) of files (doc_id, ext, bytes): by first bytes, else by suffix, else code or text by the share of printable ASCII bytes.

    Only the first `head` bytes are looked at. No bytes, or a null among them, is no text; null bytes count as none.
    """
    first = F.substring(F.coalesce("bytes", F.lit(b"")), 1, head)
    one = F.decode(first, "ISO-8859-1")
    start, suffix = F.hex(F.substring(first, 1, 8)), F.lower("ext")
    share = F.regexp_count(one, F.lit(r"[\n\r\t -~]")) / F.greatest(F.length(one), F.lit(1))
    textual = ~F.contains(one, F.lit("\0")) & (share > printable)
    marks = F.lit(False)
    for mark in CODE_MARKS:
        marks = marks | F.contains(one, F.lit(mark))
    kind = lambda label, confidence, reason: F.struct(label.alias("label"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    rules = [(start.startswith(mark), kind(F.lit(label), 0.99, reason)) for mark, label, reason in SIGNATURES]
    rules += [(suffix.isin(names), kind(F.lit(label), 0.9, "suffix")) for label, names in CATEGORIES.items()]
    rules += [(textual, kind(F.when(marks, "code").otherwise("text"), 0.75, "text_signature"))]
    found = kind(F.lit("unknown"), 0.4, "no_deterministic_match")
    for test, value in reversed(rules):
        found = F.when(test, value).otherwise(found)
    return files.select("doc_id", found.alias("k")).select("doc_id", "k.*")


def clean(c: Column, most: int) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def suggestions(files: DataFrame) -> DataFrame:
    """(doc_id, target, confidence) of classified files (doc_id, dir, stem, ext, label, hash, confidence): `stem__label__digest.ext` beside the file, digest the hash's first twelve digits; the confidence is at most 0.95."""
    safe = F.regexp_replace(F.regexp_replace("stem", "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    name = F.concat(F.when(safe == "", "file").otherwise(safe), F.lit("__"), F.coalesce("label", F.lit("unknown")), F.lit("__"), F.substring("hash", 1, 12), F.lower("ext"))
    return files.select("doc_id", F.concat("dir", F.lit("/"), name).alias("target"), F.least(F.lit(0.95), F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def auto_approved(confidence: Column, preference: Column) -> Column:
    """Whether a name goes through without review: by its confidence alone while no preference is known (null), else by both, and never if its like are mostly rejected."""
    return F.when(preference.isNull(), confidence >= APPROVE).otherwise((preference >= REJECTED) & (0.6 * confidence + 0.4 * preference >= APPROVE))


def coded_names(files: DataFrame) -> DataFrame:
    """(doc_id, coded, decision): `DOMAIN__TYPE__tags__date__STATE.ext`, and whether it is skipped, approved or queued.

    files: (doc_id, domain, content_type, tags, date, status, ext, confidence, has_text, preference); preference, the
    learned chance of approval, is null while too little is known. Skipped are files of low confidence, of an unknown
    extension and without text; an extension that tells the type for sure is approved as long as no preference is known.
    """
    code = lambda c, table, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(c)), F.lit(other))
    ext, confidence = F.lower("ext"), F.coalesce("confidence", F.lit(0.0))
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0, "GN").otherwise(F.array_join("tags", "-"))
    coded = F.substring(F.concat(F.concat_ws("__", F.coalesce("domain", F.lit("GN")), code("content_type", TYPE_CODES, "DOC"), tags, F.coalesce(F.date_format("date", "yyyyMMdd"), F.lit("00000000")), code("status", STATE_CODES, "AC")), ext), 1, LONGEST_NAME)
    certain = ext.isin(CERTAIN)
    skip = (confidence < QUEUE) & ~certain & ~F.coalesce("has_text", F.lit(False))
    sure = auto_approved(confidence, F.col("preference")) | (F.col("preference").isNull() & certain)
    return files.select("doc_id", F.when(~skip, coded).alias("coded"), F.when(skip, "skip").when(sure, "auto_approve").otherwise("queue").alias("decision"))


def projected(files: DataFrame, mode: str) -> DataFrame:
    """(doc_id, name): a file's name with its address: slug, prefix, suffix or address alone."""
    slug = clean(F.col("stem"), 48)
    name = {"slug": slug, "prefix": F.concat_ws("_", "address", slug), "suffix": F.concat_ws("_", slug, "address"), "address": F.col("address")}[mode]
    return files.select("doc_id", F.concat(name, F.lower("ext")).alias("name"))


def name_ratio(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds `ratio`, the share of matching blocks of two names; each different pair is compared once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p["ratio"] = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(p[a], p[b], strict=True)]
            yield p

    one = pairs.select(a, b).distinct()
    return pairs.join(one.mapInPandas(run, f"`{a}` string, `{b}` string, ratio double"), [a, b])


def records(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, identity, times, policy, provenance): nested records of files with their folder's profile."""
    df = files.join(profiles.select("root", "profile"), "root", "left")
    return df.select(
        "doc_id", F.struct("name", "ext", "dir", F.col("hash").alias("sha256")).alias("identity"), F.struct(F.col("hour").alias("modified"), "size").alias("times"), F.struct(F.coalesce("profile", F.lit("default")).alias("profile"), (F.col("ext") == "").alias("review")).alias("policy"),
        F.struct(F.col("root").alias("who"), F.col("stem").alias("what"), F.col("day").alias("when_day"), F.col("dir").alias("where_dir"), F.concat(F.lit("inventory of "), "root").alias("why")).alias("provenance"),
    )


def graph(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n) and edges (a, b, n, evidence) of terms in one document (doc_id, term); evidence is the first three documents."""
    one = matches.select("doc_id", "term").distinct()
    nodes = one.groupBy(F.col("term").alias("node")).agg(F.count("*").alias("n"))
    pairs = one.alias("x").join(one.alias("y"), F.expr("x.doc_id = y.doc_id and x.term < y.term")).select(F.col("x.term").alias("a"), F.col("y.term").alias("b"), F.col("x.doc_id").alias("doc_id"))
    some = first_of(pairs, ["a", "b"], [F.asc("doc_id")], 3).groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("evidence"))
    return nodes, pairs.groupBy("a", "b").agg(F.count("*").alias("n")).join(some, ["a", "b"])


def anti_edges(similar: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): similar terms that never occur together."""
    return similar.select("a", "b").distinct().join(edges.select("a", "b"), ["a", "b"], "left_anti")


def followed(queries: DataFrame, index: DataFrame, pointers: DataFrame) -> DataFrame:
    """(query_id, node, target): the index line (node, line) with most of a query's words, and the node that it points to."""
    words = lambda df, key, c: df.select(key, F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower({c}), '[a-z]{{3,}}', 0)"))).alias("w"))
    score = words(queries, "query_id", "text").join(words(index, "node", "line"), "w").groupBy("query_id", "node").agg(F.count("*").alias("score"))
    best = score.groupBy("query_id").agg(F.min_by("node", F.struct(-F.col("score"), "node")).alias("node"))
    return best.join(pointers, "node", "left").select("query_id", "node", "target")
