"""Scan reports: statistics, anomalies and suggestions of a source, feedback, answers; claims, topics and expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Notes on claims, by how far they overreach.
NOTES = {
    "high": "This claim may be crossing jurisdiction. A WHY claim with heavy WHAT language risks implying empirical proof of theological interpretation.",
    "medium": "Mixed jurisdiction detected. Consider splitting into separate WHAT/HOW/WHY subclaims.",
}


def listed(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, value): the `most` most frequent values of each key with their counts, as text; the first by name of equals."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).where(F.col("nth") <= most)
    each = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(value).alias("v"), "n"))), lambda x: F.concat_ws("=", x["v"], x["n"].cast("string")))
    return ranked.groupBy(key).agg(F.array_join(each, ",").alias(value))


def statistics(files: DataFrame, exts: int = 8, domains: int = 8) -> DataFrame:
    """(root, n, domain, level, ext, groups, copies, coverage) of files (root, ext, hash, path, domain, level); coverage in percent of copied files."""
    same = files.groupBy("root", "hash").agg(F.countDistinct("path").alias("k")).where("k > 1").groupBy("root").agg(F.count("*").alias("groups"), F.sum("k").cast("bigint").alias("copies"))
    named = files.withColumn("ext", F.when(F.col("ext") == "", "[none]").otherwise(F.lower("ext")))
    df = files.groupBy("root").agg(F.count("*").alias("n")).join(same, "root", "left")
    for c, most in (("domain", domains), ("level", 1000), ("ext", exts)):
        df = df.join(listed(named, "root", c, most), "root", "left")
    groups, copies = F.coalesce("groups", F.lit(0)), F.coalesce("copies", F.lit(0))
    total = F.greatest("n", copies)
    return df.select("root", total.alias("n"), "domain", "level", "ext", groups.alias("groups"), copies.alias("copies"), F.round(100 * copies / total, 1).alias("coverage"))


def capped(rows: DataFrame, most: int) -> DataFrame:
    """(root, nth, kind, summary): of rows (root, rank, kind, place, summary) each source's first `most` by rank, then place (a report's feature)."""
    nth = F.row_number().over(Window.partitionBy("root").orderBy("rank", "place", "summary"))
    return rows.select("root", nth.alias("nth"), "kind", "summary").where(F.col("nth") <= most)


def anomalies(files: DataFrame, near: DataFrame, routes: DataFrame, scores: DataFrame, most: int = 10, large: int = 5, close: float = 0.05) -> DataFrame:
    """The capped union of large groups of copies, near copies, files without a route and files with two close domains.

    near: (root, a, b, jaccard); routes: (root, path, target); scores: (root, path, domain, score).
    """
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    row = lambda df, rank, kind, place, summary: df.select("root", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), place.cast("double").alias("place"), summary.alias("summary"))
    same = files.groupBy("root", "hash").agg(F.count("*").alias("k")).where(F.col("k") >= large)
    w = Window.partitionBy("root", "path").orderBy(F.desc("score"), "domain")
    two = scores.select("root", "path", F.col("domain").alias("a"), F.lead("domain").over(w).alias("b"), F.row_number().over(w).alias("nth"), (F.col("score") - F.lead("score").over(w)).alias("apart")).where((F.col("nth") == 1) & (F.col("apart") <= close))
    rows = row(same, 1, "exact_duplicate", -F.col("k"), text("File exists in ", F.col("k").cast("string"), " locations"))
    rows = rows.unionByName(row(near.where("jaccard >= 0.9"), 2, "near_duplicate", -F.col("jaccard"), text("Near-duplicate pair ", F.col("a"), " and ", F.col("b"))))
    rows = rows.unionByName(row(routes.where("target is null"), 3, "orphan", F.lit(0), text("No routing match: ", F.col("path"))))
    rows = rows.unionByName(row(two, 4, "conflicting_domain", F.lit(0), text("Conflicting domains: ", F.col("a"), " vs ", F.col("b"))))
    return capped(rows, most)


def suggestions(renames: DataFrame, routes: DataFrame, near: DataFrame, most: int = 10, each: int = 3) -> DataFrame:
    """The capped union of corrected spellings, other renames, at most `each` routes for a target, and one consolidation of near copies."""
    row = lambda df, rank, kind, place, summary: df.select("root", rank.alias("rank"), kind.alias("kind"), place.cast("double").alias("place"), summary.alias("summary"))
    spelling = F.col("spelling")
    rows = row(renames, F.when(spelling, 1).otherwise(2), F.when(spelling, "spelling_correction").otherwise("rename"), F.lit(0), F.concat(F.lit("Rename "), "name", F.lit(" to "), "proposed"))
    nth = F.row_number().over(Window.partitionBy("root", "target").orderBy("path"))
    rows = rows.unionByName(row(routes.where("target is not null").withColumn("nth", nth).where(F.col("nth") <= each), F.lit(3), F.lit("route"), F.col("nth"), F.concat(F.lit("Route "), "path", F.lit(" to "), "target")))
    count = near.where("jaccard >= 0.9").groupBy("root").agg(F.count("*").alias("k"))
    rows = rows.unionByName(row(count, F.lit(4), F.lit("family_consolidation"), F.lit(0), F.concat(F.lit("Review "), F.col("k").cast("string"), F.lit(" near-duplicate pairs"))))
    return capped(rows, most)


def report(stats: DataFrame, found: DataFrame, proposed: DataFrame) -> DataFrame:
    """(root, n, coverage, anomalies, suggestions): a row for each source, with its lists in order."""
    lines = lambda df, name: df.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "summary"))), lambda x: x["summary"]), "\n").alias(name))
    df = stats.select("root", "n", "coverage").join(lines(found, "anomalies"), "root", "left").join(lines(proposed, "suggestions"), "root", "left")
    return df.fillna("", ["anomalies", "suggestions"])


def feedback(ratings: DataFrame, proposed: DataFrame) -> DataFrame:
    """(root, nth, kind, approved): ratings (root, nth, rating) of suggestions as decisions: 4 and 5 accept, 1 and 2 reject, 3 teaches nothing."""
    return ratings.where("rating <> 3").join(proposed, ["root", "nth"]).select("root", "nth", "kind", F.when(F.col("rating") >= 4, 1).otherwise(0).alias("approved"))


def answers(questions: DataFrame, reports: DataFrame) -> DataFrame:
    """(question_id, answer): questions (question_id, root, text) about a source's report, by their keywords."""
    low = F.lower("text")
    has = lambda *ws: low.rlike("|".join(ws))
    answer = (
        F.when(has("duplicate", "copies"), F.concat(F.col("coverage").cast("string"), F.lit("% of files are copies"))).when(has("how many", "count", "total"), F.concat(F.col("n").cast("string"), F.lit(" files")))
        .when(has("anomal", "problem", "wrong"), F.substring_index("anomalies", "\n", 1)).when(has("suggest", "should", "next"), F.substring_index("suggestions", "\n", 1)).otherwise("Ask about files, duplicates, anomalies or suggestions")
    )
    return questions.join(reports, "root", "left").select("question_id", F.coalesce(answer, F.lit("No report")).alias("answer"))


def sentence_claims(kinds: DataFrame) -> DataFrame:
    """(doc_id, nth, primary, mixed, confidence, overreach, note) of sentences (doc_id, nth, what, how, why, primary, mixed, margin), as `catalog.statement_kinds` rates them.

    Overreach follows from what a claim of one kind has of another: why beyond data, data beyond why, why beyond how.
    """
    is_ = lambda k: F.col("primary") == k
    over = F.when(is_("what") & (F.col("why") > 25), "medium").when(is_("why") & (F.col("what") > 30), "high").when(is_("how") & (F.col("why") > 40), "medium").when(is_("why") & (F.col("how") > 40), "low").otherwise("none")
    note = F.when(over == "high", NOTES["high"]).when(over == "medium", NOTES["medium"]).otherwise("")
    return kinds.select("doc_id", "nth", "primary", "mixed", F.col("margin").alias("confidence"), over.alias("overreach"), note.alias("note"))


def topic_pages(chunks: DataFrame) -> DataFrame:
    """(conv_id, topic, page_id, n, n_chars, speakers, first, last) of chunks (conv_id, turn, topic, speaker, text)."""
    rows = chunks.groupBy("conv_id", "topic").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), F.min("turn").alias("first"), F.max("turn").alias("last"))
    return rows.withColumn("page_id", F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("topic").cast("string")).cast("binary")))


def expanded(seeds: DataFrame, relations: DataFrame, each: int, most: int) -> DataFrame:
    """(category, term, nth): seeds (category, word) and their related terms from (word, relation, term); broader ones to depth two.

    Of each category and relation the `each` shortest terms, and of each category the `most` shortest in all (limits of the feature).
    """
    one = seeds.join(relations, "word").select("category", "relation", "term")
    up = relations.where("relation = 'broader'")
    two = one.where("relation = 'broader'").select("category", F.col("term").alias("word")).join(up, "word").select("category", "relation", "term")
    by = lambda *key: Window.partitionBy(*key).orderBy(F.length("term"), "term")
    some = one.unionByName(two).distinct().withColumn("nth", F.row_number().over(by("category", "relation"))).where(F.col("nth") <= each)
    every = seeds.select("category", F.col("word").alias("term")).unionByName(some.select("category", "term")).distinct()
    return every.withColumn("nth", F.row_number().over(by("category"))).where(F.col("nth") <= most)
