"""Listings and searches with optional conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.text import occurrences


def items(df: DataFrame, folder: str | None = None, tag: str | None = None, pinned: bool | None = None, query: str | None = None, most: int | None = None) -> DataFrame:
    """Items that meet all given conditions, the pinned and newest first; `most` is a top-k."""
    if folder is not None:
        df = df.where(F.col("folder") == folder)
    if tag is not None:
        df = df.where(F.array_contains("tags", tag))
    if pinned is not None:
        df = df.where(F.col("pinned") == pinned)
    if query is not None:
        df = df.where(F.contains(F.lower("body"), F.lit(query.lower())))
    return df if most is None else df.orderBy(F.desc("pinned"), F.desc("doc_id")).limit(max(1, most))


def under(files: DataFrame, folder: str) -> DataFrame:
    """Files of a folder and of those below it."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    return files.where((path == folder) | path.startswith(folder.rstrip("/") + "/"))


def search(df: DataFrame, query: str, most: int) -> DataFrame:
    """(doc_id, score): the top rows by the number of occurrences of the query's words, then by id."""
    words = [w for w in query.lower().split() if w]
    score = sum((occurrences(F.lower("body"), w) for w in words), F.lit(0))
    return df.select("doc_id", score.cast("bigint").alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("doc_id")).limit(most)


def search_all(df: DataFrame, query: str) -> DataFrame:
    """(doc_id, score) of every row with one of the query's words."""
    score = sum((occurrences(F.lower("body"), w) for w in query.lower().split()), F.lit(0))
    return df.select("doc_id", score.cast("bigint").alias("score")).where("score > 0")


def secret_warning(df: DataFrame) -> DataFrame:
    """(doc_id, warning): bodies that look like they hold a secret."""
    body = F.col("body")
    # fixed values: the three patterns
    found = body.rlike(r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*\S+") | body.rlike(r"\bsk-[A-Za-z0-9_-]{12,}") | body.rlike("-----BEGIN [A-Z ]*PRIVATE KEY-----")
    return df.select("doc_id", found.alias("warning"))


def combined(df: DataFrame, key: str, order: str, separator: str = "\n---\n", most: int = 100_000) -> DataFrame:
    """(key, part, body): the bodies of a key's rows, in order, as pieces that begin every `most` characters.

    Lengths are summed first, without the bodies; so a key of any size gives pieces of bounded size.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    part = (F.coalesce(F.sum("n").over(w), F.lit(0)) / most).cast("bigint")
    parts = df.select(key, order, F.length("body").alias("n")).select(key, order, part.alias("part"))
    rows = F.array_sort(F.collect_list(F.struct(order, "body")))
    return df.join(parts, [key, order]).groupBy(key, "part").agg(rows.alias("r")).select(key, "part", F.array_join(F.transform("r", lambda x: x["body"]), separator).alias("body"))
