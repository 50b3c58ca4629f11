"""Queues, lookups and routes: reviews, folders, files, blocks, nodes, prompts, dimensions and packets of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows in which one of the columns holds the query, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower()))
    return df.where(hit)


def recent_files(files: DataFrame, query: str | None = None, exts: list[str] | None = None, most: int = 50) -> DataFrame:
    """(doc_id, path): the latest changed files whose name, folder or extension holds the query (a top-k listing)."""
    df = files if query is None else matching(files, ["name", "dir", "ext"], query)
    df = df if exts is None else df.where(F.col("ext").isin(exts))
    return df.orderBy(F.desc("hour"), F.desc("doc_id")).limit(most).select("doc_id", "path")


def reviews(queue: DataFrame, jobs: DataFrame, as_of: str, days: int, status: str | None = None, role: str | None = None) -> DataFrame:
    """(review_id, job_id, role, status): reviews at least `days` old; the role is that of their job, or `default`."""
    df = queue.where(F.col("ts") <= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    df = df.join(jobs.select("job_id", "role"), "job_id", "left").withColumn("role", F.coalesce("role", F.lit("default")))
    df = df if status is None else df.where(F.col("status") == status)
    df = df if role is None else df.where(F.col("role") == role)
    return df.select("review_id", "job_id", "role", "status")


def blocks(df: DataFrame, query: str, kinds: list[str], notebook: str | None = None, tag: str | None = None, most: int = 32) -> DataFrame:
    """(doc_id, kind): blocks with the query, of given kinds, notebook and `#tag#`, the latest first (a top-k listing)."""
    df = matching(df, ["body"], query).where(F.col("kind").isin(kinds))
    df = df if notebook is None else df.where(F.col("notebook") == notebook)
    df = df if tag is None else df.where(F.contains("tags", F.lit(f"#{tag}#")))
    return df.orderBy(F.desc("updated"), F.desc("doc_id")).limit(most).select("doc_id", "kind")


def by_ids(df: DataFrame, ids: DataFrame, width: int = 40) -> DataFrame:
    """(doc_id, title, n): the rows of the given ids, normalised: a trimmed title and the length of the text."""
    title = F.trim(F.substring(F.regexp_replace("body", r"\s+", " "), 1, width))
    return df.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", title.alias("title"), F.length("body").alias("n"))


def offering(nodes: DataFrame, capability: str) -> DataFrame:
    """(node, primary, place): nodes with a capability that are neither offline nor retired, the primary ones first."""
    df = nodes.where(F.array_contains("capabilities", capability) & ~F.col("status").isin("offline", "retired"))
    return df.select("node", "primary", F.row_number().over(Window.partitionBy(F.lit(capability)).orderBy(F.desc("primary"), "node")).alias("place"))


def pending(items: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(doc_id): the first items without a vector, by id (a batch of work)."""
    return items.join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id").orderBy("doc_id").limit(most)


def with_dimension(messages: DataFrame, sources: DataFrame, priority: int) -> tuple[DataFrame, DataFrame]:
    """Messages with their source's priority, else the default; and the sources with those that were unknown appended."""
    known = sources.select("source", F.col("priority").alias("own"))
    joined = messages.join(known, "source", "left").withColumn("priority", F.coalesce("own", F.lit(priority))).drop("own")
    new = messages.select("source").distinct().join(sources, "source", "left_anti").withColumn("priority", F.lit(priority))
    return joined, sources.select("source", "priority").unionByName(new)


def packets(prompts: DataFrame, docs: DataFrame, k: int = 3, width: int = 500, least: int = 5) -> DataFrame:
    """(prompt_id, packet): of each prompt's words of `least` letters or more, the k documents with most of them, each cut to `width`.

    Words are joined by equality; a document's words are counted before they travel, and texts are joined to the few chosen.
    """
    words = lambda df, key, c: df.select(key, F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower({c}), '[a-z]{{{least},}}', 0)"))).alias("w"))
    score = words(docs, "doc_id", "body").join(words(prompts, "prompt_id", "text"), "w").groupBy("prompt_id", "doc_id").agg(F.count("*").alias("score"))
    nth = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("score"), "doc_id"))
    top = score.withColumn("nth", nth).where(F.col("nth") <= k).join(docs.select("doc_id", F.substring("body", 1, width).alias("b")), "doc_id")
    rows = F.array_sort(F.collect_list(F.struct("nth", "b")))
    return top.groupBy("prompt_id").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n").alias("packet"))


def routed(prompts: DataFrame, aliases: dict[str, str], default: str) -> DataFrame:
    """(prompt_id, target): by the longest alias that the prompt begins with, else by its metadata, else the default."""
    low = F.lower(F.ltrim("text"))
    target = F.coalesce("persona", F.lit(default))
    for alias in sorted(aliases, key=lambda a: (len(a), a)):
        target = F.when(low.startswith(alias.lower()), aliases[alias]).otherwise(target)
    return prompts.select("prompt_id", target.alias("target"))


def admitted_events(events: DataFrame, own: str, ignored: list[str], binary: list[str]) -> DataFrame:
    """(event_id, reason): why an event isn't handled: own repository, ignored folder, hidden, log, sidecar or binary file; null if it is."""
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    reason: Column = (
        F.when(F.col("path").startswith(own + "/"), "own_repository").when(F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))), "ignored_folder").when(name.startswith("."), "hidden")
        .when(ext == ".log", "log").when(ext.isin(".chi", ".srt", ".bak"), "sidecar").when(ext.isin(binary), "binary")
    )
    return events.select("event_id", reason.alias("reason"))


def outcomes(files: DataFrame, seen: DataFrame, sure: float, no_rename: list[str]) -> DataFrame:
    """(doc_id, route): front matter first, then duplicate, no_rename, auto, pending or kickout by confidence."""
    first = seen.groupBy("hash").agg(F.min("doc_id").alias("first"))
    route = (
        F.when(F.col("content").startswith("---\n"), "front_matter").when(F.col("doc_id") > F.col("first"), "duplicate").when(F.col("root").isin(no_rename), "no_rename")
        .when(F.col("confidence") >= sure, "auto").when(F.col("confidence") >= sure / 2, "pending").otherwise("kickout")
    )
    return files.join(first, "hash").select("doc_id", route.alias("route"))


def preferences(moves: DataFrame, own_name: str) -> DataFrame:
    """(event_id, signal, value): manual moves (path, dest_path) as signals: rename within a folder, move else; own renames dropped."""
    folder = lambda c: F.expr(f"substring({c}, 1, length({c}) - length(substring_index({c}, '/', -1)))")
    same = folder("path") == folder("dest_path")
    name = F.substring_index("dest_path", "/", -1)
    return moves.where(~name.rlike(own_name)).select("event_id", F.when(same, "rename").otherwise("move").alias("signal"), F.when(same, name).otherwise(folder("dest_path")).alias("value"))


def inspected(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """(event_id, path, kind): manual requests as events: manual_inspect, or missing when the inventory lacks the path."""
    have = inventory.select("path").distinct().withColumn("have", F.lit(True))
    return requests.join(have, "path", "left").select("event_id", "path", F.when(F.col("have"), "manual_inspect").otherwise("missing").alias("kind"))


def orphaned(deleted: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(event_id, sidecar): sidecars (path) of deleted files (event_id, path): the same path with an extension more."""
    owner = F.regexp_replace("path", r"\.[^./]*$", "")
    return deleted.join(sidecars.select(F.col("path").alias("sidecar"), owner.alias("path")), "path").select("event_id", "sidecar")
