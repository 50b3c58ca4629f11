"""From a file event to a decision: normalised, given its folder's profile, hashed, classified, named anew and gated.

One plan for a table of events and for each batch of a stream. The tables beside the events (profiles, inventory) are
keyed tables in versions; a stream reads their last version anew with every batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.classify import review_gate
from corpusloom.operators.folders import file_kind, suggestions
from corpusloom.operators.inventory import profile_of
from corpusloom.sources import tables
from corpusloom.streaming.sinks import Step

COLUMNS = ["event_id", "path", "profile", "hash", "label", "confidence", "target", "review", "reason", "status"]


def decided(events: DataFrame, profiles: DataFrame, inventory: DataFrame) -> DataFrame:
    """COLUMNS of every event (event_id, kind, path, dest_path, is_directory).

    profiles: (name, path, protected, review_only, threshold); inventory: (path, dir, stem, ext, hash, bytes), one row
    a path. A move counts at its new path. Deletions and folders are ignored; a path that the inventory lacks is to be
    tried again; the others wait for review or are completed, as the gate says. Events that aren't one of the four
    kinds, or lack a path, are dead.
    """
    at = F.when((F.col("kind") == "moved") & F.col("dest_path").isNotNull(), F.col("dest_path")).otherwise(F.col("path"))
    rows = events.select("event_id", "kind", F.coalesce("is_directory", F.lit(False)).alias("is_directory"), at.alias("path"))
    known = profiles.select(F.col("name").alias("profile"), F.col("path").alias("profile_root"))
    named = profile_of(rows.where("path is not null"), known, "default")
    candidates = rows.where("path is not null and kind in ('created', 'modified', 'moved') and not is_directory")
    files = candidates.select(F.col("event_id").alias("doc_id"), "path").join(inventory.select("path", "dir", "stem", "ext", "hash", "bytes"), "path")
    kinds = files.join(file_kind(files).drop("reason"), "doc_id").select("doc_id", "path", "dir", "stem", "ext", "hash", "label", "confidence")
    made = suggestions(kinds).select("doc_id", "target", F.col("confidence").alias("least_confidence"))
    limits = profiles.select(F.col("name").alias("profile"), "protected", "review_only", F.col("threshold").alias("least"))
    asked = kinds.join(made, "doc_id").join(named, "path").join(limits, "profile", "left")
    gate = review_gate(asked.select("doc_id", "path", "target", "ext", F.col("least_confidence").alias("confidence"), "protected", "review_only", "least"), inventory)
    out = asked.select("doc_id", "hash", "label", "confidence", "target").join(gate, "doc_id").withColumnRenamed("doc_id", "event_id")
    good = F.col("path").isNotNull() & F.coalesce(F.col("kind").isin("created", "modified", "deleted", "moved"), F.lit(False))
    ignored = (F.col("kind") == "deleted") | F.col("is_directory")
    status = F.when(~good, "dead").when(ignored, "ignored").when(F.col("hash").isNull(), "failed_retryable").when(F.col("review"), "waiting_review").otherwise("completed")
    reason = F.when(~good, "not_an_event").when(ignored, "not_a_rename_candidate").when(F.col("hash").isNull(), "file_not_found").otherwise(F.col("reason"))
    full = rows.join(named, "path", "left").join(out, "event_id", "left")
    return full.select("event_id", "path", "profile", "hash", "label", "confidence", "target", "review", reason.alias("reason"), status.alias("status"))


def ingest_sink(profiles: str, inventory: str, path: str) -> Step:
    """Adds each batch's decisions to the keyed table of jobs; what couldn't be found waits there as failed_retryable."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables.upsert(decided(batch, tables.current(spark, profiles), tables.current(spark, inventory)), ["event_id"], path, batch=number)

    return step
