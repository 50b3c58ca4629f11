"""Ends of streams: the steps of foreachBatch that keep tables right when a batch is delivered twice.

Each step derives the table after a batch from the table before it, whatever an earlier try of the same batch left
behind, and writes the batch's own version or folder (see `sources.tables`). So a batch that is delivered again changes
nothing, and a lost executor or driver costs the batch at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources import tables

Step = Callable[[DataFrame, int], None]
STATE = ["path", "kind", "moved_from", "event_id", "ts"]


def started(stream: DataFrame, step: Step, checkpoint: str) -> StreamingQuery:
    """Runs the step over all that has arrived, batch by batch."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(events: DataFrame) -> DataFrame:
    """STATE rows of events (event_id, kind, path, dest_path, ts): a move leaves a tombstone and makes a new path, with where it came from."""
    none = F.lit(None).cast("string")
    gone = F.struct(F.col("path").alias("path"), F.when(F.col("kind") == "moved", "deleted").otherwise(F.col("kind")).alias("kind"), none.alias("moved_from"))
    made = F.struct(F.col("dest_path").alias("path"), F.lit("created").alias("kind"), F.col("path").alias("moved_from"))
    both = F.when((F.col("kind") == "moved") & F.col("dest_path").isNotNull(), F.array(gone, made)).otherwise(F.array(gone))
    return events.select(F.explode(both).alias("x"), "event_id", "ts").select("x.*", "event_id", "ts").where("path is not null")


def last_states(rows: DataFrame) -> DataFrame:
    """STATE: the last of each path; a path that is moved onto at the time it goes is there."""
    last = F.max(F.struct("ts", "event_id", F.col("moved_from").isNotNull().alias("made"), "kind", "moved_from")).alias("x")
    return rows.groupBy("path").agg(last).select("path", "x.kind", "x.moved_from", "x.event_id", "x.ts")


def state_sink(path: str) -> Step:
    """Keeps the table of path states; an event older than what a path has changes nothing, so late ones do no harm."""

    def step(batch: DataFrame, number: int) -> None:
        rows, old = states(batch), tables.current(batch.sparkSession, path, number)
        tables.replace(last_states(rows if old is None else rows.unionByName(old.select(STATE))), path, number)

    return step


def ledger_sink(path: str) -> Step:
    """Appends to a ledger of JSON lines: a folder for each batch, written over when it comes again."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return step


def delivery_sink(accept: Callable[[DataFrame], DataFrame], sent: str, dead: str) -> Step:
    """Sends rows on, and keeps those that fail for later batches.

    accept adds a column `error`, null where a row is delivered. Rows that wait in `dead` are tried again with each
    batch; what is delivered then goes to the batch's own folder below `sent`, what isn't waits on with one try more.
    """

    def step(batch: DataFrame, number: int) -> None:
        old = tables.current(batch.sparkSession, dead, number)
        rows = batch.withColumn("tries", F.lit(0))
        if old is not None:
            rows = rows.unionByName(old.select(*batch.columns, "tries"))
        tried = accept(rows).withColumn("tries", F.col("tries") + 1)
        tried.where("error is null").drop("error").write.mode("overwrite").parquet(f"{sent}/batch={number}")
        tables.replace(tried.where("error is not null"), dead, number)

    return step
