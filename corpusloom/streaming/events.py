"""Event streams: debouncing, coalescing, fan-out, duplicate suppression and counters on Structured Streaming.

Every function takes a streaming DataFrame, and a batch one too where it says so. Time is event time; late rows are
bounded by a watermark given by the caller. State is kept by key, so keys run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def debounce(events: DataFrame, seconds: int, late: str = LATE) -> DataFrame:
    """(event_id, kind, path, ts): of each kind and path, events at least `seconds` after the last one let through.

    For streams. Rows of one micro-batch are taken in event time; a row older than the last one let through is dropped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"]) if not state.hasTimedOut else pd.DataFrame()
        last, kept = state.get[0] if state.exists else None, []
        for r in rows.itertuples(index=False):
            at = int(r.ts.timestamp() * 1000)
            if last is None or at - last >= seconds * 1000:
                last = at
                kept.append(r)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["event_id", "kind", "path", "ts"]) if kept else pd.DataFrame({"event_id": pd.Series(dtype="int64"), "kind": pd.Series(dtype="object"), "path": pd.Series(dtype="object"), "ts": pd.Series(dtype="datetime64[ns]")})

    rows = events.select("event_id", "kind", "path", "ts").withWatermark("ts", late)
    return rows.groupBy("kind", "path").applyInPandasWithState(run, "event_id bigint, kind string, path string, ts timestamp", "last bigint", "append", GroupStateTimeout.NoTimeout)


def debounce_batch(events: DataFrame, seconds: int) -> DataFrame:
    """The same rule over a table: each key's times are folded in order."""
    rows = events.groupBy("kind", "path").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("a"))
    start = F.struct(F.lit(None).cast("timestamp").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        let = acc["last"].isNull() | (F.unix_millis(x["ts"]) - F.unix_millis(acc["last"]) >= seconds * 1000)
        return F.struct(F.when(let, x["ts"]).otherwise(acc["last"]).alias("last"), F.when(let, F.concat(acc["out"], F.array(x["event_id"]))).otherwise(acc["out"]).alias("out"))

    return rows.select("kind", "path", F.explode(F.aggregate("a", start, step, lambda acc: acc["out"])).alias("event_id")).select("event_id", "kind", "path")


def settle(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """(path, event_id, n): one row for each quiet gap after a path's events, with the last of them. Stream or batch."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "path").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n")).select("path", "event_id", "n")


def coalesce(events: DataFrame, window: str, late: str = LATE) -> DataFrame:
    """(start, path, event_id, kind): the latest event of each path in each window. Stream or batch."""
    last = F.max(F.struct("ts", "event_id", "kind")).alias("x")
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "path").agg(last).select(F.col("window.start").alias("start"), "path", "x.event_id", "x.kind")


def counters(events: DataFrame, window: str, late: str = LATE) -> DataFrame:
    """(start, kind, n): events of each kind by window. Stream or batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").count().select(F.col("window.start").alias("start"), "kind", F.col("count").alias("n"))


def split_moves(events: DataFrame) -> DataFrame:
    """(event_id, kind, path): a move becomes moved_out of the path and moved_in to its new one. Stream or batch."""
    moved = F.array(F.struct(F.lit("moved_out").alias("kind"), F.col("path").alias("path")), F.struct(F.lit("moved_in").alias("kind"), F.concat(F.lit("lib/"), "path").alias("path")))
    each = F.when(F.col("kind") == "moved", moved).otherwise(F.array(F.struct("kind", "path")))
    return events.select("event_id", F.explode(each).alias("x")).select("event_id", "x.kind", "x.path")


def payloads(events: DataFrame) -> DataFrame:
    """(event_id, payload): what an event is sent on as: up to four kinds. Stream or batch."""
    kind = F.col("kind")
    every = F.array(F.when(kind != "deleted", F.lit("classify")), F.when(kind.isin("created", "moved"), F.lit("profile")), F.when(kind == "created", F.lit("hash")), F.lit("ledger"))
    return events.select("event_id", F.explode(F.array_compact(every)).alias("payload"))


def first_seen(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """Rows whose key hasn't been seen within the watermark. For streams."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def state_table(events: DataFrame) -> DataFrame:
    """(path, kind, event_id): the last event of each path, deleted ones too; the batch step of foreachBatch."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("nth", nth).where("nth = 1").select("path", "kind", "event_id")


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state table after one more batch of events with ts."""
    return state_table(state.unionByName(batch.select("path", "kind", "event_id", "ts")))


def latest_beat(beats: DataFrame) -> DataFrame:
    """(node, ts, event_id): the latest heartbeat of each node. Stream (complete or update mode) or batch."""
    return beats.groupBy("node").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("node", "x.event_id")


def normalise(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and dead letters: those without a path or of an unknown kind. Stream or batch."""
    good = F.col("path").isNotNull() & F.coalesce(F.col("kind").isin("created", "modified", "deleted", "moved"), F.lit(False))
    return events.where(good), events.where(~good)
