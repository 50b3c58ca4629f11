"""Streams give what the batch forms give over all their rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import fixtures as x
from corpusloom.streaming import events as e

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """The events in four files by time, and a function that opens them as a stream."""
    path = str(tmp_path_factory.mktemp("events"))
    events = x.file_events(spark, DIR)
    nth = F.ntile(4).over(__import__("pyspark.sql").sql.Window.orderBy("ts"))
    parts = events.withColumn("part", nth).cache()
    for i in range(1, 5):
        parts.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(path)
    return events, lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(spark, df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_debounce(spark, stream, tmp_path):
    batch, opened = stream
    got = {r[0] for r in rows(spark, e.debounce(opened(), 86400, "60 days"), "append", tmp_path, "debounced")}
    assert got == {r.event_id for r in e.debounce_batch(batch, 86400).collect()}


def test_split_and_payloads(spark, stream, tmp_path):
    batch, opened = stream
    assert rows(spark, e.split_moves(opened()), "append", tmp_path / "a", "moves") == sorted(map(tuple, e.split_moves(batch).collect()), key=str)
    assert rows(spark, e.payloads(opened()), "append", tmp_path / "b", "payloads") == sorted(map(tuple, e.payloads(batch).collect()), key=str)


def test_counters(spark, stream, tmp_path):
    batch, opened = stream
    got = dict(((a, b), n) for a, b, n in rows(spark, e.counters(opened(), "1 day"), "complete", tmp_path, "counters"))
    assert got == {(r.start, r.kind): r.n for r in e.counters(batch, "1 day").collect()}


def test_first_seen(spark, stream, tmp_path):
    batch, opened = stream
    got = rows(spark, e.first_seen(opened(), "path", "60 days"), "append", tmp_path, "seen")
    assert sorted(r[2] for r in got) == sorted(r.path for r in batch.select("path").distinct().collect())


def test_state_by_batches(spark, stream):
    batch, _ = stream
    half = batch.approxQuantile("event_id", [0.5], 0)[0]
    state = e.state_table(batch.where(f"event_id < {half}")).join(batch.select("event_id", "ts"), "event_id").select("path", "kind", "event_id", "ts")
    got = e.merge_state(state, batch.where(f"event_id >= {half}"))
    assert sorted(got.collect()) == sorted(e.state_table(batch).collect())
