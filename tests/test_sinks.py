"""Streams that end in tables: restarts, repeated batches, late and dead events, decisions and learning."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import tables
from corpusloom.streaming import ingest, learning, sinks

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, kind string, path string, dest_path string, is_directory boolean, ts timestamp"


def some_events(n=200, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["created", "modified", "deleted", "moved", "moved", None, "odd"]) if r.random() < 0.9 else "created"
        path = r.choice([None] + ["in/%s/f%d.%s" % (r.choice("ab"), r.randrange(12), r.choice(["md", "exe", "zip"])) for _ in range(9)])
        dest = "lib/f%d.md" % r.randrange(9) if kind == "moved" and r.random() < 0.8 else None
        rows.append((i, kind, path, dest, r.random() < 0.1, T0 + dt.timedelta(minutes=r.randrange(5000))))
    return rows


def arrivals(spark, rows, schema, path, parts=4):
    """Writes rows in files, and gives a function that opens the first k files as a stream."""
    size = -(-len(rows) // parts)

    def add(i):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)

    return add, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, step, checkpoint):
    q = sinks.started(stream, step, checkpoint)
    q.awaitTermination(180)
    assert q.exception() is None


def test_state_table_over_restarts_and_repeated_batches(spark, tmp_path):
    rows = some_events()
    good = [x for x in rows if x[1] in ("created", "modified", "deleted", "moved")]
    add, opened = arrivals(spark, good, EVENTS, str(tmp_path / "in"))
    path = str(tmp_path / "state")
    for i in range(4):  # each run is a restart from the checkpoint
        add(i)
        run(opened(), sinks.state_sink(path), str(tmp_path / "check"))
    got = sorted(map(tuple, tables.current(spark, path).collect()))
    want = sorted(map(tuple, sinks.last_states(sinks.states(spark.createDataFrame(good, EVENTS))).collect()))
    assert got == want and {"created", "deleted"} <= {x[1] for x in got} and any(x[2] for x in got)
    number = tables.versions(spark, path)[-1][1]
    size = -(-len(good) // 4)
    sinks.state_sink(path)(spark.createDataFrame(good[3 * size :], EVENTS), number)  # the last batch once more
    assert sorted(map(tuple, tables.current(spark, path).collect())) == want and tables.versions(spark, path)[-1][1] == number


def test_dead_letters_are_replayed(spark, tmp_path):
    rows = [(i, "created", f"p{i}", None, False, T0) for i in range(40)]
    add, opened = arrivals(spark, rows, EVENTS, str(tmp_path / "in"))
    sent, dead, open_until = str(tmp_path / "sent"), str(tmp_path / "dead"), [10]

    def accept(df):  # the receiver takes events up to a number that rises
        return df.withColumn("error", F.when(F.col("event_id") >= open_until[0], "closed"))

    for i in range(4):
        add(i)
        run(opened(), sinks.delivery_sink(accept, sent, dead), str(tmp_path / "check"))
        open_until[0] += 9
    got = [r.event_id for r in spark.read.parquet(sent).collect()]
    waiting = tables.current(spark, dead).collect()
    assert sorted(got) == list(range(37)) and sorted((r.event_id, r.tries) for r in waiting) == [(37, 1), (38, 1), (39, 1)]
    number = tables.versions(spark, dead)[-1][1]
    sinks.delivery_sink(accept, sent, dead)(spark.createDataFrame(rows[30:], EVENTS), number)  # once more, with an open receiver
    assert sorted(r.event_id for r in spark.read.parquet(sent).collect()) == list(range(40)) and tables.current(spark, dead).isEmpty()


def test_ledger_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    step = sinks.ledger_sink(str(tmp_path / "l"))
    for number in (0, 1, 1):
        step(df, number)
    assert spark.read.json(str(tmp_path / "l")).count() == 4


def test_ingest_stream_is_the_batch_form(spark, tmp_path):
    rows = some_events(120, 5)
    files = [(f"in/{d}/f{i}.{e}", f"in/{d}", f"f{i}", f".{e}", f"{i:064x}", b"PK\x03\x04" if e == "zip" else b"import x" if e == "exe" else b"text") for d in "ab" for i in range(9) for e in ("md", "exe", "zip")]
    files += [(f"lib/f{i}.md", "lib", f"f{i}", ".md", f"{i + 50:064x}", b"# t") for i in range(7)]
    profiles = [("inbox", "in", False, False, 0.5), ("safe", "in/b", True, False, 0.9), ("library", "lib", False, False, 0.95)]
    inventory = tables.replace(spark.createDataFrame(files, "path string, dir string, stem string, ext string, hash string, bytes binary"), str(tmp_path / "inv"))
    known = tables.replace(spark.createDataFrame(profiles, "name string, path string, protected boolean, review_only boolean, threshold double"), str(tmp_path / "prof"))
    add, opened = arrivals(spark, rows, EVENTS, str(tmp_path / "in"))
    for i in range(4):
        add(i)
    run(opened(), ingest.ingest_sink(str(tmp_path / "prof"), str(tmp_path / "inv"), str(tmp_path / "jobs")), str(tmp_path / "check"))
    got = sorted(map(str, tables.current(spark, str(tmp_path / "jobs")).select(ingest.COLUMNS).collect()))
    batch = ingest.decided(spark.createDataFrame(rows, EVENTS), known, inventory)
    assert got == sorted(map(str, batch.select(ingest.COLUMNS).collect())) and len(got) == len(rows)
    assert {r.status for r in batch.collect()} == {"dead", "ignored", "failed_retryable", "waiting_review", "completed"}
    reasons = {(r.profile, r.reason) for r in batch.collect()}
    assert {("safe", "protected_folder"), ("inbox", "risky_file_type"), ("library", "low_confidence")} <= reasons
    # a file that turns up later is found by the next version of the inventory
    missing = batch.where("status = 'failed_retryable'").first()
    tables.replace(inventory.unionByName(spark.createDataFrame([(missing.path, "x", "late", ".md", "0" * 64, b"t")], inventory.schema)), str(tmp_path / "inv"))
    again = spark.createDataFrame([x for x in rows if x[0] == missing.event_id], EVENTS)
    ingest.ingest_sink(str(tmp_path / "prof"), str(tmp_path / "inv"), str(tmp_path / "jobs"))(again, 99)
    assert tables.current(spark, str(tmp_path / "jobs")).where(f"event_id = {missing.event_id}").first().status in ("waiting_review", "completed")


DECISIONS = "doc_id long, ts timestamp, approved int, key string, tags array<string>"


def some_decisions(n=160, seed=2):
    r = random.Random(seed)
    return [(i, T0 + dt.timedelta(minutes=i), int(r.random() < 0.6), r.choice("abc"), r.choice([None, [], ["x"], ["x", "y", None], ["z", "z"]])) for i in range(n)]


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_learning_stream_is_the_replay_in_order(spark, rocks, tmp_path):
    rows = some_decisions()
    add, opened = arrivals(spark, rows, DECISIONS, str(tmp_path / "in"))
    path = str(tmp_path / "p")
    for i in range(4):  # state comes back from the checkpoint
        add(i)
        run(learning.learned(opened(), "60 days"), learning.prediction_sink(path), str(tmp_path / "check"))
    got = sorted(map(tuple, tables.current(spark, path).collect()))
    keys, tags, want = {}, {}, []
    rate = lambda d: (d[0] + 1.0) / (d[1] + 2.0)
    for i, _, y, key, names in rows:
        names = sorted({t for t in names or [] if t is not None})
        known = [rate(tags[t]) for t in names if t in tags]
        k = keys.setdefault(key, [0, 0])
        p = 0.6 * rate(k) + 0.4 * sum(known) / len(known) if known else rate(k)
        want.append((i, y, pytest.approx(p, abs=1e-4), k[1] >= 4))
        for d in [k, *(tags.setdefault(t, [0, 0]) for t in names)]:
            d[0] += y
            d[1] += 1
    assert got == want
    batch = learning.predicted(learning.learned_batch(spark.createDataFrame(rows, DECISIONS)))
    assert sorted(map(tuple, batch.collect())) == got


def test_silent_units_are_forgotten(spark, rocks, tmp_path):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(1, hour(0), 1, "a", None), (2, hour(1), 1, "b", None), (3, hour(30), 1, "b", None), (4, hour(60), 1, "b", None), (5, hour(61), 1, "a", None), (6, hour(62), 1, "b", None)]
    add, opened = arrivals(spark, rows, DECISIONS, str(tmp_path / "in"), 6)
    path = str(tmp_path / "u")

    def step(batch, number):
        tables.upsert(batch, ["doc_id", "unit"], path, batch=number)

    for i in range(6):
        add(i)
        run(learning.learned(opened(), "1 minute", keep=40 * 3600 * 1000), step, str(tmp_path / "check"))
    assert {r.doc_id: r.seen for r in tables.current(spark, path).collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0, 6: 3}
