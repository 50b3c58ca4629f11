"""Registries of many files: defaults, drift, problems, and one row a key over runs."""

import json
import os

from corpusloom.sources import registries, tables


def put(path, data, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    if at:
        os.utime(path, (at, at))


def test_buckets_of_many_files(spark, tmp_path):
    root, table = tmp_path / "m", str(tmp_path / "t")
    put(root / "a" / "_bucket.json", {"bucket_id": "one", "label": "One", "allowed_agents": ["x", "y"], "requires_approval_to_share": False}, 1000)
    put(root / "b" / "c" / "_bucket.json", {"bucket_id": "two", "label": "Two", "visibility": "public", "colour": "red"}, 1000)
    put(root / "d" / "_bucket.json", {"bucket_id": "one", "label": "One again"}, 2000)
    put(root / "e" / "_bucket.json", {"label": "nameless"})
    put(root / "f" / "_bucket.json", "[1, 2]")
    put(root / "g" / "other.json", {"bucket_id": "no", "label": "no"})
    got, problems = registries.indexed(spark, [str(root)], table)
    rows = {r.bucket_id: r for r in got.collect()}
    assert set(rows) == {"one", "two"} and rows["one"].label == "One again" and rows["one"].allowed_agents == [] and rows["one"].requires_approval_to_share
    assert (rows["two"].owner, rows["two"].visibility, rows["two"].vector_namespace) == ("operator", "public", None) and rows["two"].path.endswith("/b/c")
    assert sorted((r.file.rsplit("/", 2)[1], r.problem) for r in problems.collect()) == [("c", "unknown key colour"), ("e", "bucket_id is missing"), ("f", "no JSON object")]
    put(root / "b" / "c" / "_bucket.json", {"bucket_id": "two", "label": "Changed"})
    (root / "a" / "_bucket.json").unlink(), (root / "d" / "_bucket.json").unlink()
    again, _ = registries.indexed(spark, [str(root)], table)
    assert sorted((r.bucket_id, r.label) for r in again.collect()) == [("one", "One again"), ("two", "Changed")]
    assert len(tables.versions(spark, table)) == 2


def test_capability_access(spark, tmp_path):
    entries = spark.createDataFrame([("medical", "pending", 0.6), ("uncategorized", "local", 0.1)], "category string, access string, threshold double")
    path = str(tmp_path / "r")
    tables.upsert(entries, ["category"], path)
    tables.upsert(registries.with_access(tables.current(spark, path), "medical", "available"), ["category"], path)
    tables.upsert(registries.with_access(tables.current(spark, path), "absent", "available"), ["category"], path)
    asked = spark.createDataFrame([(1, "medical"), (2, "poetry"), (3, None)], "id int, category string")
    assert sorted((r.id, r.access) for r in registries.access_of(asked, tables.current(spark, path)).collect()) == [(1, "available"), (2, "local"), (3, "local")]
