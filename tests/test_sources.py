"""Readers and writers on written files."""

import json

import pytest

from corpusloom.sources import readers, tables


@pytest.fixture()
def folder(tmp_path):
    for name, text in {"a/one.md": "# One\r\nbody", "a/b/two.TXT": "two", "a/b/three.bin": "\x00\x01" * 600, "c/env.ini": "x=1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def test_inventory(spark, folder):
    got = readers.inventory(spark, [f"{folder}/a", f"{folder}/c"])
    assert sorted((r.name, r.ext, r.size) for r in got.collect()) == [("env.ini", ".ini", 3), ("one.md", ".md", 11), ("three.bin", ".bin", 1200), ("two.TXT", ".txt", 3)]
    some = readers.inventory(spark, [f"{folder}/a"], glob="*.{md,TXT}", most=5)
    assert [r.name for r in some.collect()] == ["two.TXT"]
    depth = {r.name: r.depth for r in got.collect()}
    assert depth["two.TXT"] == depth["one.md"] + 1


def test_snapshot_text_and_samples(spark, folder):
    files = readers.inventory(spark, [f"{folder}/a"])
    rows = tables.snapshot(files).collect()
    assert sorted(r.kind for r in rows) == ["dir", "dir", "file", "file", "file"] and all((r.sha1 is None) == (r.kind == "dir") for r in rows)
    texts = {r.name: r.t for r in files.where("ext <> '.bin'").select("name", tables.text_of(files["content"]).alias("t")).collect()}
    assert texts == {"one.md": "# One\nbody", "two.TXT": "two"}
    assert {r.name: len(r.sample) for r in tables.sampled(files, [".md", ".txt"], 5).collect()} == {"one.md": 5, "two.TXT": 3, "three.bin": 0}


def test_profiles_with_defaults_and_problems(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"defaults": {"role": "inbox"}, "profiles": [{"name": "a", "path": "/a", "protected": True}, {"name": "b", "path": "/b", "role": "work", "colour": "red"}]}))
    known, problems = tables.profiles(spark, str(tmp_path / "p.json"))
    assert sorted(map(tuple, known.collect())) == [("a", "/a", "inbox", True, False, 0.98), ("b", "/b", "work", False, False, 0.98)]
    assert [tuple(r) for r in problems.collect()] == [("b", "unknown key colour")]


def test_hand_edited_list_and_import(spark, tmp_path):
    (tmp_path / "d.csv").write_text("NAME,APPROVE\nA__b, Yes\nc__d,\ne, no\n")
    assert sorted((r.name, r.approved, r.parts) for r in tables.decisions(spark, str(tmp_path / "d.csv")).collect()) == [("A__b", 1, ["A", "b"]), ("e", 0, ["e"])]
    rows = spark.createDataFrame([("x", None), (" ", "f"), (None, "f")], "body string, folder string")
    assert [(r.body, r.folder) for r in tables.imported(rows, {"folder": "inbox"}).collect()] == [("x", "inbox")]


def test_ledger_manifest_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, kind string")
    tables.append(rows, str(tmp_path / "l"), "kind")
    tables.append(rows.limit(1), str(tmp_path / "l"), "kind")
    assert tables.json_table(spark, str(tmp_path / "l"), "id long, kind string").count() == 4
    tables.manifest(rows, ["kind"], str(tmp_path / "m"))
    assert sorted(len(r.rows) for r in spark.read.json(str(tmp_path / "m")).collect()) in ([1, 2], [1, 1, 1])
    path = str(tmp_path / "t")
    assert tables.current(spark, path) is None
    tables.upsert(rows, ["id"], path)
    new = tables.upsert(spark.createDataFrame([(2, "z"), (9, "n")], "id long, kind string"), ["id"], path)
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "z"), (3, "a"), (9, "n")] == sorted(map(tuple, tables.current(spark, path).collect()))
