"""Files and folders read by the data source feed the detectors."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import diagnostics
from corpusloom.operators.encodings import encoding
from corpusloom.sources import folders, tables

GERMAN, RUSSIAN = "Größe und Übermut über alle Maßen, schöne Grüße. " * 3, "Привет, это обычный русский текст. " * 3


@pytest.fixture()
def tree(tmp_path):
    files = {
        "app/package.json": "{}", "app/.git/HEAD": "ref", "app/a.docx": "x", "app/b.pdf": "x", "app/c.jpg": "x", "app/d.PNG": "x",
        "residue/node_modules/x.js": "1", "leak/.env": "KEY=1", "leak/conf.ini": "api_key = sk-123", "notes/_draft.md": "# x", "notes/.hidden.txt": "h",
        "enc/a.txt": GERMAN, "enc/b.txt": GERMAN.encode("latin-1"), "enc/c.txt": RUSSIAN.encode("koi8-r"), "plain/a.txt": GERMAN, "plain/b.txt": "only letters here",
    }
    for name, text in files.items():
        path = tmp_path / "top" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    (tmp_path / "top" / "nothing" / "deeper").mkdir(parents=True)
    return tmp_path / "top"


@pytest.mark.parametrize("spread", [1, 4, 1000])
def test_everything_is_listed_once(spark, tree, spread):
    got = folders.walk(spark, [str(tree)], spread=spread).collect()
    want = {(os.path.join(d, x), "file") for d, _, names in os.walk(tree) for x in names} | {(d, "dir") for d, _, _ in os.walk(tree)}
    assert sorted((r.path, r.kind) for r in got) == sorted(want)
    by_path = {r.path.removeprefix(str(tree)): r for r in got}
    assert by_path["/leak/.env"].stem == ".env" and by_path["/leak/.env"].ext == "" and by_path["/app/d.PNG"].ext == ".png"
    assert [by_path[p].depth for p in ("", "/app", "/app/.git", "/app/.git/HEAD", "/nothing/deeper")] == [0, 1, 2, 2, 2]
    assert by_path["/app/package.json"].size == 2 and by_path["/app"].size is None


def test_filters_content_and_missing_roots(spark, tree):
    some = folders.walk(spark, [f"{tree}/app", f"{tree}/enc"], skip=[".git"], exts=[".txt", ".pdf"], most=len(GERMAN.encode()) - 1, content="head", head=5)
    assert sorted((r.name, bytes(r.content)) for r in some.where("kind = 'file'").collect()) == [("b.pdf", b"x"), ("b.txt", GERMAN.encode("latin-1")[:5]), ("c.txt", RUSSIAN.encode("koi8-r")[:5])]
    lost = folders.walk(spark, [f"{tree}/none", f"file://{tree}/plain"]).collect()
    assert sorted((r.kind, r.name, r.error) for r in lost) == [("dir", "plain", None), ("error", "none", "no such folder"), ("file", "a.txt", None), ("file", "b.txt", None)]
    assert folders.walk(spark, [f"{tree}/nothing/deeper"]).select("kind").collect()[0].kind == "dir"


def test_detectors_find_what_readers_hide(spark, tree):
    entries = folders.walk(spark, [str(tree)], content="all")
    files = folders.files_of(entries).withColumn("encoding", encoding(F.substring("encoding_bytes", 1, 4096)))
    found = diagnostics.scan(files, folders.dirs_of(entries), 20000, ["I01", "I02", "I03", "I05", "N03", "C07"]).collect()
    short = {(r.symptom, r.path.removeprefix(str(tree))) for r in found}
    assert {("I01", "/app"), ("I02", "/residue/node_modules"), ("I03", "/leak/.env"), ("I03", "/leak/conf.ini"), ("I05", "/app/a.docx"), ("N03", "/nothing/deeper"), ("C07", "/enc")} <= short
    assert not {("C07", "/plain"), ("N03", "/app")} & short


def test_encodings(spark):
    rows = {
        "ASCII": b"plain text", "UTF-8": GERMAN.encode()[:2 + 1], "UTF-8-SIG": GERMAN.encode("utf-8-sig"), "UTF-16LE": GERMAN.encode("utf-16-le"), "UTF-16BE": GERMAN.encode("utf-16-be"), "UTF-32LE": GERMAN.encode("utf-32"),
        "ISO-8859-1": GERMAN.encode("latin-1"), "WINDOWS-1252": f"“{GERMAN}”".encode("cp1252"), "KOI8-R": RUSSIAN.encode("koi8-r"), "WINDOWS-1251": RUSSIAN.encode("cp1251"), "BINARY": bytes(range(256)), "EMPTY": b"",
    }
    df = spark.createDataFrame([*rows.items(), (None, None)], "want string, c binary")
    assert all(r.want == r.got for r in df.select("want", encoding(F.col("c")).alias("got")).collect())


def test_snapshot_as_lines(spark, tree, tmp_path):
    snap = folders.snapshot(folders.walk(spark, [str(tree)], content="all"))
    tables.append(snap, str(tmp_path / "snap"))
    again = tables.json_table(spark, str(tmp_path / "snap"), "path string, kind string, size bigint, mtime timestamp, sha1 string")
    assert sorted(map(str, again.drop("mtime").collect())) == sorted(map(str, snap.drop("mtime").collect()))
    assert json.loads(next(iter((tmp_path / "snap").glob("part-*"))).read_text().splitlines()[0])["kind"] in ("dir", "file")
