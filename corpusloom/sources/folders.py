"""A data source of files and folders: `spark.read.format("folders")`.

It lists what Spark's file readers hide: names that begin with a dot or an underscore, folders, and empty folders. The
driver lists folders breadth first, only until there are enough of them to share out; tasks walk the rest. A folder
that was listed on the driver becomes a partition of its own entries, every other one a partition with all below it.

Paths are URIs or plain paths of any store that pyarrow knows (local, hdfs, s3, gcs). Links are not followed. Entries
that can't be read give no row of content and an `error`; a root that doesn't exist gives one row with an error. Roots
inside each other list their common files once for each root.

Options: `roots` (a JSON list), `skip` (JSON list of folder names not entered), `exts` (JSON list, lower case, with the
dot), `least` and `most` bytes, `content` (`none`, `head` for the first `head` bytes, or `all`), `spread` (folders
that the driver looks for).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = ["root", "kind", "path", "dir", "name", "stem", "ext", "depth", "size", "mtime", "content", "error"]
SCHEMA = "root string, kind string, path string, dir string, name string, stem string, ext string, depth int, size bigint, mtime timestamp, content binary, error string"
#: Rows and bytes of content in an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20
_TYPES = pa.schema([("root", pa.string()), ("kind", pa.string()), ("path", pa.string()), ("dir", pa.string()), ("name", pa.string()), ("stem", pa.string()), ("ext", pa.string()), ("depth", pa.int32()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("error", pa.string())])


@dataclass
class Part(InputPartition):
    root: str
    folder: str
    below: bool


def opened(root: str) -> tuple[pa.fs.FileSystem, str]:
    store, path = pa.fs.FileSystem.from_uri(root) if "://" in root else (pa.fs.LocalFileSystem(), root)
    return store, path.rstrip("/") or "/"


def split_name(name: str) -> tuple[str, str]:
    """Stem and lower-case extension; a leading dot belongs to the stem."""
    at = name.rfind(".")
    return (name[:at], name[at:].lower()) if 0 < at < len(name) - 1 else (name, "")


class Walk(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options.get("roots") or json.dumps([options["path"]]))
        self.skip, self.exts = frozenset(json.loads(options.get("skip", "[]"))), frozenset(json.loads(options.get("exts", "[]")))
        self.least, self.most = int(options.get("least", 0)), int(options.get("most", 1 << 62))
        self.content, self.head = options.get("content", "none"), int(options.get("head", 4096))
        self.spread = int(options.get("spread", 256))
        if self.content not in ("none", "head", "all"):
            raise ValueError("content is none, head or all")

    def partitions(self) -> list[Part]:
        out, level = [], []
        for root in self.roots:
            store, path = opened(root)
            level.append((store, root, path))
        while level and len(out) + len(level) < self.spread:
            deeper = []
            for store, root, folder in level:
                out.append(Part(root, folder, False))
                deeper += [(store, root, x.path) for x in self.entries(store, folder) if x.type == pa.fs.FileType.Directory and x.base_name not in self.skip]
            level = deeper
        return out + [Part(root, folder, True) for _, root, folder in level]

    def entries(self, store: pa.fs.FileSystem, folder: str) -> list[pa.fs.FileInfo]:
        try:
            return sorted(store.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.path)
        except OSError:
            return []

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, root = opened(part.root)
        rows, held = [], 0
        if part.folder == root and (info := store.get_file_info(root)).type != pa.fs.FileType.Directory:
            rows.append(self.row(part.root, root, "error", info, None, "no such folder"))
        elif part.folder == root:
            rows.append(self.row(part.root, root, "dir", store.get_file_info(root), None, None))
        waiting = [part.folder]
        while waiting:
            folder = waiting.pop()
            for info in self.entries(store, folder):
                if info.type == pa.fs.FileType.Directory:
                    if info.base_name in self.skip:
                        continue
                    rows.append(self.row(part.root, root, "dir", info, None, None))
                    if part.below:
                        waiting.append(info.path)
                elif info.type == pa.fs.FileType.File and self.least <= info.size <= self.most and (not self.exts or split_name(info.base_name)[1] in self.exts):
                    content, error = self.bytes_of(store, info)
                    rows.append(self.row(part.root, root, "file", info, content, error))
                    held += len(content or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _TYPES)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _TYPES)

    def bytes_of(self, store: pa.fs.FileSystem, info: pa.fs.FileInfo) -> tuple[bytes | None, str | None]:
        if self.content == "none":
            return None, None
        try:
            with store.open_input_stream(info.path) as f:
                return (f.read(self.head) if self.content == "head" else f.read()), None
        except OSError as e:
            return None, str(e)

    def row(self, root: str, top: str, kind: str, info: pa.fs.FileInfo, content: bytes | None, error: str | None) -> dict:
        path = info.path.rstrip("/") or "/"
        folder, _, name = path.rpartition("/")
        stem, ext = split_name(name)
        inside = path[len(top) :].strip("/")
        depth = inside.count("/") + (1 if kind == "dir" and inside else 0)
        return {"root": root, "kind": kind, "path": path, "dir": folder, "name": name, "stem": stem, "ext": ext, "depth": depth, "size": info.size if kind == "file" else None, "mtime": info.mtime, "content": content, "error": error}


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Walk:
        return Walk(dict(self.options))


def walk(spark: SparkSession, roots: list[str], skip: list[str] | None = None, exts: list[str] | None = None, least: int = 0, most: int | None = None, content: str = "none", head: int = 4096, spread: int = 256) -> DataFrame:
    """COLUMNS of every file and folder below the roots, hidden and empty ones too; depth counts folders between root and entry (of a file), or down to it (of a folder)."""
    spark.dataSource.register(Folders)
    reader = spark.read.format("folders").option("roots", json.dumps(roots)).option("least", least).option("content", content).option("head", head).option("spread", spread)
    for k, v in (("skip", skip), ("exts", exts)):
        if v:
            reader = reader.option(k, json.dumps(v))
    return (reader.option("most", most) if most is not None else reader).load()


def files_of(entries: DataFrame, since: str = "1970-01-01") -> DataFrame:
    """The files as the detectors take them: content is text, `day` counts days from `since`, `hash` is that of the content."""
    day = F.datediff(F.to_date("mtime"), F.lit(since).cast("date"))
    names = {"day": day, "hash": F.sha2("content", 256), "encoding_bytes": F.col("content"), "content": F.make_valid_utf8(F.col("content").cast("string"))}
    return entries.where("kind = 'file'").withColumns(names).drop("kind", "error", "mtime")


def dirs_of(entries: DataFrame, since: str = "1970-01-01") -> DataFrame:
    """(root, dir, parent, base, day) of the folders as the detectors take them; a root's parent is null."""
    day = F.datediff(F.to_date("mtime"), F.lit(since).cast("date"))
    return entries.where("kind = 'dir'").select("root", F.col("path").alias("dir"), F.when(F.col("depth") > 0, F.col("dir")).alias("parent"), F.col("name").alias("base"), day.alias("day"))


def snapshot(entries: DataFrame) -> DataFrame:
    """(path, kind, size, mtime, sha1): an inventory to be written as JSON lines; folders have neither size nor hash."""
    return entries.where("kind <> 'error'").select("path", "kind", "size", "mtime", F.sha1("content").alias("sha1"))
