"""Benchmark decontamination with Aho-Corasick automata over normalised benchmark texts.

A word is a run of characters other than ASCII marks and blanks, A-Z lower-cased. Every window of `width` words of an
item (the whole item, if it has fewer) is a pattern. One automaton scans each document's normalised words once, and
matches are mapped to offsets of the original text. The benchmark's size is measured first: up to MOST_BYTES of text
go into one automaton; a larger benchmark is dealt to several, one pass each, and the passes' matches are merged.

Null texts have no words; items without words give no pattern; null item ids mark words but name no item. Repeated
documents keep a row each, repeated items count once. An empty benchmark leaves all documents clean. Extra columns are
kept by `decontaminate` and dropped by `scan`.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh
from ._words import slices

WIDTH = 10
MOST_BYTES = 16 << 20
#: The bytes that part words once A-Z are lower-cased.
_PARTING = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in _PARTING:
    if not 65 <= _c <= 90:
        _TABLE[_c] = 32
_TABLE = bytes(_TABLE)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN = "array<struct<word_start: int, word_end: int, start: int, end: int>>"
_SPAN = pa.list_(pa.struct([("word_start", pa.int32()), ("word_end", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_automata: dict[str, ahocorasick.Automaton] = {}


def normal(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def patterns(items: list[tuple], width: int = WIDTH) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Each window as a text with a blank before every word and at the end, its words, and the items that have it."""
    found: dict[str, tuple[int, set]] = {}
    for name, text in items:
        words = normal(text or "")
        for i in range(max(1, len(words) - width + 1) if words else 0):
            part = words[i : i + width]
            have = found.setdefault(" " + b" ".join(part).decode("utf-8", "surrogatepass") + " ", (len(part), set()))[1]
            if name is not None:
                have.add(str(name))
    return {k: (n, tuple(sorted(v))) for k, (n, v) in found.items()}


def _automaton(shared) -> ahocorasick.Automaton:
    if shared.value[0] not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for k, (n, items) in shared.value[1].items():
            a.add_word(k, (len(k), n, items))
        if len(a):
            a.make_automaton()
        _automata[shared.value[0]] = a
    return _automata[shared.value[0]]


def find(automaton: ahocorasick.Automaton, text: str, spans: list, items: set) -> tuple[int, list, set]:
    """The text's number of words, and the matched spans and items with those found before."""
    words = normal(text)
    hits = []
    if words and len(automaton):
        line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        hits = list(automaton.iter(line))
    if hits:
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        mask = np.zeros(len(words) + 1, np.int32)
        first = np.searchsorted(blanks, [end - size + 1 for end, (size, _, _) in hits])
        np.add.at(mask, first, 1)
        np.add.at(mask, first + [n for _, (_, n, _) in hits], -1)
        hit = np.cumsum(mask)[:-1] > 0
        for s in spans:
            hit[s["word_start"] : s["word_end"]] = True
        places = [m.span() for m in _WORD.finditer(text)]
        step = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        spans = [{"word_start": a, "word_end": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
        items = items.union(*(x[1][2] for x in hits))
    return len(words), spans, items


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id_col, n_words, spans, items): the matched spans, by words and by characters of the original, and the items."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(total / most_bytes))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`id` {id_type}, t string, n_words bigint, spans {SPAN}, items array<string>"
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.array().cast(SPAN), "items": F.array().cast("array<string>")})
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(parts)) == k) if parts > 1 else items
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, patterns([tuple(r) for r in mine.collect()], width)))
        last = k == parts - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared)
            for piece, _ in slices(batches, "t"):
                found = [find(automaton, t or "", s, set(i)) for t, s, i in zip(piece.column("t").to_pylist(), piece.column("spans").to_pylist(), piece.column("items").to_pylist(), strict=True)]
                yield pa.record_batch([piece.column("id"), pa.nulls(len(found), pa.string()) if last else piece.column("t"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], _SPAN), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))], ["id", "t", "n_words", "spans", "items"])

        df = df.mapInArrow(run, schema)
    return df.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def digests(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["word_end"] - s["word_start"])
    return scan(docs, benchmark, width).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any match, with all their columns; the matching ids, unique, are anti-joined."""
    name = fresh(docs.columns, "bad_id")
    bad = scan(docs.where(F.col(id_col).isNotNull()), benchmark, width, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias(name)).distinct()
    return docs.join(bad, F.col(id_col) == F.col(name), "left_anti")
