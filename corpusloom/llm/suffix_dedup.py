"""Suffix-array dedup with sparse suffix arrays.

Only suffixes at content-selected places are kept: the anchors of _repeats, of which every window of `length` words has
one. A shard sorts its suffixes by the words from the anchor on, compares neighbours for their common length to the
right, does the same with the words before the anchor for the length to the left, and so extends each match in both
directions: two windows around the anchor are equal if their right parts lie in one run of neighbours with at least
that common length, and their left parts too. Repeated passages of at least `length` words are reported where they
start later than an equal one.

Only documents with such passages give a row. Null texts have no words. Rows that share an id are judged as one
document and give one row; rows without an id give none. An empty table gives an empty result. Extra columns are
dropped. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats

LENGTH, GRAM = 50, 16


def sorted_runs(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (or reversed prefixes) and each one's common length with the one before it, up to width."""
    at = first[:, None] + (-1 - np.arange(width) if backward else np.arange(width))
    inside = np.arange(width) < sizes[:, None]
    table = np.where(inside, words[np.clip(at, 0, len(words) - 1)] + 1, 0).astype(">u4")
    order = np.argsort(np.ascontiguousarray(table).view(f"V{4 * width}").ravel(), kind="stable") if width else np.arange(len(first))
    same = np.zeros(len(first), np.int64)
    if width and len(first) > 1:
        equal = (table[order[1:]] == table[order[:-1]]) & inside[order[1:]]
        same[1:] = np.where(equal.all(1), width, np.argmin(equal, 1))
    return order, same


def shard(ids: np.ndarray, starts: np.ndarray, words: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, length: int) -> np.ndarray:
    """For each window of each segment: whether an equal one is earlier."""
    _, words = np.unique(words, return_inverse=True)
    first = np.cumsum(sizes) - sizes + anchors
    right, right_same = sorted_runs(words, first, sizes - anchors, length, False)
    left, left_same = sorted_runs(words, first, anchors, length - 1, True)
    windows = sizes - length + 1
    base = np.cumsum(windows) - windows
    group = np.zeros(int(windows.sum()), np.int64)
    used = 0
    m = len(sizes)
    cluster_r, cluster_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for before in range(int(anchors.max()) + 1):
        nth = anchors - before
        mine = np.flatnonzero((nth >= 0) & (nth < windows))
        if not len(mine):
            continue
        cluster_r[right] = np.cumsum(right_same < length - before)
        cluster_l[left] = np.cumsum(left_same < before) if before else 1
        key, back = np.unique(cluster_r[mine] * (m + 2) + cluster_l[mine], return_inverse=True)
        group[base[mine] + nth[mine]] = used + back
        used += len(key)
    row = np.repeat(np.arange(m), windows)
    return _repeats.earliest(group, ids[row], starts[row] + np.arange(len(row)) - base[row])


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_removed, spans): of every document with later copies of passages, their word spans, merged."""
    spans = _repeats.find(docs, length, gram, shard, id_col=id_col, text_col=text_col)
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))),
    )
    out = spans.select(F.col("id").alias(id_col), joined.alias("spans"))
    return out.select(id_col, F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"), "spans")


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_removed, n_spans, spans): spans as start-end of words, joined by commas."""
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return repeats(docs, length).select("doc_id", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), text.alias("spans"))
