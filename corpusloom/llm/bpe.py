"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Frequent pieces (words with their leading blank, numbers, marks) and their ids are compiled into a minimal acyclic
automaton: words with the same endings share states, and the words passed over on the way to a final state give the
row of its ids. It is a file that Spark hands to every executor, where workers map it into memory. Pieces that it
lacks are merged exactly by the merge table, and a bounded table keeps the pieces a worker has met.

Null texts are empty: no ids. Repeated rows give repeated rows. An empty table gives an empty result. Extra columns
are dropped, whatever their names. A text of any length is encoded whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bpe
from ._arrow import binary_column
from ._store import shared_dir
from ._words import keyed_hash, new_key, slices

#: Most words that the transducer holds, and the least share of some partition's pieces that a word must have.
MOST_WORDS, LEAST_SHARE = 1 << 16, 1e-6
#: Bytes of text that a task looks at together.
SLICE = 1 << 19


class Transducer:
    """A minimal acyclic automaton over bytes whose accepted words are numbered in byte order; `first`, `ids` hold a word's ids."""

    FIELDS = ("key", "target", "skip", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for k in self.FIELDS:
            setattr(self, k, arrays[k])

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        register: dict[tuple, int] = {}
        states: list[tuple[bool, list[tuple[int, int]]]] = []

        def close(node: list) -> int:
            sig = (node[0], tuple(node[1]))
            if sig not in register:
                register[sig] = len(states)
                states.append(sig)
            return register[sig]

        path: list[list] = [[False, []]]
        last = b""
        order = sorted(words)
        for w in [*order, None]:
            same = 0 if w is None else len(os.path.commonprefix([last, w]))
            while len(path) > same + 1:
                done = close(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            if w is None:
                break
            path.extend([False, []] for _ in w[same:])
            path[-1][0] = True
            last = w
        root = close(path[0])
        size = [0] * len(states)
        key, target, skip = [], [], []
        for s, (final, arcs) in enumerate(states):  # targets come before their sources
            seen = int(final)
            for byte, t in arcs:
                key.append(s << 8 | byte)
                target.append(t)
                skip.append(seen)
                seen += size[t]
            size[s] = seen
        counts = [len(words[w]) for w in order]
        return cls({
            "key": np.array([*key, 1 << 62], np.int64), "target": np.array([*target, 0], np.int64), "skip": np.array([*skip, 0], np.int64),
            "final": np.array([*(x[0] for x in states), root], np.int64),  # the last entry is the root's number
            "first": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), "ids": np.array([i for w in order for i in words[w]], np.uint32),
        })

    def to_bytes(self) -> bytes:
        """All arrays as one file: a line of their lengths, then their bytes."""
        head = " ".join(str(len(getattr(self, k))) for k in self.FIELDS).encode()
        return head.ljust(128) + b"".join(np.ascontiguousarray(getattr(self, k)).tobytes() for k in self.FIELDS)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def open(cls, path: str) -> Transducer:
        data = np.memmap(path, np.uint8, "r")
        arrays, at = {}, 128
        for k, n in zip(cls.FIELDS, map(int, bytes(data[:128]).split()), strict=True):
            kind = np.uint32 if k == "ids" else np.int64
            end = at + n * np.dtype(kind).itemsize
            arrays[k] = data[at:end].view(kind)
            at = end
        return cls(arrays)

    def rows(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word laid in data, -1 if it isn't in the automaton; all words walk in step."""
        out = np.full(len(sizes), -1, np.int64)
        starts = np.cumsum(sizes) - sizes
        live, state, number = np.arange(len(sizes)), np.full(len(sizes), self.final[-1]), np.zeros(len(sizes), np.int64)
        step = 0
        while len(live):
            ended = sizes[live] == step
            good = ended & (self.final[state] == 1)
            out[live[good]] = number[good]
            live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live):
                break
            want = state << 8 | data[starts[live] + step]
            at = np.searchsorted(self.key, want)
            ok = self.key[at] == want
            at, live = at[ok], live[ok]
            state, number = self.target[at], number[ok] + self.skip[at]
            step += 1
        return out


def piece_bytes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


def transduce(lexicon: Transducer, merges: _bpe.Merges, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces and their counts: of known words from the transducer, of the others by merging."""
    data, sizes = piece_bytes(pieces)
    row = lexicon.rows(data, sizes)
    known = row >= 0
    counts = np.zeros(len(sizes), np.int64)
    counts[known] = lexicon.first[row[known] + 1] - lexicon.first[row[known]]
    rest = np.flatnonzero(~known)
    made = np.zeros(0, np.int64)
    if len(rest):
        made, counts[rest] = merges.apply(data[np.repeat(~known, sizes)], sizes[rest])
    ids = np.zeros(counts.sum(), np.uint32)
    is_known = np.repeat(known, counts)
    ids[~is_known] = made
    n = counts[known]
    if len(n):
        total = np.cumsum(n)
        ids[is_known] = lexicon.ids[np.arange(total[-1]) + np.repeat(lexicon.first[row[known]] - (total - n), n)]
    return ids, counts


def count_pieces(docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """(piece, n): counts of the pieces of all texts; a partition reports those that make up least_share of its pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, str] = {}
        own = new_key()
        keys, counts, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for piece, _ in slices(batches, "t", most=SLICE):
            joined = "\n".join(x for x in piece.column("t").to_pylist() if x)
            if not joined:
                continue
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
            start = _bpe.split(points, np.zeros(1, np.int64))
            end = np.append(start[1:], len(points))
            k, some, n = np.unique(keyed_hash(points.view(np.uint8), start * 4, end * 4, own), return_index=True, return_counts=True)
            seen += len(start)
            fresh = np.flatnonzero((n >= 2) & ~np.isin(k, keys, assume_unique=True)) if len(keys) < MOST_WORDS * 4 else []
            names.update((int(k[i]), joined[start[some[i]] : end[some[i]]]) for i in fresh)
            both = np.concatenate([keys, k[fresh]])
            keys, order = np.unique(both, return_index=True)
            counts = np.concatenate([counts, np.zeros(len(fresh), np.int64)])[order]
            at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
            if len(keys):
                hit = keys[at] == k
                counts[at[hit]] += n[hit]
        top = np.flatnonzero(counts >= max(2, least_share * seen))
        yield pa.record_batch([pa.array([names[int(x)] for x in keys[top]], pa.string()), pa.array(counts[top])], ["piece", "n"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def compile_lexicon(spark: SparkSession, docs: DataFrame, merges: _bpe.Merges, text_col: str = "text", most: int = MOST_WORDS) -> str:
    """Builds the transducer of the `most` most frequent pieces and hands its file to the executors; returns the file's name."""
    top = count_pieces(docs, text_col).orderBy(F.desc("n"), "piece").limit(most).select("piece").toPandas()["piece"].tolist()
    words = {}
    if top:
        data, sizes = piece_bytes(top)
        ids, counts = merges.apply(data, sizes)
        at = np.concatenate([[0], np.cumsum(counts)])
        words = {p.encode("utf-8", "surrogatepass"): ids[at[i] : at[i + 1]].tolist() for i, p in enumerate(top)}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(Transducer.build(words).to_bytes())
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def special_ids(model: dict) -> dict[str, int]:
    return {x["content"]: x["id"] for x in model["added_tokens"]}


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): ids as little-endian unsigned 32-bit integers in one binary."""
    spark = docs.sparkSession
    model = _bpe.load(tokenizer_path)
    merges = _bpe.Merges(model["model"])
    name, shared = compile_lexicon(spark, docs, merges, text_col), spark.sparkContext.broadcast((merges, special_ids(model)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, special = shared.value
        lexicon = Transducer.open(SparkFiles.get(name))
        table = _bpe.PieceTable(lambda pieces: transduce(lexicon, merges, pieces))
        for piece, _ in slices(batches, "t", most=SLICE):
            ids, counts = _bpe.encode_texts(piece.column("t").to_pylist(), table, special)
            yield pa.record_batch([piece.column("id"), binary_column(ids.astype("<u4"), counts * 4)], [id_col, "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """All columns, and `decoded`, the text of the ids; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""
    spark = encoded.sparkSession
    model = _bpe.load(tokenizer_path)
    letters = {c: b for b, c in enumerate(_bpe.byte_letters())}
    names = {i: bytes(letters[c] for c in t) for t, i in model["model"]["vocab"].items()} | {i: t.encode() for t, i in special_ids(model).items()}
    sizes = np.array([len(names.get(i, b"")) for i in range(max(names) + 1)], np.int64)
    flat = np.frombuffer(b"".join(names.get(i, b"") for i in range(len(sizes))), np.uint8)
    shared = spark.sparkContext.broadcast((sizes, np.cumsum(sizes) - sizes, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, flat = shared.value
        for piece, _ in slices(batches, ids_col, most=4 * SLICE):
            texts = []
            for raw in piece.column(ids_col):
                ids = np.frombuffer(raw.as_py() or b"", "<u4")
                n = sizes[ids]
                total = np.cumsum(n)
                at = np.arange(total[-1] if len(n) else 0) + np.repeat(first[ids] - (total - n), n)
                texts.append(flat[at].tobytes().decode("utf-8", "replace"))
            columns = [*piece.columns, pa.array(texts, pa.string())]
            yield pa.record_batch(columns, [*piece.schema.names, "decoded"])

    df = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded."""
    return decode(encode(docs, tokenizer_path), tokenizer_path).select(
        "doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
