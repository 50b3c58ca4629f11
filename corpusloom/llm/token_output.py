"""Token files: a wavelet matrix for each shard of documents in ascending id order.

A shard's file holds its document ids and offsets, and its token ids as succinct bit planes (as many as the largest id
of the vocabulary has bits) with counts of ones per block. From that one file a token can be read at any place (access), counted before any place (rank) and found
(select) without unpacking the others. Files are written by Spark as rows of a table in the shared folder, so lost
executors and repeated tasks leave no half-written shard.

Null texts are empty: the end id only. Repeated ids keep a row each, ordered by their texts' bytes, null first. Rows
without an id come first of all, ordered likewise. An empty table gives no shard and an empty result. Extra columns are
dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bpe
from ._store import new_path
from ._words import slices

BLOCK = 512
#: Tokens of a shard file; a partition with more writes several.
SHARD_TOKENS = 1 << 22
SHARD_SCHEMA = "shard int, part int, doc_ids binary, without_id int, doc_sizes binary, n_tokens bigint, planes binary"


class WaveletMatrix:
    """Bit planes from the highest bit down, each with the number of ones before every block of BLOCK bits."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.planes, self.ones, self.bits = n, planes, ones, len(planes)
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        x, planes, ones = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], []
        for level in range(bits):
            bit = (x >> x.dtype.type(bits - 1 - level)) & x.dtype.type(1) != 0
            plane = np.packbits(np.append(bit, np.zeros(-len(bit) % BLOCK, bool)))
            planes.append(plane)
            per = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
            ones.append(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
            x = np.concatenate([x[~bit], x[bit]])
        return cls(len(ids), planes, ones)

    def to_bytes(self) -> bytes:
        return b"".join([np.array([self.n, self.bits]).tobytes(), *(a.tobytes() for p in zip(self.planes, self.ones, strict=True) for a in p)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        n, bits = np.frombuffer(raw, np.int64, 2).tolist()
        blocks = -(-n // BLOCK)
        at, planes, ones = 16, [], []
        for _ in range(bits):
            planes.append(np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
            ones.append(np.frombuffer(raw, np.int32, blocks + 1, at))
            at += (blocks + 1) * 4
        return cls(n, planes, ones)

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before place i of a plane."""
        block, rest = i // BLOCK, i % BLOCK
        width = BLOCK // 8
        at = np.minimum(block[:, None] * width + np.arange(width), len(self.planes[level]) - 1)  # beyond the end, rest is 0
        bits = np.unpackbits(self.planes[level][at], axis=1)
        return self.ones[level][block] + (bits * (np.arange(BLOCK) < rest[:, None])).sum(1, dtype=np.int64)

    def access(self, places: np.ndarray) -> np.ndarray:
        i, out = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for level in range(self.bits):
            bit = (self.planes[level][i // 8] >> (7 - i % 8).astype(np.uint8)) & 1
            ones = self._rank1(level, i)
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
            out = out << 1 | bit
        return out

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(self.bits):
            a, b = self._rank1(level, np.array([lo, hi]))
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return int(lo), int(hi)

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token before place `end`."""
        lo, hi = self._interval(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) ones or zeros of a plane: a search in the block counts, and a look into one block each."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * BLOCK - self.ones[level]
        block = np.searchsorted(before, nth, side="right") - 1
        width = BLOCK // 8
        bits = np.unpackbits(self.planes[level][block[:, None] * width + np.arange(width)], axis=1) == bit
        return block * BLOCK + np.argmax(np.cumsum(bits, 1) > (nth - before[block])[:, None], 1)

    def locate(self, token: int) -> np.ndarray:
        """All places of the token: its interval at the lowest plane, followed up by select."""
        i = np.arange(*self._interval(token, self.n))
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] * one)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(x)
            up[~bit] = x[: self.zeros[level]]
            up[bit] = x[self.zeros[level] :] | x.dtype.type(1 << (self.bits - 1 - level))
            x = up
        return x


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Encodes every text, appends end_id and writes shard files in ascending id order; returns their folder."""
    spark = docs.sparkSession
    model = _bpe.load(tokenizer_path)
    shared = spark.sparkContext.broadcast((_bpe.Merges(model["model"]), {x["content"]: x["id"] for x in model["added_tokens"]}))
    path = path or new_path(spark, "tokens")
    bits = max(1, max([*model["model"]["vocab"].values(), *(x["id"] for x in model["added_tokens"]), end_id]).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, special = shared.value

        def merge(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
            return merges.apply(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))

        table, part, held = _bpe.PieceTable(merge), 0, []
        shard = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            names, sizes = pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held])
            row = [shard, part, names.fill_null(0).to_numpy().tobytes(), names.null_count, sizes.astype(np.int64).tobytes(), len(ids), WaveletMatrix.build(ids, bits).to_bytes()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["shard", "part", "doc_ids", "without_id", "doc_sizes", "n_tokens", "planes"])

        for piece, _ in slices(batches, "t"):
            ids, counts = _bpe.encode_texts(piece.column("t").to_pylist(), table, special)
            ids = np.insert(ids, np.cumsum(counts), end_id)
            held.append((ids, piece.column("id"), counts + 1))
            if sum(len(x[0]) for x in held) >= shard_tokens:
                yield out()
                part, held = part + 1, []
        if held:
            yield out()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "t").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, part, nth, doc_id, first, n_tokens, ids): each document's ids as unsigned 32-bit integers, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["planes"]).tokens().astype("<u4")
                names, sizes = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["doc_sizes"], np.int64)
                end = np.cumsum(sizes)
                step = 2048
                for i in range(0, len(names), step):
                    j = min(len(names), i + step)
                    n = j - i
                    raw = [ids[b - s : b].tobytes() for b, s in zip(end[i:j], sizes[i:j], strict=True)]
                    name = pa.array(names[i:j], mask=np.arange(i, j) < row["without_id"])
                    yield pa.record_batch([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["part"]] * n, pa.int32()), name, pa.array(end[i:j] - sizes[i:j]), pa.array(sizes[i:j]), pa.array(raw, pa.binary())], ["shard", "part", "doc_id", "first", "n_tokens", "ids"])

    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return files.mapInArrow(run, "shard int, part int, doc_id bigint, first bigint, n_tokens bigint, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, part, base): ids in all files before this one; one row a file."""
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(SHARD_SCHEMA).parquet(path).select("shard", "part", "n_tokens")
    return files.select("shard", "part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all read back from the files."""
    spark = docs.sparkSession
    path = write_shards(docs, tokenizer_path)
    ids = read_shards(spark, path).select("shard", "part", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return ids.join(shard_starts(spark, path), ["shard", "part"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
