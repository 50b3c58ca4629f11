"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of the first d turns (role and text) of some conversation; its members are the
conversations that begin with it. Conversations are split by ranges of their ids into shards of at most SHARD
conversations. In a shard each (position, turn) has a bitset of the conversations that hold it. Depth first, a node's
bitset is intersected with the postings of its members' next turns: each intersection is a child, popcounts give its
members and leaves, and the conversations that end there are its end list. A child of one conversation is a chain and
needs no bitset.

Shards are merged by node keys of 128 bits, the exclusive or of keyed hashes of (position, turn), so that a shared
beginning costs one row a shard and node. A first pass finds the smallest member of every node. That member owns it,
and what a conversation owns is a run of depths up to its end; so for each conversation the depth from which it owns
tells which of its turns are repeats of an earlier one's. A second pass counts with that: tokens saved below a node are
the sizes of its members' turns that they don't own, leaves are members that own a childless end.

Conversations are cut into segments of SEGMENT positions, with the key and size of what comes before in a header row;
so one conversation with a third of all turns is spread over tasks as well. End lists of a node are hashed in id order
as they stream by; they are never gathered.

Null roles and texts are empty; rows without a conv_id are left out. Turns are ordered by number, null first, repeated
numbers by the SHA-256 of role and text. An empty table has no nodes. Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import discard, written
from ._words import new_key

#: Conversations and rows of a shard, positions of a segment, and chunks of end lists in an Arrow batch.
SHARD, SHARD_ROWS, SEGMENT = 2048, 1 << 17, 1024
CHUNKS = 256


def slim(convs: DataFrame) -> DataFrame:
    """(conv, turn, h1, h2, size): a turn's content as 128 bits of its SHA-256, and its text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = convs.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("h"), F.char_length(text).cast("bigint").alias("size"))
    half = lambda at: F.conv(F.substring("h", at, 16), 16, -10).cast("bigint")
    return rows.select("conv", "turn", half(1).alias("h1"), half(17).alias("h2"), "size")


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, pos, h1, h2, size): rows in order, with their place in the conversation from 0.

    Rows are sorted over ranges and counted; the only thing that ranges share is how many rows the conversation at a
    range's start already has: one number a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, have = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            pos = np.where(start < 0, have + np.arange(len(conv)), np.arange(len(conv)) - start)
            last, have = conv[-1], int(pos[-1]) + 1
            yield pa.record_batch([batch.column("conv"), pa.array(pos), batch.column("h1"), batch.column("h2"), batch.column("size"), pa.array(np.full(len(conv), part, np.int32))], ["conv", "pos", "h1", "h2", "size", "part"])

    order = ["conv", "turn", "h1", "h2"]
    out = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv bigint, pos bigint, h1 bigint, h2 bigint, size bigint, part int"), "turns")
    ends = out.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos")).alias("last")).orderBy("part").toLocalIterator()
    before, carried = [], (None, 0)
    for r in ends:
        more = carried[1] if r["first"] == carried[0] else 0
        if more:
            before.append((r["part"], r["first"], more))
        carried = (r["last"]["conv"], r["last"]["pos"] + 1 + (more if r["first"] == r["last"]["conv"] else 0))
    if not before:
        return out.drop("part")
    shift = F.broadcast(out.sparkSession.createDataFrame(before, "part int, conv bigint, more bigint"))  # a row a range at most
    return out.join(shift, ["part", "conv"], "left").select("conv", (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), "h1", "h2", "size")


def shared_openings(rows: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """numbered rows, rebuilt, and the ids: a conversation c begins with the first h turns of conversation c - c % block and goes on with its own after its first h; h = crc32(c) % most."""
    base, h = F.col("conv") - F.col("conv") % block, F.crc32(F.col("conv").cast("string").cast("binary")) % most
    ids = rows.where("pos = 0").select("conv")
    turns = F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "size")))
    opening = rows.where((F.col("conv") == base) & (F.col("pos") < most - 1)).groupBy(F.col("conv").alias("base")).agg(turns.alias("o"))  # most - 1 turns at most
    first = ids.withColumn("base", base).join(opening, "base").select("conv", F.explode(F.filter("o", lambda x: x["pos"] < h)).alias("x")).select("conv", "x.*")
    own = rows.where(F.col("pos") >= h).withColumn("base", base).join(opening.select("base", F.size("o").alias("many")), "base", "left")
    own = own.select("conv", (F.col("pos") - h + F.least(h, F.coalesce("many", F.lit(0)))).alias("pos"), "h1", "h2", "size")
    return first.unionByName(own), ids


def headers(rows: DataFrame, ids: DataFrame, segment: int) -> DataFrame:
    """(conv, segment, k1, k2, before, total): the key and size of what comes before each segment; total is null for conversations of one segment."""
    one = ids.select("conv", F.lit(0).cast("bigint").alias("segment"), *(F.lit(0).cast("bigint").alias(c) for c in ("k1", "k2", "before")), F.lit(None).cast("bigint").alias("total"))
    long = rows.where(F.col("pos") == segment).select("conv")
    parts = rows.join(long, "conv", "left_semi").groupBy("conv", "segment").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("size").alias("size"))
    # a struct for each segment of a long conversation
    all_ = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "k1", "k2", "size"))).alias("s"))
    zero = F.lit(0).cast("bigint")
    size_before = lambda i: F.aggregate(F.slice("s", 1, i), zero, lambda a, x: a + x["size"])
    key_before = lambda i, k: F.aggregate(F.slice("s", 1, i), zero, lambda a, x: a.bitwiseXOR(x[k]))
    at = all_.select("conv", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("i"))
    many = at.select("conv", F.col("i").cast("bigint").alias("segment"), key_before(F.col("i"), "k1").alias("k1"), key_before(F.col("i"), "k2").alias("k2"), size_before(F.col("i")).alias("before"), size_before(F.size("s")).alias("total"))
    return one.join(long, "conv", "left_anti").unionByName(many)


class Shard:
    """Some conversations of one segment, in id order: `at` has their rows' bounds, `key` and `sum` what each prefix has."""

    def __init__(self, depth0: int, head: dict[str, np.ndarray], rows: dict[str, np.ndarray], at: np.ndarray):
        self.depth0, self.head, self.at = depth0, head, at
        self.conv, self.size = head["conv"], rows["size"]
        counts = np.diff(at)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.local = np.arange(len(self.owner)) - at[self.owner]
        # prefix keys and sizes within each conversation, on top of its header's
        self.keys = []
        for k in ("k1", "k2"):
            run = np.concatenate([[0], np.bitwise_xor.accumulate(rows[k])]) if len(rows[k]) else np.zeros(1, np.int64)
            self.keys.append(run[1:] ^ (run[at[:-1]] ^ head[k])[self.owner])
        total = np.concatenate([[0], np.cumsum(self.size)])
        self.sum = total[1:] - (total[at[:-1]] - head["before"])[self.owner]
        # postings: (position, turn) to conversations
        order = np.lexsort((self.owner, rows["k2"], rows["k1"], self.local))
        a, b, p = rows["k1"][order], rows["k2"][order], self.local[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])
        number = np.cumsum(new) - 1
        self.posting = np.empty(len(order), np.int64)
        self.posting[order] = number
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(order)))
        self.bits = {int(number[s]): bitset(self.owner[order[s : s + n]].tolist()) for s, n in zip(first[many > 1].tolist(), many[many > 1].tolist(), strict=True)}
        ends: dict[int, list[int]] = {}
        for i, n in enumerate(counts.tolist()):
            ends.setdefault(n, []).append(i)
        self.ended = {n: bitset(x) for n, x in ends.items()}

    def roots(self) -> list[int]:
        """Bitsets of the conversations with one and the same prefix before the segment."""
        found: dict[tuple[int, int], list[int]] = {}
        for i, k in enumerate(zip(self.head["k1"].tolist(), self.head["k2"].tolist(), strict=True)):
            found.setdefault(k, []).append(i)
        return [bitset(x) for x in found.values()]

    def walk(self) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]], list[int]]:
        """Depth first: nodes (first member, local depth, bitset, parent node) of several members, chains (member, local depth, parent node) of one, and the roots' bitsets."""
        nodes, chains, roots = [], [], self.roots()
        at, posting, bits = self.at.tolist(), self.posting.tolist(), self.bits
        stack = [(x, 0, -1 - r) for r, x in enumerate(roots)]
        while stack:
            have, depth, parent = stack.pop()
            rest = have & ~self.ended.get(depth, 0)
            while rest:
                i = lowest(rest)
                got = bits.get(posting[at[i] + depth], 0) & rest
                if got.bit_count() > 1:
                    nodes.append((i, depth, got, parent))
                    stack.append((got, depth + 1, len(nodes) - 1))
                    rest &= ~got
                else:
                    chains.append((i, depth, parent))
                    rest &= rest - 1
        return nodes, chains, roots


def bitset(members: list[int]) -> int:
    out = bytearray((members[-1] >> 3) + 1)
    for i in members:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def shards(batches: Iterator[pa.RecordBatch], columns: list[str], width: int, most: int) -> Iterator[Shard]:
    """Shards of at most `most` conversations, of rows sorted by segment (`width` positions), conversation and position, a header (position -1) before each conversation's."""
    want, waiting, rows = ["conv", "segment", "pos", *columns], [], 0

    def cut(data: dict[str, np.ndarray]) -> Iterator[Shard]:
        heads = np.flatnonzero(data["pos"] < 0)
        segment = data["segment"][heads]
        i = 0
        while i < len(heads):
            j = min(i + most, int(np.searchsorted(segment, segment[i], side="right")))
            end = heads[j] if j < len(heads) else len(data["pos"])
            span = slice(heads[i], end)
            is_head = data["pos"][span] < 0
            at = np.append(heads[i:j] - heads[i], end - heads[i]) - np.arange(j - i + 1)
            yield Shard(int(segment[i]) * width, {c: data[c][span][is_head] for c in want}, {c: data[c][span][~is_head] for c in want}, at)
            i = j

    def together(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([p[c] for p in parts]) for c in want}

    for batch in batches:
        waiting.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in want})
        rows += len(batch)
        if rows >= SHARD_ROWS:
            data = together(waiting)
            heads = np.flatnonzero(data["pos"] < 0)
            last = heads[-1] if len(heads) else 0  # the last conversation may go on
            if last:
                yield from cut({c: v[:last] for c, v in data.items()})
                data = {c: v[last:] for c, v in data.items()}
            waiting, rows = [data], len(data["pos"])
    if rows:
        yield from cut(together(waiting))


def members(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """First pass: (k1, k2, p1, p2, depth, before, conv) of every node of a shard, conv its smallest member there."""
    for s in shards(batches, ["k1", "k2", "size", "before"], width, most):
        nodes, chains, roots = s.walk()
        at = s.at.tolist()
        parts = [np.array([at[i] + d for i, d, _, _ in nodes], np.int64)]
        parts += [np.arange(at[i] + d, at[i + 1]) for i, d, _ in chains]
        row = np.concatenate(parts)
        k1, k2, p1, p2, before = prefixes_of(s, row)
        depth, conv = s.depth0 + s.local[row] + 1, s.conv[s.owner[row]]
        if not s.depth0:
            zero = np.zeros(1, np.int64)
            k1, k2, p1, p2, before, depth = (np.concatenate([zero, x]) for x in (k1, k2, p1, p2, before, depth))
            conv = np.concatenate([[s.conv[lowest(roots[0])]], conv])
        yield pa.record_batch([pa.array(x) for x in (k1, k2, p1, p2, depth, before, conv)], ["k1", "k2", "p1", "p2", "depth", "before", "conv"])


def prefixes_of(s: Shard, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the prefixes that end with each row, keys of those that end before it, and the latter's size."""
    owner, start = s.owner[row], s.local[row] == 0
    parent = [np.where(start, s.head[k][owner], s.keys[j][row - ~start]) for j, k in enumerate(("k1", "k2"))]
    return s.keys[0][row], s.keys[1][row], *parent, s.sum[row] - s.size[row]


COUNTED = ["k1", "k2", "depth", "conv", "n", "children", "leaves", "saved", "parent_conv", "first_end", "ends"]
COUNTED_TYPES = "k1 bigint, k2 bigint, depth bigint, conv bigint, n bigint, children bigint, leaves bigint, saved bigint, parent_conv bigint, first_end bigint, ends string"


def counted(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """Second pass: COUNTED of every node of a shard. What only a node's owner knows (its parent's owner, the child that it owns too) is left to the owner's shard."""
    for s in shards(batches, ["k1", "k2", "size", "before", "total", "own", "owned_before", "leaf", "parent_conv", "more"], width, most):
        nodes, chains, roots = s.walk()
        at, head = s.at.tolist(), s.head
        last = np.where(np.diff(s.at) > 0, np.concatenate([s.sum, [0]])[s.at[1:] - 1], head["before"])
        # depth from which each conversation owns nodes, and the size of what comes before
        nothing = head["own"] < 0
        own = np.where(nothing, np.iinfo(np.int64).max, head["own"])
        repeated = np.where(nothing, np.where(head["total"] < 0, last, head["total"]), head["owned_before"])
        beyond = np.where(head["more"] != 0, np.maximum(repeated - last, 0), 0)  # repeated turns of later segments
        leaves = bitset(x) if (x := np.flatnonzero(head["leaf"]).tolist()) else 0
        goes_on = bitset(x) if (x := np.flatnonzero(head["more"]).tolist()) else 0
        by_depth: dict[int, int] = {}

        def repeats(depth: int) -> int:
            """The conversations that don't own their node at the depth."""
            if depth not in by_depth:
                x = np.flatnonzero(own > depth).tolist()
                by_depth[depth] = bitset(x) if x else 0
            return by_depth[depth]

        many, below, root_saved = len(nodes), np.zeros(len(nodes), np.int64), np.zeros(len(roots), np.int64)
        ends: list[int] = []

        def add(parent: int, value: int) -> None:
            if parent >= 0:
                below[parent] += value
            else:
                root_saved[-1 - parent] += value

        def finish(have: int, depth: int) -> tuple[int, int]:
            """The members that end with a node, and what those that go on in a later segment repeat there."""
            stop = have & s.ended.get(depth, 0)
            on, value = stop & goes_on, 0
            while on:
                value += int(beyond[lowest(on)])
                on &= on - 1
            return stop & ~goes_on, value

        for i, d, parent in chains:
            # its own repeated turns from here on
            add(parent, max(0, int(repeated[i]) - int(head["before"][i] if not d else s.sum[at[i] + d - 1])) if own[i] > s.depth0 + d + 1 else 0)
        for j in range(many - 1, -1, -1):
            i, d, have, parent = nodes[j]
            stop, value = finish(have, d + 1)
            ends.append(stop)
            below[j] += value + (have & repeats(s.depth0 + d + 1)).bit_count() * int(s.size[at[i] + d])
            add(parent, int(below[j]))
        ends.reverse()

        node_row = np.array([at[i] + d for i, d, _, _ in nodes], np.int64)
        spans = [np.arange(at[i] + d, at[i + 1]) for i, d, _ in chains]
        row = np.concatenate([node_row, *spans])
        k1, k2, _, _, before = prefixes_of(s, row)
        who, depth = s.owner[row], s.depth0 + s.local[row] + 1
        n = np.concatenate([np.array([x.bit_count() for _, _, x, _ in nodes], np.int64), np.ones(len(row) - many, np.int64)])
        n_leaves = np.concatenate([np.array([(x & leaves).bit_count() for _, _, x, _ in nodes], np.int64), head["leaf"][who[many:]].astype(np.int64)])
        saved = np.concatenate([below, np.where(own[who[many:]] > depth[many:], np.maximum(repeated[who[many:]] - before[many:], 0), 0)])
        at_end = (row + 1 == s.at[who + 1]) & (head["more"][who] == 0)
        owns = own[who] <= depth
        children = (owns & ~at_end).astype(np.int64)
        parent_conv = np.where(owns, np.where(own[who] < depth, s.conv[who], head["parent_conv"][who]), 0)
        no_parent = ~owns
        first_end, end_list = np.zeros(len(row), np.int64), [None] * len(row)
        for j, stop in enumerate(ends):
            if stop:
                first_end[j], end_list[j] = chunk(s, stop)
        for j in (np.flatnonzero(at_end[many:]) + many).tolist():
            first_end[j], end_list[j] = int(s.conv[who[j]]), str(s.conv[who[j]])
        columns = [k1, k2, depth, s.conv[who], n, children, n_leaves, saved, parent_conv, first_end]
        if not s.depth0:
            have = roots[0]
            stop, value = finish(have, 0)
            i = lowest(have)
            top = [0, 0, 0, int(s.conv[i]), have.bit_count(), int(own[i] == 0 and (at[i + 1] > at[i] or head["more"][i] != 0)), (have & leaves).bit_count(), int(root_saved[0]) + value, 0, 0]
            if stop:
                top[-1], text = chunk(s, stop)
            columns = [np.concatenate([[x], c]) for x, c in zip(top, columns, strict=True)]
            no_parent = np.concatenate([[True], no_parent])
            end_list = [text if stop else None, *end_list]
        arrays = [pa.array(c.astype(np.int64)) for c in columns]
        arrays[8] = pa.array(columns[8].astype(np.int64), mask=no_parent)
        yield pa.record_batch([*arrays, pa.array(end_list, pa.string())], COUNTED)


def chunk(s: Shard, stop: int) -> tuple[int, str]:
    """The first of the conversations that end with a node, and all, joined."""
    found = []
    while stop:
        found.append(int(s.conv[lowest(stop)]))
        stop &= stop - 1
    return found[0], ",".join(map(str, found))


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, ends_sha256) of chunks sorted by node and first id."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ends")), strict=True):
            if (a, b) != key:
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.record_batch([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
    if state:
        yield pa.record_batch([pa.array([x]) for x in (*key, state.hexdigest())], ["k1", "k2", "ends_sha256"])


def trie(rows: DataFrame, ids: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    rows (conv, pos, h1, h2, size) are the conversations' turns, ids (conv) all conversations, those without turns too.
    """
    salt = F.lit(new_key() - (1 << 63))
    rows = written(rows.select("conv", "pos", F.expr(f"pos div {segment}").alias("segment"), F.xxhash64(salt, "pos", "h1", "h2").alias("k1"), F.xxhash64("h2", "h1", "pos", salt).alias("k2"), "size"), "turns")
    head = written(headers(rows, ids, segment), "headers")

    def dealt(extra: dict[str, Column], head: DataFrame) -> DataFrame:
        """Rows and headers, sorted by segment and conversation over ranges of both."""
        own = ["before", *extra]
        a = rows.select("conv", "segment", "pos", "k1", "k2", "size", *(F.lit(0).cast("bigint").alias(c) for c in own))
        b = head.select("conv", "segment", F.lit(-1).cast("bigint").alias("pos"), "k1", "k2", F.lit(0).cast("bigint").alias("size"), "before", *(c.cast("bigint").alias(k) for k, c in extra.items()))
        both = a.unionByName(b)
        return both.repartitionByRange("segment", "conv").sortWithinPartitions("segment", "conv", "pos")

    seen = dealt({}, head).mapInArrow(lambda b: members(b, segment, shard), "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, before bigint, conv bigint")
    owners = written(seen.groupBy("k1", "k2").agg(F.min("conv").alias("conv"), *(F.min(c).alias(c) for c in ("p1", "p2", "depth", "before"))), "owners")
    first = owners.groupBy("conv").agg(F.min(F.struct("depth", "before", "p1", "p2")).alias("f"), F.max(F.struct("depth", "k1", "k2")).alias("e"))
    first = written(first.select("conv", F.col("f.depth").alias("own"), F.col("f.before").alias("owned_before"), "f.p1", "f.p2", F.col("e.k1").alias("e1"), F.col("e.k2").alias("e2")), "first")
    # conversations that begin to own below a node of another: its owner is their parent, and it is no leaf
    below = first.where("own > 0")
    parents = below.select("conv", F.col("p1").alias("k1"), F.col("p2").alias("k2")).join(owners.select("k1", "k2", F.col("conv").alias("parent_conv")), ["k1", "k2"]).select("conv", "parent_conv")
    inner = below.select(F.col("p1").alias("e1"), F.col("p2").alias("e2")).distinct()
    leaf = first.join(inner, ["e1", "e2"], "left_anti").select("conv", F.lit(1).alias("leaf"))
    known = first.select("conv", "own", "owned_before").join(parents, "conv", "left").join(leaf, "conv", "left")
    more = head.withColumn("next", F.col("segment") - 1).where("next >= 0").select("conv", F.col("next").alias("segment"), F.lit(1).alias("more"))
    full = written(head.join(known, "conv", "left").join(more, ["conv", "segment"], "left"), "headers")
    extra = {"total": F.coalesce("total", F.lit(-1)), "own": F.coalesce("own", F.lit(-1)), "owned_before": F.coalesce("owned_before", F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0)), "parent_conv": F.coalesce("parent_conv", F.lit(0)), "more": F.coalesce("more", F.lit(0))}
    parts = written(dealt(extra, full).mapInArrow(lambda b: counted(b, segment, shard), COUNTED_TYPES), "nodes")
    discard(owners, head, full, rows)

    new_child = below.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), *(F.lit(None).cast("bigint").alias(c) for c in ("depth", "conv", "n")), F.lit(1).cast("bigint").alias("children"), *(F.lit(None).cast("bigint").alias(c) for c in ("leaves", "saved", "parent_conv")))
    sums = parts.select(*new_child.columns).unionByName(new_child).groupBy("k1", "k2").agg(F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    lists = parts.where("ends is not null").select("k1", "k2", "first_end", "ends").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first_end")
    ends = written(lists.mapInArrow(hashed_ends, "k1 bigint, k2 bigint, ends_sha256 string"), "ends", batch_rows=CHUNKS)
    out = sums.join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.drop("k1", "k2")


def of_turns(convs: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    rows = numbered(slim(convs))
    return trie(rows, rows.where("pos = 0").select("conv"))


def of_shared_openings(convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """The trie of conversations rebuilt by `shared_openings`."""
    return trie(*shared_openings(numbered(slim(convs)), block, most))
