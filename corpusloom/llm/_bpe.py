"""Byte-level BPE of whole Arrow slices: vectorised splitting, and one lookup for each different piece.

The split is that of the public byte-level pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ .
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex

from ._words import U64, keyed_hash, new_key

#: The white space of the pattern, and the contractions behind an apostrophe.
_SPACE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT = ("s", "t", "m", "d")
_LONG = ("re", "ve", "ll")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The class of every code point."""
    global _kinds
    if _kinds is None:
        points = np.delete(np.arange(0x110000), np.arange(0xD800, 0xE000))
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                out[points[m.start() : m.end()]] = kind
        out[_SPACE] = SPACE
        _kinds = out
    return _kinds


def split(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces of code points; `first` are starts of texts, none of them empty."""
    n = len(points)
    kind = kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    text_edge = edge.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    # white space before a visible run: its last character stands alone, or joins the run if it is a blank
    space = kind == SPACE
    run = np.flatnonzero(edge[:n] & ~space)
    before = run[(run > 0)] - 1
    before = before[space[before] & ~text_edge[before + 1]]
    edge[before] = True
    edge[before[points[before] == 0x20] + 1] = False
    # contractions: an apostrophe that starts a piece, with letters behind it
    mark = np.flatnonzero((points == 0x27) & edge[:n])
    if len(mark):
        room = mark[mark + 1 < n]
        room = room[~text_edge[room + 1]]
        one = points[room + 1]
        for s in _SHORT:
            hit = room[one == ord(s)]
            edge[hit + 1] = False
            edge[hit + 2] = True
        two = room[room + 2 < n]
        two = two[~text_edge[two + 2]]
        for s in _LONG:
            hit = two[(points[two + 1] == ord(s[0])) & (points[two + 2] == ord(s[1]))]
            edge[hit + 1] = False
            edge[hit + 3] = True
    return np.flatnonzero(edge[:n])


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


#: Bytes of a piece beyond which it is merged with a heap.
LONG = 512


class Merges:
    """The merge table as arrays; merges many pieces at once."""

    def __init__(self, model: dict):
        vocab, letters = model["vocab"], byte_letters()
        self.byte_id = np.array([vocab[x] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.lookup: dict[int, int] | None = None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.key))

    def apply(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts for pieces of `sizes` bytes (at least 1) laid end to end in data.

        Short pieces are merged together in rounds, pieces of over LONG bytes one by one with a heap of their pairs.
        """
        long = sizes > LONG
        if not long.any():
            return self.rounds(data, sizes)
        ends = np.cumsum(sizes)
        ids, counts = self.rounds(data[np.repeat(~long, sizes)], sizes[~long])
        parts, sizes_out = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [], np.zeros(len(sizes), np.int64)
        parts, out = iter(parts), []
        for i, is_long in enumerate(long.tolist()):
            out.append(self.one(data[ends[i] - sizes[i] : ends[i]]) if is_long else next(parts))
            sizes_out[i] = len(out[-1])
        return np.concatenate(out), sizes_out

    def one(self, data: np.ndarray) -> np.ndarray:
        """Ids of one piece: its pairs of least rank are merged first, the leftmost of equals, in n log n steps."""
        if self.lookup is None:
            self.lookup = dict(zip(self.key.tolist(), self.rank.tolist(), strict=True))
        lookup, made = self.lookup, self.made
        ids, n = self.byte_id[data].tolist(), len(data)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := lookup.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i]
            # a pair that has changed since: one of its sides was merged away or grew
            if ids[i] < 0 or j >= n or lookup.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = int(made[rank]), -1
            nxt[i] = after = nxt[j]
            if after < n:
                prev[after] = i
                if (r := lookup.get(ids[i] << 32 | ids[after])) is not None:
                    heapq.heappush(heap, (r, i))
            if (before := prev[i]) >= 0 and (r := lookup.get(ids[before] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, before))
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def rounds(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts, as `apply`.

        Each round merges in every piece its pair of least rank (the leftmost of equals) until no piece has a pair.
        """
        none = len(self.key)
        ids, n = self.byte_id[data], len(data)
        ends = np.cumsum(sizes)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        rank = np.full(n, none, np.int64)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        alive = np.ones(n, bool)
        starts, lens = ends - sizes, sizes
        while len(starts):
            # the pair of each piece still at work, over its original bytes
            total = np.cumsum(lens)
            flat = np.arange(total[-1]) + np.repeat(starts - (total - lens), lens)
            best = np.minimum.reduceat(rank[flat], total - lens)
            busy = best < none
            if not busy.any():
                break
            is_best = rank[flat] == np.repeat(best, lens)
            place = np.flatnonzero(is_best)
            owner = np.searchsorted(total, place, side="right")
            lead = np.concatenate([[True], owner[1:] != owner[:-1]])
            place, owner = place[lead], owner[lead]
            left = flat[place[busy[owner]]]
            right = nxt[left]
            ids[left] = self.made[rank[left]]
            alive[right] = False
            after = nxt[right]
            nxt[left] = after
            has_after = ~last[right]
            last[left] = last[right]
            rank[right] = none
            rank[left] = none
            l2, a2 = left[has_after], after[has_after]
            prev[a2] = l2
            rank[l2] = self.ranks(ids[l2], ids[a2])
            starts, lens = starts[busy], lens[busy]
            first = ~np.isin(left, starts, assume_unique=True)
            l3 = left[first]
            p3 = prev[l3]
            rank[p3] = self.ranks(ids[p3], ids[l3])
        counts = np.add.reduceat(alive.astype(np.int64), ends - sizes) if len(sizes) else np.zeros(0, np.int64)
        return ids[alive], counts


class PieceTable:
    """Ids of the pieces seen so far in this Python worker, at most `most` of them; `encode` gives those of new ones.

    Pieces are told apart by a 64-bit hash with a random key of this table's own. Pieces of up to two characters never
    collide, and others not by design.
    """

    def __init__(self, encode, most: int = 1 << 20):
        self.encode, self.most, self.key = encode, most, new_key()
        self.clear()

    def clear(self) -> None:
        self.keys, self.first = np.zeros(0, U64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.place = np.zeros(0, np.int64)

    def look_up(self, keys: np.ndarray, texts) -> np.ndarray:
        """Rows of the sorted, different keys; texts(missing) gives the pieces of those that are new."""
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            ids, counts = self.encode(texts(new))
            base = len(self.first) - 1
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.place = np.insert(self.place, at[new], base + np.arange(len(new)))
            at = np.searchsorted(self.keys, keys)
        return self.place[at]


def encode_texts(texts: list[str], table: PieceTable, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts laid end to end, and the number of each text's ids. Strings of special tokens become their ids."""
    parts, owner, marks = [], [], []
    if special:
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
    for i, t in enumerate(texts):
        if not t:
            continue
        if special and any(s in t for s in special):
            at = 0
            for m in cut.finditer(t):
                if m.start() > at:
                    parts.append(t[at : m.start()])
                    owner.append(i)
                marks.append((len(parts), i, special[m[0]]))
                at = m.end()
            if at < len(t):
                parts.append(t[at:])
                owner.append(i)
        else:
            parts.append(t)
            owner.append(i)
    counts = np.zeros(len(texts), np.int64)
    ids, part_counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if parts:
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(sizes) - sizes
        start = split(points, first)
        end = np.append(start[1:], len(points))
        key = keyed_hash(points.view(np.uint8), start * 4, end * 4, table.key)
        keys, some, back = np.unique(key, return_index=True, return_inverse=True)
        rows = table.look_up(keys, lambda new: [joined[a:b] for a, b in zip(start[some[new]].tolist(), end[some[new]].tolist(), strict=True)])[back]
        begin, n = table.first[rows], table.first[rows + 1] - table.first[rows]
        total = np.cumsum(n)
        ids = table.ids[np.arange(total[-1]) + np.repeat(begin - (total - n), n)]
        part_counts = np.add.reduceat(n, np.searchsorted(start, first))
        np.add.at(counts, owner, part_counts)
    if marks:
        where = np.concatenate([[0], np.cumsum(part_counts)])
        ids = np.insert(ids, [where[p] for p, _, _ in marks], [x for _, _, x in marks])
        np.add.at(counts, [i for _, i, _ in marks], 1)
    return ids, counts
