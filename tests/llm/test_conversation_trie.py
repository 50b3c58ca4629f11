import hashlib
import random
import zlib

import pytest

from corpusloom.llm import conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    return {c: [x[-1] for x in sorted(v, key=lambda x: (*x[:2], signed(x[2])))] for c, v in found.items()}


def signed(digest):
    return [int.from_bytes(bytes.fromhex(digest[i : i + 16]), "big", signed=True) for i in (0, 16)]


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c > 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in nodes:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, who in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(who) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, who in nodes.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(path))
        out.append((min(who), len(path), min(nodes[path[:-1]]) if path else None, len(who), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some(seed, n=60, longest=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 450), n) + [0, 100, 200]:
        for t in range(r.choice([1, 2, 3, longest])):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "user", None]), r.choice(["a", "bb", "ccc ü", "", None]) if r.random() < 0.9 else str(r.random())))
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, pos int, k1 int").repartition(3)


def plain(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_conversations_match_brute_force(spark, seed):
    rows = some(seed)
    assert plain(conversation_trie.of_shared_openings(frame(spark, rows))) == brute(rebuilt(in_order(rows)))


def test_segments_and_small_shards_match_brute_force(spark):
    rows = some(3, 80, 14)
    rows += [(c, t, "user", "x%d" % (t % 3)) for c in (500, 501, 502, 7000) for t in range(40 if c < 502 else 37)]
    turns = conversation_trie.numbered(conversation_trie.slim(frame(spark, rows)))
    got = conversation_trie.trie(turns, turns.where("pos = 0").select("conv"), segment=4, shard=5)
    assert plain(got) == brute(in_order(rows))


def test_a_long_conversation_over_several_ranges(spark):
    rows = [(5, t, "user", str(t)) for t in range(3000)] + [(6, t, "user", str(t)) for t in range(2500)] + [(7, 0, None, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = plain(conversation_trie.of_turns(frame(spark, rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3002 and max(x[1] for x in got) == 3000
    top = next(x for x in got if x[1] == 0)
    assert top[:7] == (5, 0, None, 3, 2, 2, sum(len(str(t)) for t in range(2500)))


def test_turnless_nulls_and_empty_table(spark):
    # conversation 1 keeps nothing of its own where its first turns are replaced and there is no conversation 0
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(c, None, None, None), (None, 1, "user", "x")]
    assert plain(conversation_trie.of_shared_openings(frame(spark, rows))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert plain(conversation_trie.of_shared_openings(frame(spark, []))) == []
