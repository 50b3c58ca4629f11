import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import _repeats, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """doc_id -> (words, mask of words in windows that start earlier elsewhere)."""
    texts = {}
    for i, t in rows:
        texts[i] = WORD.findall(t or "")
    first, out = {}, {}
    for i in sorted(texts):
        w = texts[i]
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in first:
                gone[s : s + length] = [True] * length
            else:
                first[key] = i, s
        out[i] = w, gone
    return out


def corpus(seed, n=60, length=20):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(12)] + ["é", "ü"]
    passages = [[r.choice(vocab) for _ in range(r.randint(length - 2, length + 15))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(0, 30))]
        rows.append((i * 7 % n, " ".join(words) if r.random() < 0.7 else "\n".join(words)))
    rows += [(n, rows[0][1]), (n + 1, "a " * 300), (n + 2, "b a " * 100), (n + 3, None), (n + 4, ""), (n + 5, " ".join("z%d" % j for j in range(length)) * 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, id int").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_matches_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(frame(spark, rows)).collect()}
    want = {i: (len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for i, (w, g) in brute(rows, 20).items()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_matches_brute_force(spark, seed):
    rows = corpus(seed, length=50)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.repeats(frame(spark, rows)).collect()}
    want = {}
    for i, (w, g) in brute(rows, 50).items():
        step = np.diff(np.concatenate([[0], np.array(g, np.int8), [0]]))
        if any(g):
            want[i] = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
    assert got == want


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
@pytest.mark.parametrize("patch", [{"HOT_COUNT": 2}, {"REMEMBERED": 1}, {"INDEXED": 5}])
def test_hot_anchors_and_small_memory_change_nothing(spark, monkeypatch, module, patch):
    n = 20 if module is substring_dedup else 50
    rows = corpus(3, length=n)
    for k, v in patch.items():
        monkeypatch.setattr(_repeats, k, v)
    df = frame(spark, rows)
    found = _repeats.find(df, n, module.GRAM, module.shard)
    got = {r.id: _repeats.covered([s.asDict() for s in r.spans], 2000) for r in found.collect()}
    for i, (w, g) in brute(rows, n).items():
        assert (got[i][: len(w)] if i in got else np.zeros(len(w), bool)).tolist() == g


def test_rows_of_one_id_and_without_id(spark):
    t = " ".join("q%d" % i for i in range(25))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digests(df).collect()), key=str)
    assert got == [(1, 25, 0), (1, 25, 0), (2, 25, 25), (None, 25, 0)]
    assert [r.doc_id for r in suffix_dedup.report(df, 20).collect()] == [2]
    empty = df.limit(0)
    assert substring_dedup.digests(empty).collect() == [] and suffix_dedup.report(empty).collect() == []


def test_rank_of_the_wavelet_matrix():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 30, 400)
    sizes = np.full(20, 20)
    index = substring_dedup.FMIndex(words, sizes, 20)
    text = np.concatenate([np.append(words[i * 20 : i * 20 + 20], 0) for i in range(20)])
    bwt = text[index.sa - 1]
    c, i = rng.integers(1, 30, 50), rng.integers(0, index.n + 1, 50)
    assert index.rank(c, i).tolist() == [int((bwt[:b] == a).sum()) for a, b in zip(c, i)]


def test_words_made_to_collide(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(i, " ".join("w%d" % j for j in range(49)) + " " + x) for i, x in enumerate((a, b))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.digests(frame(spark, [(i, " ".join(t.split()[30:])) for i, t in rows])).collect()}
    assert got == {0: 0, 1: 0}
    assert suffix_dedup.report(frame(spark, rows)).collect() == []


def test_long_texts(spark):
    r = random.Random(3)
    words = ["x%d" % r.randrange(10**6) for _ in range(20000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[5000:12000] + ["new"] + words[:60]))]
    got = {x.doc_id: x.n_removed for x in substring_dedup.digests(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 7060}
    assert [(x.doc_id, x.n_removed) for x in suffix_dedup.report(frame(spark, rows)).collect()] == [(2, 7060)]
