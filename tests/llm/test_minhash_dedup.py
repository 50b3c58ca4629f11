import random

import numpy as np
import pytest
from test_ngram_join import brute, corpus, frame

from corpusloom.llm import minhash_dedup


def plain(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (4, 5, 85)])
def test_components_match_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    assert plain(minhash_dedup.link(frame(spark, rows), width, percent)) == brute(rows, width, percent)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(150)] = "x%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    assert plain(minhash_dedup.link(frame(spark, rows), 5, 85)) == brute(rows, 5, 85)


@pytest.mark.parametrize("n", [1, 7, 300])
def test_every_coordinate_fills_and_agrees_as_often_as_the_similarity(n):
    tokens = np.random.default_rng(n).integers(0, 1 << 63, 3 * n, dtype=np.uint64)
    found = []
    for key in range(40):
        s = minhash_dedup.sketches(np.repeat([0, 1], 2 * n), np.concatenate([tokens[: 2 * n], tokens[n:]]), 2, key)
        assert (s != np.iinfo(np.uint64).max).all()
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - 1 / 3) < 0.03


def test_edges_and_keep_one(spark):
    schema = "doc_id long, text string, Kept string, token int, component_id int"
    long = " ".join("w%d" % i for i in range(3000))
    rows = [(4, "A b c d e f", "x", 1, 1), (2, "a B c d e f", "y", 1, 1), (4, "z", "x", 1, 1), (None, "z", "n", 1, 1), (5, None, "x", 1, 1), (6, "", "x", 1, 1), (7, " \n", "x", 1, 1), (8, long, "x", 1, 1), (9, long + " tail", "x", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(str, map(tuple, minhash_dedup.link(docs).collect())))
    want = [(2, 2, 2, True), (4, 2, 2, False), (4, 1, 2, False), (None, 1, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 2996, 8, True), (9, 2997, 8, False)]
    assert got == sorted(map(str, want))
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "6", "7", "8", "None"]
    empty = minhash_dedup.link(docs.limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0
