import random

import pytest

from corpusloom.llm import ngram_join
from corpusloom.llm._components import components


def brute(rows, width, percent):
    sets = []
    for i, t in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append(frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "w%d" % int(r.paretovariate(0.6) % 5000)
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([8, 12, 40, 100, 200]))]
        for _ in range(r.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = word().upper()
            if r.random() < 0.2:
                w = w[: -r.randint(1, 5)]
            rows.append(" ".join(w))
    rows += [None, "", " \n", "a b", "A B", "a b c", "one"]
    r.shuffle(rows)
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "t") for i, t in rows], "doc_id long, text string, n int, token string").repartition(3)


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (3, 5, 80)])
def test_components_match_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    got = sorted(map(tuple, ngram_join.link(frame(spark, rows), width, percent).collect()))
    assert got == brute(rows, width, percent)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(120)] = "x%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, ngram_join.link(frame(spark, rows), 3, 90).collect())) == brute(rows, 3, 90)


def test_edges_and_keep_one(spark):
    assert ngram_join.link(frame(spark, [])).collect() == []
    df = spark.createDataFrame([(5, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.link(df).collect()), key=str)
    assert got == sorted([(5, 2, 3), (None, 2, 3), (5, 2, 3), (3, 2, 3), (9, 0, 9)], key=str)
    kept = ngram_join.keep_one(df)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 9] and kept.columns == df.columns


def test_components_of_a_path(spark):
    n = 40
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    links = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(100, 101), (102, 102)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100}
    assert components(links.limit(0)).collect() == []


def test_clashing_names_long_texts_and_words_made_to_collide(spark):
    r = random.Random(5)
    long = ["x%d" % r.randrange(10**6) for _ in range(20000)]
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, " ".join(long), 0, 0), (2, " ".join(long[:19900]), 0, 0), (3, a, 0, 0), (4, b, 0, 0), (5, " ".join(long[:9000]), 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, _gone_id int")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [1, 3, 4, 5]
