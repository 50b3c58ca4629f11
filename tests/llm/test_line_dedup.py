import random
import re

import pytest

from corpusloom.llm import line_dedup


def brute(rows, percent=80, least=1):
    lines = []
    for i, t in rows:
        for j, x in enumerate(t.split("\n") if t is not None else []):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))
            if len(w) >= least and i is not None:
                lines.append((i, j, w))
    lines.sort(key=lambda x: x[:2])
    gone = {}
    for b, (i, j, w) in enumerate(lines):
        if any(100 * len(w & v) >= percent * len(w | v) for _, _, v in lines[:b]):
            gone.setdefault(i, []).append(j)
    return gone


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "w%d" % int(r.paretovariate(0.7) % 3000)
    bases = [[word() for _ in range(r.choice([3, 5, 6, 10, 20, 40]))] for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randint(0, 8)):
            w = list(r.choice(bases)) if r.random() < 0.6 else [word() for _ in range(r.randint(0, 30))]
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = word()
            lines.append(r.choice([" ", "\t"]).join(w) + r.choice(["", " ", "\r"]))
        rows.append((i * 7 % n, "\n".join(lines)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, rows[0][1]), (n + 4, "a b c d e\n" * 30)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "w") for i, t in rows], "doc_id long, text string, id int, k string, line string").repartition(3)


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 80), (5, 60), (6, 70), (7, 90), (8, 51), (9, 100)])
def test_lines_match_brute_force(spark, seed, percent):
    rows = corpus(seed)
    rows += [(1000 + i, x) for i, x in enumerate(("a b c d", "a b c", "a b d", "p q", "p q r", "k l m n o", "k l m n", "k l x n o"))]
    got = {r.id: list(r.lines) for r in line_dedup.find(frame(spark, rows), percent).collect()}
    assert got == brute(rows, percent)


@pytest.mark.parametrize("percent", [51, 60, 67, 70, 75, 80, 90, 95])
def test_prefix_runs_always_meet(percent):
    """Of any two sets that are similar enough, in an order of words, a run of the tier of the smaller is in both prefixes."""
    r = random.Random(percent)
    table = {n: {k: int(x[0]) for k, x in line_dedup.run_sizes(percent, __import__("numpy").array([n]))} for n in range(1, 130)}
    met = 0
    for _ in range(20000):
        both = r.sample(range(1000), r.randint(1, 60))
        a, b = sorted(both + r.sample(range(1000, 2000), r.choice([0, 0, 1, 2, 4, 9]))), sorted(both + r.sample(range(2000, 3000), r.choice([0, 0, 1, 2, 4, 9])))
        key = {w: r.random() for w in {*a, *b}}
        a, b = sorted(a, key=key.get), sorted(b, key=key.get)
        if a != b and 100 * len(both) >= percent * (len(a) + len(b) - len(both)):
            runs = lambda x: {tuple(x[i : i + k]) for k, n in table[len(x)].items() for i in range(n)}  # noqa: B023, E731
            assert runs(a) & runs(b), (a, b)
            met += 1
    assert met > 100


def test_report_and_dedup(spark):
    rows = corpus(4)
    gone = brute(rows)
    n = lambda t: 0 if t is None else len(t.split("\n"))
    want = sorted((i, n(t), len(gone.get(i, [])), ",".join(map(str, gone.get(i, [])))) for i, t in rows)
    assert sorted(map(tuple, line_dedup.report(frame(spark, rows)).collect())) == want
    kept = line_dedup.dedup(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    for r in kept.collect():
        t = dict(rows)[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(r.doc_id, ())))


def test_a_large_block_of_near_copies(spark):
    r = random.Random(5)
    base = ["b%d" % i for i in range(30)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(30)] = "x%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    assert {x.id: list(x.lines) for x in line_dedup.find(frame(spark, rows)).collect()} == brute(rows)


def test_edges(spark):
    assert line_dedup.report(frame(spark, [])).collect() == []
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "e d c b a")], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.report(df).collect()), key=str)
    assert got == sorted([(None, 1, 0, ""), (1, 1, 0, ""), (1, 1, 0, ""), (2, 1, 1, "0")], key=str)


def test_short_repeats_go(spark):
    rows = [(1, "Wh the end.\n\nLes.\n今日は良い天気ですね今日は良い天気ですね"), (2, "Les.\na b c d\n今日は良い天気ですね今日は良い天気ですね\nWh the end"), (3, "Wh the end.\n \na b c e\na b c d e f g h i j\nb a c d e f g h i k j\nd c b a x"), (None, "Les."), (4, None)]
    got = {r.id: list(r.lines) for r in line_dedup.find(frame(spark, rows)).collect()}
    assert got == {2: [0, 2], 3: [0, 4, 5]} == brute(rows)
    kept = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert kept[2] == "a b c d\nWh the end" and kept[3] == " \na b c e\na b c d e f g h i j" and kept[None] == "Les."


def test_clashing_names_and_long_texts(spark):
    long = "\n".join("w%d x%d y%d z%d v%d" % ((i % 7000,) * 5) for i in range(9000)) + "\n" + " ".join("q%d" % i for i in range(20000))
    df = spark.createDataFrame([(1, long, 3, [1], 4), (2, " ".join("q%d" % i for i in range(19999)), 3, [1], 4)], "doc_id long, text string, gone_id int, gone_lines array<int>, _gone_id int")
    kept = line_dedup.dedup(df)
    assert kept.columns == df.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got[1] == "\n".join([*long.split("\n")[:7000], long.split("\n")[-1]]) and got[2] == ""


def test_words_made_to_collide(spark):
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    rows = [(1, "k l m n " + a), (2, "k l m n " + a.translate({97: 98, 98: 97}))]
    assert line_dedup.find(frame(spark, rows)).collect() == [] and brute(rows) == {}


def test_runs_on_dataframe_functions_alone(spark, monkeypatch):
    plans = []
    written = line_dedup.written

    def kept(df, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, *rest)

    monkeypatch.setattr(line_dedup, "written", kept)
    line_dedup.report(frame(spark, corpus(3))).collect()
    assert plans and not any(re.search("MapInArrow|Python", p) for p in plans)


@pytest.mark.parametrize("percent", [51, 80, 95])
def test_runs_that_sets_send(spark, percent):
    """As many as `run_sizes` asks for."""
    import numpy as np

    sizes = [*range(1, 60), 500]
    sets = spark.createDataFrame([(n, [i * 7 + n for i in range(n)]) for n in sizes], "n int, w array<bigint>")
    got = {r.n: r.runs for r in sets.select("n", line_dedup.prefix_runs(percent, 5).alias("runs")).collect()}
    want = dict(zip(sizes, sum(x for _, x in line_dedup.run_sizes(percent, np.array(sizes))).tolist(), strict=True))
    assert {n: len(x) for n, x in got.items()} == want
    assert all(len(set(x)) == len(x) for x in got.values())


def test_long_and_short_sets_of_a_pair(spark):
    """Words parted by one space, or by more."""
    rows = []
    for i, n in enumerate((90, 97, 100, 110, 300, 340, 20, 24)):
        rows += [(3 * i, " ".join(f"a{i}x{j}" for j in range(n))), (3 * i + 1, "\t ".join(f"a{i}x{j}" for j in range(n * 9 // 10))), (3 * i + 2, " ".join(f"a{i}x{j}" for j in range(n * 7 // 10)))]
    got = {r.id: list(r.lines) for r in line_dedup.find(frame(spark, rows)).collect()}
    assert got == brute(rows) and len(got) >= 8


def test_frequent_long_words_bring_no_lines_together(spark):
    """Rare words come first, however short they are."""
    r = random.Random(9)
    rows = [(i, " ".join([f"frequentlongword{j}" for j in r.sample(range(10), 6)] + [f"{i:x}.{j}" for j in range(20)])) for i in range(600)]
    lines = line_dedup.profile(spark.createDataFrame(rows, "id long, t string"), 80)
    assert line_dedup.entries(lines).count() < 60


def test_words_of_all_documents_are_counted_for_the_order(spark):
    key, n = 12345, 32
    docs = spark.createDataFrame([(i, f"only{i} " * 200) for i in range(n)], "id long, t string")
    places = spark.createDataFrame([(f"only{i}",) for i in range(n)], "x string").select(line_dedup.bucket(key, "x").alias("b")).collect()
    found = line_dedup.levels(docs, key)
    assert len(found) == 1 << line_dedup.ORDER_BITS and all(found[r.b] >= 4 for r in places) and sum(map(bool, found)) == len({r.b for r in places})
