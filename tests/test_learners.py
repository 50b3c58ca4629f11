import random

import pytest

from corpusloom.operators import learners


@pytest.mark.parametrize("learner", [learners.logistic, learners.boosted])
def test_held_out_accuracy(spark, learner):
    r = random.Random(3)
    rows = []
    for i in range(600):
        lang, ct = r.choice("ab"), r.choice("xyz")
        good = (lang == "a") != (r.random() < 0.05)
        rows.append((i, int(good), lang, ct))
    df = spark.createDataFrame(rows, "doc_id long, approved int, lang string, ct string")
    got = {x.doc_id: x.p for x in learner(df.where("doc_id < 400"), df.where("doc_id >= 400"), ["lang", "ct"]).collect()}
    assert sum((got[i] >= 0.5) == bool(a) for i, a, _, _ in rows if i >= 400) >= 180


def test_blend_and_cascade(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.55)], "doc_id long, p double")
    b = spark.createDataFrame([(1, 0.1), (2, 0.2)], "doc_id long, p double")
    assert {x.doc_id: round(x.p, 6) for x in learners.blend([(a, 3.0), (b, 1.0)]).collect()} == {1: 0.7, 2: 0.4625}
    assert {x.doc_id: round(x.p, 6) for x in learners.blend([(a, 3.0), (b, 1.0)], 0.2).collect()} == {1: 0.9, 2: 0.2}


def test_blocks_are_scored_by_earlier_ones_only(spark):
    r = random.Random(5)
    rows = [(i, int(r.random() < (0.8 if i % 3 else 0.3)), "k%d" % (i % 3), ["t%d" % (i % 2)], ["<S>", "k%d" % (i % 3), "<E>"], "l%d" % (i % 3), i // 40) for i in range(160)]
    schema = "doc_id long, approved int, key string, tags array<string>, steps array<string>, lang string, block int"
    every = learners.learners(["lang"])
    run = lambda data: {(x.learner, x.doc_id): x.p for x in learners.backtest(spark.createDataFrame(data, schema), every, 4).collect()}
    first = run(rows)
    assert {n for n, _ in first} == {"frequency", "markov", "logistic", "boosted", "blend"} and len(first) == 5 * 120
    turned = run([(i, a if b < 2 else 1 - a, *rest, b) for i, a, *rest, b in rows])
    assert all(first[k] == pytest.approx(turned[k]) for k in first if k[1] < 120) and any(first[k] != pytest.approx(turned[k]) for k in first if k[1] >= 120)


def test_a_first_block_of_one_class(spark):
    rows = [(i, 1, "k", ["t"], ["<S>", "k", "<E>"], "l", i // 5) for i in range(10)]
    got = learners.backtest(spark.createDataFrame(rows, "doc_id long, approved int, key string, tags array<string>, steps array<string>, lang string, block int"), learners.learners(["lang"]), 2)
    assert {x.p for x in got.collect()} == {1.0}
