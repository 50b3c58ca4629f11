import __spark_entry__
from corpusloom.plans import registry


def test_entry_and_names(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.QUERIES) <= set(queries)
    df = __spark_entry__.entry(spark)
    assert df.count() > 0


def test_results_do_not_depend_on_partitions(spark):
    from corpusloom.operators import diagnostics, inventory
    from corpusloom.sources import fixtures

    files = fixtures.files(spark, "/root/testdata/sf0.001")
    before = fixtures.files_before(files)
    for f in (lambda n: inventory.snapshot_diff(files.repartition(n), before.repartition(n)), lambda n: diagnostics.grade(diagnostics.scan(files.repartition(n), fixtures.dirs(files), 300, ["S", "N"]))):
        assert sorted(f(1).collect(), key=str) == sorted(f(8).collect(), key=str)


def test_moves_are_matched_one_to_one(spark):
    from corpusloom.operators import inventory

    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 2, 5), ("d", 3, 7)], "path string, hour int, size int")
    new = spark.createDataFrame([("x", 1, 10), ("c", 2, 6), ("d", 3, 7), ("y", 9, 9)], "path string, hour int, size int")
    got = sorted(map(tuple, inventory.snapshot_diff(new, old).collect()), key=str)
    assert got == sorted([("moved", "x", "a"), ("deleted", "b", None), ("modified", "c", None), ("created", "y", None)], key=str)


def test_topics_follow_the_sequential_rule(spark):
    import random

    from corpusloom.operators import conversations

    r = random.Random(4)
    rows = [(c, t, None if t == 0 else round(r.random(), 3)) for c in range(20) for t in range(r.randint(1, 15))]
    got = {(x.conv, x.turn): x.topic for x in conversations.topics(spark.createDataFrame(rows, "conv long, turn long, similarity double"), "conv", "turn", 0.35, 3).collect()}
    want, topic, size, last = {}, 0, 0, None
    for c, t, s in rows:
        if c != last:
            topic, size, last = 0, 0, c
        if s is not None and s < 0.35 and size >= 3:
            topic, size = topic + 1, 0
        size += 1
        want[c, t] = topic
    assert got == want


def test_nearest_fingerprints_are_all_found(spark):
    import random

    from corpusloom.operators import similarity

    r = random.Random(2)
    bits = ["".join(r.choice("01") for _ in range(64)) for _ in range(30)]
    for b in bits[:15]:
        x = list(b)
        for i in r.sample(range(64), r.randint(1, 5)):
            x[i] = "10"[int(x[i])]
        bits.append("".join(x))
    bits += bits[:3]
    got = {x.doc_id: (x.class_id, x.near) for x in similarity.near_fingerprints(spark.createDataFrame(list(enumerate(bits)), "doc_id long, simhash string")).collect()}
    apart = lambda a, b: sum(p != q for p, q in zip(a, b))
    assert got == {i: (bits.index(a), sum(0 < apart(a, b) <= 3 for b in set(bits))) for i, a in enumerate(bits)}
    assert any(n for _, n in got.values())
