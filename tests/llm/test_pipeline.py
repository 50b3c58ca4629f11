"""The pipeline against the brute-force forms of its stages, one after the other."""

import hashlib
import random

import numpy as np
from test_line_dedup import brute as lines_brute
from test_ngram_join import brute as links_brute
from test_scans import brute_counts, brute_scan
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import line_dedup
from corpusloom.llm.queries import tokenizer


def documents():
    r = random.Random(11)
    word = lambda: "w%d" % r.randrange(4000)
    bench = [(1, " ".join("q%d" % i for i in range(30))), (2, "one two three")]
    base = [[word() for _ in range(r.choice([60, 90, 150]))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = list(r.choice(base)) if r.random() < 0.5 else [word() for _ in range(r.choice([20, 60, 120]))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.15:
            w[20:20] = bench[0][1].split()[3:15]
        if r.random() < 0.1:
            w[5:5] = ["One", "two,", "three"]
        cut = sorted(r.sample(range(len(w)), 3))
        rows.append((i, "\n".join(" ".join(w[a:b]) for a, b in zip([0, *cut], [*cut, len(w)]))))
    return [*rows, (60, None), (61, ""), (62, "a b " * 60)], bench


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, bench = documents()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    rows = [(i, t) for i, t in rows if not brute_counts(t)[5]]
    gone = lines_brute(rows)
    rows = [(i, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(i, ()))) for i, t in rows]
    kept = {i for i, n, c in links_brute(rows, 5, 80) if i == c}
    rows = [(i, t) for i, t in rows if i in kept]
    clean = {x[0] for x in brute_scan(rows, bench) if not x[5]}
    library = Tokenizer.from_file(tokenizer())
    want = []
    for i, t in rows:
        if i in clean:
            ids = library.encode(t, add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want) and 0 < len(want) < 60


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontaminate", "bpe"]


def test_quality_stage_uses_the_labels(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusloom.llm import quality_rules

    r = random.Random(7)
    words = lambda mark: " ".join("w%d%s" % (r.randrange(10**6), mark) for _ in range(60))
    rows = [(i, words("" if i < 2000 else "###"), "en") for i in range(2050)] + [(3000 + i, words("###"), "fr") for i in range(5)]
    spark.createDataFrame([(i, int(i < 2000)) for i in range(2050)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    assert quality_rules.least_labels(1, in_sequence=True) <= 2000 < quality_rules.least_labels(1)
    got = {x.doc_id for x in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert got == {*range(2000), *range(3000, 3005)}
    feats = quality_rules.features(docs)
    chosen = quality_rules.cutoffs(feats, labels, in_sequence=True)
    assert {(x.stratum, x.rule) for x in quality_rules.uncertified(feats, chosen).collect()} == {("fr", rule) for rule in quality_rules.RULES}
    # 1,000 good labels prove nothing at this risk
    few = labels.where(F.col("doc_id") < 1000)
    assert quality_rules.cutoffs(feats, few, in_sequence=True).count() == 0


def test_line_stage_drops_short_repeats(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three\n重複した行です"), (2, "重複した行です\none two three\nfour")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()}
    assert got == {1: "one two three\n重複した行です", 2: "four"}


def test_line_stage_counts_the_words_of_all_documents(spark, monkeypatch):
    seen, levels = [], line_dedup.levels
    monkeypatch.setattr(line_dedup, "levels", lambda docs, key: seen.append((key, levels(docs, key))) or seen[-1][1])
    corpus_pipeline.lines(spark, spark.createDataFrame([(i, f"only{i} other{i}") for i in range(24)], "doc_id long, text string"), "")
    ((key, found),) = seen
    words = spark.createDataFrame([(f"{w}{i}",) for i in range(24) for w in ("only", "other")], "x string")
    assert all(found[r.b] for r in words.select(line_dedup.bucket(key, "x").alias("b")).collect())
