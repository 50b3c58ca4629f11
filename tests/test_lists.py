"""Fixed lists against literals, and operators that SQL can't express against plain versions."""

import difflib
import hashlib
import re

import numpy as np

from corpusloom.operators import classify, conversations, diagnostics, folders, text


def test_fixed_lists():
    assert classify.RISKY == [".exe", ".dll", ".sh", ".bat", ".cmd", ".ps1"] and classify.SURE == 0.98
    assert [len(x) for x in (conversations.CUT, conversations.KEEP, conversations.CORRECTION)] == [10, 6, 5]
    assert len(diagnostics.KNOWN) == len(set(diagnostics.KNOWN)) == 71 and {".md", ".gitignore", ".woff2", ".fisdead"} <= set(diagnostics.KNOWN)
    assert diagnostics.WEIGHTS == {"low": 1, "medium": 3, "high": 8, "critical": 20} and len(diagnostics.SEVERITY) == 37
    assert folders.WEIGHTS == {"F": 2, "N": 3, "E": 1, "C": 3, "H": 5, "T": 1, "P": 2, "Role": 1}


def test_lines_that_are_kept_cut_or_logged(spark):
    lines = ["That's a great question", "hi!", "Thanks for sharing the lemma", "I was wrong about it", "Wait, but that's not so", "it was replaced by x", "Glad you asked about χ", "plain words here", "Absolutely!", "verse of the day, thanks for sharing"]
    got = conversations.line_verdicts(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).orderBy("nth").collect()
    assert [r.verdict for r in got] == ["cut", "cut", "kept", "correction", "correction", "correction", "kept", "kept", "cut", "kept"]


def test_name_ratio(spark):
    pairs = [("report_v1", "report_v2"), ("a", "b"), ("", ""), ("report_v1", "report_v2")]
    got = folders.name_ratio(spark.createDataFrame(pairs, "a string, b string"))
    assert sorted(map(tuple, got.collect())) == sorted((x, y, difflib.SequenceMatcher(None, x, y).ratio()) for x, y in pairs)


def test_plans(spark):
    found = spark.createDataFrame([("r", "N01", "u1"), ("r", "N01", "u2"), ("r", "I04", "u1"), ("q", "T01", "u")], "root string, symptom string, unit string")
    got = {r.root: (r.symptoms, r.plan) for r in folders.plans(found, [("I04", "resolve"), ("C05", "sort"), ("N01", "name")]).collect()}
    assert got == {"r": ("I04=1,N01=2", "back up; resolve; name"), "q": ("T01=1", "back up")}


def test_merged_topics(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, conversations.DIMENSIONS))
    rows = [(c, t, int(t // 2), (base[rng.integers(0, 4)] + rng.normal(size=conversations.DIMENSIONS) * 0.3).tolist()) for c in range(3) for t in range(16)]
    got = conversations.merge_topics(spark.createDataFrame(rows, "conv_id long, turn int, topic int, embedding array<double>"), "conv_id", "turn")
    want = set()
    for c in range(3):
        means = [np.mean([e for x, _, k, e in rows if x == c and k == t], axis=0) for t in range(8)]
        target = list(range(8))
        for i in range(8):
            for j in range(i + 1, 8):
                if target[j] == j and means[i] @ means[j] / np.linalg.norm(means[i]) / np.linalg.norm(means[j]) > 0.75:
                    target[j] = i
        want |= {(c, t, target[t]) for t in range(8)}
    assert {tuple(r) for r in got.collect()} == want


def test_simhash_sums_votes_before_they_travel(spark):
    docs = [(1, "the cat and the hat, THE end"), (2, "a b"), (3, None), (4, "cat cat dog"), (4, "dog owl")]
    got = text.simhash(spark.createDataFrame(docs, "doc_id long, text string"))
    want = {}
    for i in (1, 4):
        words = re.findall("[a-z0-9_]{3,}", " ".join(x for d, x in docs if d == i).lower())
        bits = [int(hashlib.md5(w.encode()).hexdigest()[16:], 16) for w in words]
        want[i] = "".join("1" if sum(1 if b >> (63 - k) & 1 else -1 for b in bits) > 0 else "0" for k in range(64))
    assert {r.doc_id: r.simhash for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1  # one row a document, no words
