import random
import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import phrases


def brute(rows, support, longest, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        inner = {q[i : i + k] for q, b in good.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 100 * good[q[i : i + k]]}
        best = []
        for p, a in good.items():
            if p not in inner:
                score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(best)[:most])]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["der", "Die", "das", "a", "B", "é", "日本"]) if r.random() < 0.7 else "w%d" % r.randrange(400)
    rows = []
    for i in range(150):
        text = "".join(word() + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!", " ", " "]) for _ in range(r.choice([0, 1, 5, 60])))
        rows.append((i if r.random() < 0.9 else None, text if r.random() < 0.95 else None, r.choice(["de", "de", "en", None, "und", ""])))
    rows += [(7, "New York New York new york", "en")] * 20 + [(None, "x y x y x y x", "zz")] * 5
    return rows


@pytest.mark.parametrize("seed,support,longest,most,shards", [(1, 6, 5, 2000, 8), (2, 20, 3, 7, 3), (3, 4, 2, 50, 1)])
def test_same_as_brute_force(spark, seed, support, longest, most, shards):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, 1, 1) for x in rows], "doc_id long, text string, lang string, n int, phrase int").repartition(3)
    got = phrases.collocations(docs, support, longest, most, shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, support, longest, most)


def test_a_long_text_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b. " * 60000 + "c" * 100000, "en")], "doc_id long, text string, lang string")
    assert [tuple(x) for x in phrases.collocations(docs).collect()] == [("en", 1, "a b", 60000, 60000, 60000, 120001, 2000)]
    assert phrases.collocations(docs.limit(0)).collect() == []
