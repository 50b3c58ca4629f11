"""Language identification against a plain version of its formulas."""

import math
import random

from corpusloom.llm import language_id as l


def brute(items, labelled):
    langs = sorted({g for _, g in labelled if g is not None})
    k, size = len(langs), 1 << l.BITS

    def keys(text):
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        return [(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - l.BITS) for i in range(len(b) - 2)]

    table = [[l.SMOOTH] * size for _ in langs]
    for text, g in labelled:
        if g is not None:
            for x in keys(text):
                table[langs.index(g)][x] += 1
    logs = [[math.log(x / sum(row)) for x in row] for row in table]
    softmax = lambda a: [math.exp(x - max(a)) / sum(math.exp(y - max(a)) for y in a) for x in a]
    for it in items:
        it["ll"] = [l.TEMPER * sum(row[x] for x in keys(it["t"])) for row in logs]
        it["q"] = softmax(it["ll"])
    total = [sum(it["q"][i] for it in items) for i in range(k)]
    base = [(x + 1) / (sum(total) + k) for x in total]
    by = lambda f, v: [sum(it["q"][i] for it in items if it[f] == v) for i in range(k)]
    out = []
    for it in items:
        prior = base
        for level in ("suffix", "domain", "host"):
            if it[level] is not None:
                own = [max(0.0, c - q) for c, q in zip(by(level, it[level]), it["q"])]
                prior = [(c + l.BACK_OFF * p) / (sum(own) + l.BACK_OFF) for c, p in zip(own, prior)]
        score = [a + math.log(p) for a, p in zip(it["ll"], prior)]
        for mark in ("declared", "hint"):
            if it[mark] is not None:
                n = [sum(x["q"][i] for x in items if x[mark] is not None) for i in range(k)]
                own = [c - q + (l.BACK_OFF if it[mark] == g else 1.0) for c, q, g in zip(by(mark, it[mark]), it["q"], langs)]
                score = [a + math.log(max(x, 0.01) / (m + l.BACK_OFF + 30.0)) for a, x, m in zip(score, own, n)]
        post = softmax(score)
        out.append((it["doc_id"], it["page_id"], langs[post.index(max(post))], round(max(post), 4)))
    return sorted(out, key=str)


def test_posteriors_match_the_plain_version(spark):
    r = random.Random(4)
    words = {"en": ["the", "thing", "was", "of"], "de": ["der", "sch", "und", "ein"], "x%d" % 7: ["zq", "qzz", "zzq"]}
    docs = []
    for i in range(40):
        g = r.choice(list(words))
        docs.append((i, " ".join(r.choice(words[g]) for _ in range(r.choice([0, 1, 3, 12]))), None if i % 9 == 0 else g, "host%d" % (i % 4)))
    docs += [(40, None, "en", None), (41, "THE Thing", None, "host1")]
    pages = [(i, "https://%s.example.%s/%s/a" % (r.choice("ab"), r.choice(["de", "com"]), r.choice(["de", "en", "news"])), '<html lang="%s"><p>%s</p></html>' % (r.choice(["de", "en-GB", "fr"]), " ".join(r.choice(words[r.choice(["en", "de"])]) for _ in range(8)))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    pf = spark.createDataFrame([*pages, (12, None, None)], "page_id long, url string, html string")
    items = [{"doc_id": i, "page_id": None, "t": t, "host": h, "domain": None, "suffix": None, "declared": None, "hint": None} for i, t, _, h in docs]
    items += [x.asDict() | {"doc_id": None} for x in l.page_items(pf).collect()]
    got = sorted(((x.doc_id, x.page_id, x.lang, round(x.p, 4)) for x in l.identify(df, pf).collect()), key=str)
    assert got == brute(items, [(t, g) for _, t, g, _ in docs])


def test_more_languages_than_a_byte_counts(spark):
    df = spark.createDataFrame([(i, "word%d " % i * 30, "l%03d" % i, None) for i in range(300)], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.lang for x in l.identify(df).collect()}
    assert sum(got[i] == "l%03d" % i for i in range(300)) > 200 and len(set(got.values())) > 200
