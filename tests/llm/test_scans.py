import hashlib
import math
import random
import re

import pytest

from corpusloom.llm import decontaminate, quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], "doc_id long, text string, lang string, spans string, t string")


# secrets

KEY = "AKIA" + "ABCDEFGH12345678"
SECRET_ROWS = [
    (1, None), (2, ""), (3, 'password = "hunter22x"; PassWord:abc; api_key: \'Zz9/Zz9+Zz9=\''), (4, f"x {KEY} {KEY[:12]} {'0a' * 12} {'0a' * 11}"),
    (5, "\U0001f642 tokenToken=abcdef123 secretſ=aaaaaaaaa Kapikey=bbbbbbbb"), (6, ("deadbeef" * 3 + " ") * 3 + "apikey:" + "b" * 5), (6, "secret:secret:abcdefg"), (7, "token=token=abcdef" * 50),
]


def brute_base(t):
    t = t or ""
    a = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    b = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return a, b, c


def test_secret_base_spans(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = SECRET_ROWS + [(100 + i, t) for i, t in docs]
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.digests(frame(spark, rows)).collect())
    want = []
    for i, t in rows:
        a, b, c = brute_base(t)
        every = sorted(a + b + c, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        want.append((i, len(a), len(b), len(c), hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in every).encode()).hexdigest()))
    assert got == sorted(want)
    assert secret_scan.digests(frame(spark, [])).collect() == []


@pytest.mark.parametrize("text,literal", [
    ('db_password = "s3cr3t-Value9"', "s3cr3t-Value9"), ("  client_secret: Ab3dEf9hIjKlMn0p", "Ab3dEf9hIjKlMn0p"), ('{"privateKey": "q8Zr!2mVx0Lp"}', "q8Zr!2mVx0Lp"),
    ('a = "Zx81kQ9w"\nauth_token = a', "a"), ('session_token = "Qw3r" + "Ty7uIo9p"', 'Qw3r" + "Ty7uIo9p'), ("<x accessKey='R2d2C3poBb8x'/>", "R2d2C3poBb8x"), ('a := "x"\nsigning_key := "hT6yU8iO0pL2"', "hT6yU8iO0pL2"),
])
def test_literals_of_sensitive_names(text, literal):
    spans = secret_scan.literal_spans(text)
    assert [text[a:b] for _, a, b in spans] == [literal]


@pytest.mark.parametrize("text", ['colour = "s3cr3t-Value9"', 'password = "changeme"', 'password: ${DB_PASSWORD}', "the key: it was here and that is all", "http://token.example.com/abcdef123456", 'token = ""'])
def test_no_literals(text):
    assert secret_scan.literal_spans(text) == []


# decontamination

ITEM = "Alpha beta, gamma-delta 42 épsilon zeta ETA theta iota kappa lambda mu"
BENCH = [(1, ITEM), (2, "short Item"), (3, None), (4, "..."), (10, "Short item"), (None, "nobody knows"), (2, "short Item")]
DOCS = [(1, "x " + ITEM.upper().replace("É", "é") + " y"), (2, "a short--ITEM and SHORT item"), (3, None), (4, ""), (5, "alpha beta gamma"), (5, "nobody KNOWS him"), (6, "shortitem short"), (7, (ITEM + " ") * 40), (8, "short item " * 2000)]


def brute_scan(docs, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in bench:
        w = low(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    for i, t in docs:
        w = low(t)
        hit, items = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit[s : s + n] = [True] * n
                    items |= windows[tuple(w[s : s + n])]
        names = sorted(str(x) for x in items if x is not None)
        yield i, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_decontamination_matches_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate.scan, "__defaults__", (*decontaminate.scan.__defaults__[:-1], most))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.digests(frame(spark, DOCS), bench).collect()))
    assert got == sorted(brute_scan(DOCS, BENCH))


def test_decontamination_edges(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert [r.n_hit for r in decontaminate.digests(frame(spark, DOCS), bench.limit(0)).collect()] == [0] * len(DOCS)
    assert decontaminate.digests(frame(spark, []), bench).collect() == []
    spans = {r.doc_id: r.spans for r in decontaminate.scan(frame(spark, DOCS), bench).collect()}
    text = dict(DOCS)[1]
    assert [text[s.start : s.end] for s in spans[1]] == [text[2:-2]]
    clean = decontaminate.decontaminate(frame(spark, DOCS), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 6] and clean.columns == frame(spark, []).columns


# quality rules

def brute_counts(t):
    w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    seen, hit = {}, [False] * len(w)
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        for p in places if len(places) > 1 else ():
            hit[p : p + 3] = [True] * 3
    n, r = len(w), sum(hit)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_quality_counts(spark):
    r = random.Random(5)
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a a a a a a"), (5, "x\n\nx\n \nx y\x0bz\x1c\nx"), (5, "é# ü*é# ü*é#"), (6, "\n" * 50), (7, "p q " * 4000)]
    rows += [(10 + i, " ".join(r.choice("abcdefgh"[: r.randint(2, 8)]) for _ in range(r.randint(0, 200)))) for i in range(80)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(tuple(x)[:7] for x in quality_rules.judge(frame(spark, rows), labels).drop("failed_rules").collect())
    assert got == sorted((i, *brute_counts(t)) for i, t in rows)
    assert quality_rules.judge(frame(spark, []), labels).collect() == []


@pytest.mark.parametrize("k,n,p", [(0, 0, 0.1), (0, 10, 0.1), (3, 100, 0.1), (9, 100, 0.1), (10, 100, 0.1), (0, 5000, 0.01), (20, 5000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p)).first()[0]
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_reject_few_good_documents(spark):
    r = random.Random(2)
    words = lambda n, mark: " ".join("w%d%s" % (r.randrange(10**6), mark if r.random() < 0.5 else "") for _ in range(n))
    rows = [(i, words(60, "")) for i in range(3000)] + [(3000 + i, words(60, "###")) for i in range(300)]
    labels = spark.createDataFrame([(i, 1 if i < 3000 else 0) for i in range(3300)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality_rules.judge(frame(spark, rows), labels).collect()}
    assert sum(not got[i] for i in range(3000)) <= 30 and not any(got[i] for i in range(3000, 3300))
    kept = quality_rules.keep(frame(spark, rows), labels)
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(got.values())


def test_constants_doubled_line_by_line():
    lines = ["x0 = 'aB3$kdLq'"] + [f"x{i} = x{i - 1} + x{i - 1}" for i in range(1, 2000)] + ["secret_token = x1999", "password = x9", "password = 'xxxx' + 'xxxx'", "zs = 'x' + 'x'", *[f"z{i} = z{i - 1} + z{i - 1}" for i in range(1, 1)]]
    text = "\n".join(lines)
    found = [text[a:b] for _, a, b in secret_scan.literal_spans(text)]
    assert found == ["x1999", "x9"]
    short, long = secret_scan.join("aB3$kdLq", "aB3$kdLq"), "aB3$kdLq"
    for _ in range(9):
        long = secret_scan.join(long, long)
    assert isinstance(long, secret_scan.Long) and len(long) == 8 * 512
    assert secret_scan.literal_score(long) == secret_scan.literal_score("aB3$kdLq" * 512) and secret_scan.literal_score(short) > 0
    runs = secret_scan.join("x" * 200, "x" * 200)
    assert secret_scan.literal_score(runs) == 0 and secret_scan.literal_score(secret_scan.join(runs, "1aB")) > 0
    assert secret_scan.literal_score(secret_scan.join("your-" + "k" * 300, "1")) == 0 == secret_scan.literal_score(secret_scan.join("<" + "k" * 300, ">"))
