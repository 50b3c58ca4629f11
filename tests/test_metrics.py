"""Metrics of sentences: places of terms by a plain search, and whole rows by hand."""

import random
import re

import duckdb
import pytest

from corpusloom.operators import metrics, semantic


def plain(low, term):
    if " " in term:
        out, at = [], 0
        while (i := low.find(term, at)) >= 0:
            out.append(i)
            at = i + len(term)
        return out
    return [m.start() for m in re.finditer(rf"\b{re.escape(term)}\b", low)]


def test_places_match_a_plain_search(spark):
    r = random.Random(2)
    terms = ["a", "ab", "aba", "a b", "b a b", "c++", "été", "_x", "-", "b-a"]
    units = [(i, 0, "".join(r.choice(["a", "B", "ab", " ", " ", "-", "c++", "Été", "_x", "."]) for _ in range(40))) for i in range(60)] + [(99, 0, None), (98, 0, "")]
    got = metrics.matched(spark.createDataFrame(units, "doc_id long, nth int, sentence string"), spark.createDataFrame([(t.upper(),) for t in terms] + [("",)], "term string"))
    want = sorted((i, t, at, at + len(t)) for i, _, s in units for t in terms for at in plain((s or "").lower(), t))
    assert sorted((x.doc_id, x.term, x.start, x.end) for x in got.collect()) == want


def test_a_row_by_hand(spark):
    lexicon = spark.createDataFrame([("t", "proof", 2.0, "positive", "high"), ("s", "data", 1.0, None, None), ("c", "maybe", 1.0, "counter", None), ("c", "perhaps", None, None, None), ("c", "doubt", 1.0, None, None)], "collection string, term string, weight double, polarity string, danger string")
    specs = spark.createDataFrame([("m.boundary", "evidence", "proof", "term", "t"), ("m.boundary", "evidence", "proof", "support", "s"), ("m.boundary", "evidence", "proof", "counter", "c")], "metric string, family string, object string, role string, collection string")
    units = spark.createDataFrame([(1, 0, "Proof by proof, the data maybe perhaps leaves doubt"), (1, 1, "nothing here"), (1, 2, "data only")], "doc_id long, nth int, sentence string")
    (row,) = metrics.measured(units, lexicon, specs, spans=1).collect()
    assert (row.hits, row.weighted, row.terms, row.support, row.counter, row.boundary_support) == (2, 5.4, 1, 14.0, 48.0, 14.0)
    assert row.density == 600.0 and row.score == pytest.approx(0.35 * 64.8 + 20 + 2.8 + 15 - 9.6) and row.qualifier == "moderate"
    assert row.repair == metrics.REPAIRS[2] and row.symptom.endswith(metrics.PRESSURE) and row.route and row.confidence == 43.38 and row.severity == "low"
    assert [tuple(x) for x in row.spans] == [(0, 5, "proof", 2.7)]
    (doc,) = metrics.report(metrics.measured(units, lexicon, specs)).collect()
    assert (doc.n, doc.top, doc.deep_audit, doc.reasons) == (1, "m.boundary@0", True, row.symptom)


def test_signals_are_counted_without_overlaps_of_their_own(spark):
    docs = spark.createDataFrame([(1, "AAAA axiomatic axiom"), (2, None), (3, "")], "doc_id long, text string")
    signals = spark.createDataFrame([("aa", "G", 1.0), ("axiom", "G", 1.0), ("axiomatic", "K", 1.0), ("axiom", "K", 0.5), ("", "K", 1.0)], "signal string, var string, weight double")
    assert sorted(map(tuple, semantic.counted(docs, signals).collect())) == [(1, "aa", 2), (1, "axiom", 2), (1, "axiomatic", 1)]
    assert semantic.counted(docs, signals.limit(0)).count() == 0


def halfway(spark):
    """A blank file whose E is 3 and whose K is 1.275, a little less in binary; and its addresses."""
    files = spark.createDataFrame([(1, "p/n.x", "n", ".x", "")], "doc_id long, path string, stem string, ext string, text string")
    signals, priors = spark.createDataFrame([("zz", "G", 1.0)], "signal string, var string, weight double"), spark.createDataFrame([(".x", "K", 1.275)], "ext string, var string, weight double")
    return files, semantic.addresses(files, signals, priors)


def test_scores_are_rounded_as_sql_does(spark):
    ((want,),) = duckdb.sql("select round(1.275::double, 2)").fetchall()
    assert halfway(spark)[1].first().vector[semantic.VARS.index("K")] == want == 1.27


def test_records_have_scores_as_sql_rounds_them(spark):
    files, found = halfway(spark)
    rules = spark.createDataFrame([("domain", 1, "HIGH", 1.28), ("domain", 2, "LOW", None)], "axis string, priority int, output string, min_K double")
    (row,) = semantic.records(files, found, rules).collect()
    assert row.by_variable["K"] == 1.27 and row.meta == {"domain": "LOW"}
