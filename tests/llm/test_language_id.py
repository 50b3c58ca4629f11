import pytest

from corpusloom.llm import language_id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, docs):
    held = docs.where("doc_id % 5 = 0 and length(text) > 100")
    got = {r.doc_id: r.lang for r in language_id.identify(held, labelled=docs.where("doc_id % 5 <> 0")).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert len(got) == len(want) and sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_pages_follow_markup_and_address_where_text_is_silent(spark, docs):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").drop("x")
    odd = spark.createDataFrame([(9001, "https://a.example.de/de/1", '<html lang="de"><p></p></html>'), (9002, None, None), (9003, "not a url", "<p>"), (9003, "not a url", "<p>")], "page_id long, url string, html string")
    rows = language_id.identify(docs, pages.unionByName(odd)).collect()
    got = [(r.page_id, r.lang) for r in rows if r.page_id is not None]
    assert len(rows) == docs.count() + pages.count() + 4 and (9001, "de") in got and all(r.lang for r in rows)
    declared = {r.page_id: r.declared for r in language_id.page_items(pages).collect()}
    both = [(declared[i], x) for i, x in got if declared.get(i)]
    assert sum(a == b for a, b in both) >= 0.85 * len(both)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "en", None, 1), (2, "", None, "s", 1), (2, "", None, "s", 1)], "doc_id long, text string, lang string, source string, ll int")
    assert sorted((r.doc_id, r.lang) for r in language_id.identify(df).collect()) == [(1, "en"), (2, "en"), (2, "en")]
    assert language_id.identify(df.limit(0)).collect() == []
    assert [r.lang for r in language_id.identify(df.where("lang is null")).collect()] == [None, None]


def test_addresses_of_any_length(spark):
    urls = ["https://a.org/" + "abc/" * 30000 + "de/", "https://a.org/x/en-GB?q=fr", "https://a.org/FR", "https://a.org//de/", "https://a.org/deu/x", "https://a.es/", None, "https://a.org/x/it#de"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.hint for r in language_id.page_items(pages).collect()} == {0: "de", 1: "en", 2: "fr", 3: None, 4: None, 5: "es", 6: None, 7: "it"}
