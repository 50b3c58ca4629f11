"""Records on small inputs."""

from corpusloom.operators import records


def test_sidecar_links(spark):
    rows = [(1, "a", "x", "x.md", ".md"), (2, "a", "x", "x.srt", ".srt"), (3, "a", "x", "x.json", ".json"), (4, "b", "x", "x.md", ".md"), (5, "a", "y", "y.srt", ".srt")]
    got = records.with_sidecars(spark.createDataFrame(rows, "doc_id long, dir string, stem string, name string, ext string"), [".srt", ".json"])
    assert {r.doc_id: r.sidecar_links for r in got.collect()} == {1: "x.json,x.srt", 4: None}


def test_fingerprints_of_odd_texts(spark):
    rows = [(1, None), (2, " \n"), (3, "Too short."), (4, "A sentence of some length. Another one of them follows.")]
    got = {r.doc_id: r for r in records.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].size for i in (1, 2, 3, 4)] == [None, 2, 10, 55]
    assert got[1].sha256 is got[1].plain_sha256 is got[2].plain_sha256 is got[3].first is None
    assert (got[4].first, got[4].last) == ("A sentence of some length.", "Another one of them follows.")
