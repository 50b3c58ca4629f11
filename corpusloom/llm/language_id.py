"""Language identification by fusing evidence with Bayes' rule.

Text: byte trigrams, hashed to a table of fixed size, whose counts by language come from all labelled texts. Their log
likelihoods are tempered, as trigrams depend on each other. Declared markup language and the hint of the address (a
language part of its path, else its country suffix): P(value | language) from counts over the corpus. Host: a prior
smoothed from suffix to domain to host, each level backing off to the one above, all by grouped sums of the text
posteriors, with the item's own share taken out.

Null and empty texts have no text evidence; null hosts, markup and addresses give none either. Without labels the
language is null. Repeated rows keep a row each. Empty tables give an empty result. Extra columns are dropped. Texts of
any length are read whole. Equal posteriors are resolved to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written
from ._words import LOWER, slices

BITS = 14
TEMPER, SMOOTH, BACK_OFF = 0.15, 0.5, 20.0
ITEM = "host string, domain string, suffix string, declared string, hint string"


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every trigram that lies in one text, and its text."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    key = ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    counts = np.maximum(0, np.diff(at) - 2)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + at[row]
    return key[place].astype(np.int64), row


def train(labelled: DataFrame, smooth: float = SMOOTH) -> tuple[list[str], np.ndarray]:
    """Languages of (text t, language lang), and their log probabilities of trigram buckets: 64 kB for each language of the labels."""
    langs = [r.lang for r in labelled.select("lang").where("lang is not null").distinct().orderBy("lang").collect()]
    code = {x: i for i, x in enumerate(langs)}
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(langs) * size, np.int64)
        for piece, w in slices(batches, "t"):
            key, row = trigrams(LOWER[w.data], w.text_at)
            lang = np.array([code.get(x, -1) for x in piece.column("lang").to_pylist()], np.int64)[row]
            np.add.at(counts, lang[lang >= 0] * size + key[lang >= 0], 1)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["at", "n"])

    table = np.full(len(langs) * size, smooth)
    if langs:
        sums = labelled.where("lang is not null").select("t", "lang").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        table[sums["at"].to_numpy(np.int64)] += sums["n"].to_numpy(np.float64)
    table = table.reshape(len(langs), size)
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if langs else table


def likelihoods(items: DataFrame, model: tuple[list[str], np.ndarray], temper: float = TEMPER) -> DataFrame:
    """The items' columns but t, and ll, the tempered log likelihood of t in each language."""
    shared = items.sparkSession.sparkContext.broadcast(model[1])
    rest = [f for f in items.schema.fields if f.name != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for piece, w in slices(batches, "t"):
            key, row = trigrams(LOWER[w.data], w.text_at)
            ll = np.zeros((len(piece), len(table)))
            for i, logs in enumerate(table):
                ll[:, i] = temper * np.bincount(row, logs[key], len(piece))
            column = pa.FixedSizeListArray.from_arrays(pa.array(ll.ravel()), len(table)).cast(pa.list_(pa.float64())) if len(table) else pa.array([[]] * len(piece), pa.list_(pa.float64()))
            yield pa.record_batch([*(piece.column(f.name) for f in rest), column], [*(f.name for f in rest), "ll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return items.mapInArrow(run, f"{schema}, ll array<double>")


def softmax(a: Column) -> Column:
    let = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    up = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return let(up, lambda u: let(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), lambda s: F.transform(u, lambda x: x / s)))


def fuse(scored: DataFrame, langs: list[str], back_off: float = BACK_OFF) -> DataFrame:
    """The scored items with lang and posterior; evidence tables are grouped sums of the text posteriors q."""
    k = len(langs)
    scored = written(scored.withColumn("q", softmax(F.col("ll"))), "scored")
    sums = lambda df, *by: df.groupBy(*by).agg(*(F.sum(F.get("q", F.lit(i))).alias(f"q{i}") for i in range(k))).select(*by, F.array(*(F.col(f"q{i}") for i in range(k))).alias("c"))
    add = lambda a, b, s=1.0: F.zip_with(a, b, lambda x, y: x + s * y)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    shrunk = lambda c, up: F.transform(F.zip_with(c, up, lambda x, y: F.greatest(x, F.lit(0.0)) + back_off * y), lambda x: x / (F.greatest(total(c), F.lit(0.0)) + back_off))
    every = sums(scored.withColumn("g", F.lit(1)), "g")
    base = every.select(F.transform("c", lambda x: (x + 1.0) / (total(F.col("c")) + k)).alias("p")).first()
    df = scored
    prior = F.array(*(F.lit(x) for x in (base.p if base else [1.0 / k] * k)))
    for level in ("suffix", "domain", "host"):
        df = df.join(sums(scored.where(f"{level} is not null"), level).withColumnRenamed("c", f"c_{level}"), level, "left")
        own = add(F.col(f"c_{level}"), F.col("q"), -1.0)
        df = df.withColumn(f"p_{level}", F.when(F.col(f"c_{level}").isNull(), prior).otherwise(shrunk(own, prior)))
        prior = F.col(f"p_{level}")
    score = add(F.col("ll"), F.transform(prior, lambda x: F.log(x)))
    for mark in ("declared", "hint"):
        marked = scored.where(f"{mark} is not null")
        of_all = sums(marked.withColumn("g", F.lit(1)), "g").select("c").first()
        n = of_all.c if of_all else [0.0] * k
        df = df.join(sums(marked, mark).withColumnRenamed("c", f"c_{mark}"), mark, "left")
        # a mark that names the language starts with the weight of back_off of its uses, others with 1
        start = F.array(*(F.when(F.col(mark) == x, F.lit(back_off)).otherwise(F.lit(1.0)) for x in langs))
        own = add(add(F.col(f"c_{mark}"), F.col("q"), -1.0), start)
        size = F.array(*(F.lit(x + back_off + 30.0) for x in n))
        evidence = F.zip_with(own, size, lambda x, y: F.log(F.greatest(x, F.lit(0.01)) / y))
        score = F.when(F.col(f"c_{mark}").isNull(), score).otherwise(add(score, evidence))
    df = df.withColumn("posterior", softmax(score))
    name = F.array(*(F.lit(x) for x in langs))
    best = F.array_position("posterior", F.array_max("posterior"))
    return df.withColumn("lang", F.element_at(name, best.cast("int"))).withColumn("p", F.array_max("posterior"))


def page_items(pages: DataFrame) -> DataFrame:
    """(page_id, t, host, domain, suffix, declared, hint) of web pages (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"&#?\w{1,8};", " ")
    found = lambda c, p: F.when(F.regexp_extract(c, p, 1) != "", F.lower(F.regexp_extract(c, p, 1)))
    host = found("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
    # the first part of the path that is a language, or a language and a region; parts are split, as a pattern over many parts recurses in Java
    parts = F.split(F.substring_index(F.regexp_extract("url", r"://[^/?#]+(/[^?#]*)", 1), "//", 1), "/")
    path = F.lower(F.substring(F.get(F.filter(parts, lambda x: x.rlike(r"^[A-Za-z]{2}([-_][A-Za-z]{2})?$")), F.lit(0)), 1, 2))
    suffix = F.substring_index(host, ".", -1)
    return pages.select(
        "page_id", text.alias("t"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), suffix.alias("suffix"),
        found(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b").alias("declared"), F.coalesce(path, F.when(F.length(suffix) == 2, suffix)).alias("hint"),
    )


def identify(docs: DataFrame, pages: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_id, lang, p): the language of every document and page, and its posterior probability.

    labelled (text, lang) trains the trigrams; by default the documents' own labels do. A document's source is its host.
    """
    model = train((labelled if labelled is not None else docs).select(F.col("text").alias("t"), F.col("lang")))
    none = lambda t: F.lit(None).cast(t)
    items = docs.select("doc_id", none("bigint").alias("page_id"), F.col("text").alias("t"), F.col("source").cast("string").alias("host"), *(none("string").alias(c) for c in ("domain", "suffix", "declared", "hint")))
    if pages is not None:
        items = items.unionByName(page_items(pages).withColumn("doc_id", none("bigint")))
    if not model[0]:
        return items.select("doc_id", "page_id", none("string").alias("lang"), none("double").alias("p"))
    return fuse(likelihoods(items, model), model[0]).select("doc_id", "page_id", "lang", F.round("p", 6).alias("p"))
