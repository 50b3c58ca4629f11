"""Catalog rows: read tiers, priorities, health, tag rules, queues, discovery against prior state, sentence stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.text import occurrences

#: Extensions by read tier, a default of the parameter.
TIERS = {"text": [".md", ".txt", ".html", ".csv", ".json", ".yml", ".py", ".log"], "document": [".pdf", ".docx", ".xlsx"], "media": [".png", ".jpg"]}
# Phrases and terms of the three kinds of statement.
KINDS = {
    "what": (
        ["data shows", "study found", "measured at", "observed that", "according to", "rates increased", "percent of", "correlation between", "peer-reviewed", "sample size"],
        ["observed", "measured", "counted", "detected", "data", "evidence", "citation", "source", "reference", "percent", "ratio", "rate", "count", "documented", "reported"],
    ),
    "how": (
        ["works by", "mechanism is", "leads to", "follows from", "derived from", "results in", "defined as", "cohere when", "cost-bearing", "resolves through", "isomorphic to", "predicts that", "would falsify", "kill condition", "if and only if"],
        ["mechanism", "process", "structure", "model", "equation", "formula", "operator", "constraint", "derivation", "proof", "theorem", "axiom", "because", "causes", "produces", "algorithm", "pipeline", "conservation", "isomorphism", "falsifiable"],
    ),
    "why": (
        ["means that", "reveals that", "ultimately", "the purpose of", "god intended", "christ is", "the cross is", "spiritually", "theologically", "reality is grounded", "matters because", "kingdom of god", "moral order", "divine architecture"],
        ["meaning", "purpose", "significance", "sacred", "divine", "spiritual", "god", "christ", "jesus", "logos", "trinity", "grace", "sin", "salvation", "redemption", "moral", "ought", "should", "good", "evil", "holy", "destiny", "calling"],
    ),
}
#: Shares of a text without any of them: of a text as a whole, and of a single claim.
NONE_WHOLE, NONE_CLAIM = (33.3, 33.3, 33.3), (33.3, 33.3, 33.4)


def read_tier(files: DataFrame) -> DataFrame:
    """(doc_id, tier): how much of a file is read, by its extension."""
    tier = F.lit("metadata")
    for k, exts in TIERS.items():
        tier = F.when(F.col("ext").isin(exts), k).otherwise(tier)
    return files.select("doc_id", tier.alias("tier"))


def ranked(files: DataFrame, patterns: list[tuple[str, str]], weights: dict[str, int]) -> DataFrame:
    """(doc_id, classification, priority): the first pattern that the path matches, its weight, and more for large files."""
    kind = F.lit("other")
    for p, name in reversed(patterns):
        kind = F.when(F.lower("path").rlike(p), name).otherwise(kind)
    df = files.select("doc_id", "size", kind.alias("classification"))
    weight = F.lit(0)
    for k, w in weights.items():
        weight = F.when(F.col("classification") == k, w).otherwise(weight)
    return df.select("doc_id", "classification", (weight + F.when(F.col("size") > 5000, 2).when(F.col("size") > 500, 1).otherwise(0)).alias("priority"))


def health(checks: DataFrame, queue: DataFrame, busy: int) -> DataFrame:
    """(node, health): failing, degraded, busy or ok, from checks (node, ok) and queued items (node)."""
    c = checks.groupBy("node").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))
    q = queue.groupBy("node").agg(F.count("*").alias("queued"))
    state = F.when(F.col("good") == 0, "failing").when(F.col("good") < F.col("n"), "degraded").when(F.coalesce("queued", F.lit(0)) > busy, "busy").otherwise("ok")
    return c.join(q, "node", "left").select("node", state.alias("health"))


def normal_tags(items: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Items with trimmed, lower-cased, different tags in order; and those that have more than `most`."""
    df = items.withColumn("tags", F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    return df.where(F.size("tags") <= most), df.where(F.size("tags") > most)


def discovered(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, state): discovered or changed against the earlier state's size and hash."""
    old = before.groupBy("path").agg(F.max(F.struct("size", "hash")).alias("old"))
    new = now.groupBy("path").agg(F.max(F.struct("size", "hash")).alias("new"))
    state = F.when(F.col("old").isNull(), "discovered").when(F.col("old") != F.col("new"), "changed")
    return new.join(old, "path", "left").select("path", state.alias("state")).where("state is not null")


def next_items(queue: DataFrame, group: str) -> DataFrame:
    """(group, doc_id): the item of least priority number of each group, by id among equals."""
    return queue.groupBy(group).agg(F.min_by("doc_id", F.struct("priority", "doc_id")).alias("doc_id"))


def statement_kinds(docs: DataFrame, kinds: dict[str, tuple[list[str], list[str]]] | None = None, none: tuple[float, float, float] = NONE_WHOLE) -> DataFrame:
    """(doc_id, what, how, why, primary, mixed, margin, unscoped): shares in percent of phrases (2.5 each, wherever they are) and of whole words (1 each), each counted once.

    The first of equals is primary; below 60 percent it is mixed, below 45 unscoped.
    """
    kinds = kinds or KINDS
    rows = docs.select("doc_id", F.lower("text").alias("low")).withColumn("ws", F.expr(r"array_distinct(regexp_extract_all(low, r'[\p{L}\p{N}_]+', 0))"))
    raw = {k: sum((F.when(F.contains("low", F.lit(p)), 2.5).otherwise(0.0) for p in ps), F.lit(0.0)) + F.size(F.array_intersect("ws", F.array(*map(F.lit, ts)))) for k, (ps, ts) in kinds.items()}
    df = rows.select("doc_id", *(v.alias(f"r_{k}") for k, v in raw.items())).withColumn("total", sum((F.col(f"r_{k}") for k in kinds), F.lit(0.0)))
    df = df.select("doc_id", *(F.when(F.col("total") > 0, F.round(100 * F.col(f"r_{k}") / F.col("total"), 1)).otherwise(x).alias(k) for k, x in zip(kinds, none, strict=True)))
    order = F.sort_array(F.array(*kinds), asc=False)
    top = F.greatest(*kinds)
    primary = F.lit(list(kinds)[-1])
    for k in list(kinds)[-2::-1]:
        primary = F.when(F.col(k) == top, k).otherwise(primary)
    return df.select("doc_id", *kinds, primary.alias("primary"), (top < 60).alias("mixed"), F.round(F.get(order, F.lit(0)) - F.get(order, F.lit(1)), 1).alias("margin"), (top < 45).alias("unscoped"))


def sparse_sentences(sentences: DataFrame, every: int = 20) -> DataFrame:
    """(doc_id, n, first, last, picked): a document's first and last sentence, and each `every`-th one's start."""
    rows = F.array_sort(F.collect_list(F.struct("nth", F.substring("sentence", 1, 100).alias("s"))))
    picked = F.filter("a", lambda x: x["nth"] % every == every - 1)
    df = sentences.groupBy("doc_id").agg(rows.alias("a"))
    return df.select("doc_id", F.size("a").alias("n"), F.get("a", F.lit(0))["s"].alias("first"), F.element_at("a", -1)["s"].alias("last"), F.array_join(F.transform(picked, lambda x: F.substring(x["s"], 1, 80)), "|").alias("picked"))


def headings(docs: DataFrame, most: int = 100, width: int = 120) -> DataFrame:
    """(doc_id, n, headings): the first headings of a text, of up to three marks or of markup; only texts that have some."""
    s = F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c")))
    marked = F.filter(s, lambda x: x.rlike(r"^#{1,3}\s+\S") | x.rlike(r"(?i)^<h[1-3][^>]*>.*</h[1-3]>"))
    plain = F.transform(marked, lambda x: F.substring(F.trim(F.when(x.startswith("#"), F.regexp_replace(x, r"^#{1,3}\s+", "")).otherwise(F.regexp_replace(x, "<[^>]+>", ""))), 1, width))
    return docs.select("doc_id", F.slice(plain, 1, most).alias("headings")).where(F.size("headings") > 0).select("doc_id", F.size("headings").alias("n"), "headings")


def pair_assets(files: DataFrame, sidecars: list[str]) -> DataFrame:
    """(dir, stem, primaries, sidecars): files of one stem, with at least one of each kind."""
    side = F.col("ext").isin(sidecars)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("name")))), ",")
    return files.groupBy("dir", "stem").agg(names(~side).alias("primaries"), names(side).alias("sidecars")).where("primaries <> '' and sidecars <> ''")


def node_matches(docs: DataFrame, nodes: list[tuple[str, list[str]]], most: int = 30) -> DataFrame:
    """(node, doc_id, score, nth): of each keyword node its `most` best documents (a report's feature)."""
    low = F.lower("text")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("node"), sum((occurrences(low, w) for w in ws), F.lit(0)).cast("bigint").alias("score")) for n, ws in nodes)))
    df = docs.select("doc_id", each.alias("x")).select("x.node", "doc_id", "x.score").where("score > 0")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "doc_id"))
    return df.withColumn("nth", nth).where(F.col("nth") <= most)
