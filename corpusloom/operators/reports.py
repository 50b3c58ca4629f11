"""Reports: statistics, anomalies, exports, enforcement of labels, rotation, agreement, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statistics(files: DataFrame) -> DataFrame:
    """(root, n, bytes, duplicates, share, top): per source, with its most frequent extensions."""
    nth = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "ext"))
    exts = files.groupBy("root", "ext").agg(F.count("*").alias("n")).withColumn("nth", nth).where("nth <= 3")
    top = exts.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "ext", "n"))), lambda e: F.concat_ws("=", e["ext"], e["n"].cast("string"))), ",").alias("top"))
    s = files.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"), (F.count("*") - F.countDistinct("hash")).alias("duplicates"))
    return s.join(top, "root").select("root", "n", "bytes", "duplicates", F.round(F.col("duplicates") / F.col("n"), 6).alias("share"), "top")


def anomalies(groups: DataFrame, most: int = 3) -> DataFrame:
    """(root, kind, unit, n, nth): of each source and kind the `most` largest (a report's feature), largest first."""
    nth = F.row_number().over(Window.partitionBy("root", "kind").orderBy(F.desc("n"), "unit"))
    return groups.withColumn("nth", nth).where(F.col("nth") <= most)


def score_lines(scores: DataFrame) -> DataFrame:
    """(doc_id, block): scores as sorted `key: value` lines."""
    rows = F.array_sort(F.collect_list(F.struct("property", "level")))
    return scores.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws(": ", x["property"], x["level"].cast("string"))), "\n").alias("block"))


def review_queue(rows: DataFrame) -> DataFrame:
    """(nth, doc_id, note): a numbered queue per source, the least sure first."""
    w = Window.partitionBy("source").orderBy("confidence", "doc_id")
    return rows.select("source", F.row_number().over(w).alias("nth"), "doc_id", F.coalesce("notes", "reason", F.lit("")).alias("note"))


def exported(items: DataFrame, form: str) -> DataFrame:
    """(doc_id, line): items as json lines, plain text or markdown."""
    if form == "json":
        line = F.to_json(F.struct("doc_id", "folder", "body"))
    elif form == "markdown":
        line = F.concat(F.lit("## "), "folder", F.lit("\n\n"), "body", F.lit("\n\n---"))
    else:
        line = F.col("body")
    return items.select("doc_id", line.alias("line"))


def enforced(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, label, actions): the most restrictive of an object's labels, and all actions that any of them blocks.

    objects: (key, labels array); rules: (label, rank, blocks array).
    """
    each = objects.select("key", F.explode("labels").alias("label")).join(rules, "label")
    return each.groupBy("key").agg(F.max_by("label", F.struct("rank", "label")).alias("label"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))), ",").alias("actions"))


def accuracy(predictions: DataFrame, n: int) -> DataFrame:
    """(key, n, accuracy, trust): over the n latest resolved predictions of each key."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("resolved_at"), F.desc("seq")))
    s = predictions.where("correct is not null").withColumn("nth", nth).where(F.col("nth") <= n).groupBy("key").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    trust = F.when(F.col("n") < 20, "learning").when(F.col("accuracy") >= 0.9, "trusted").when(F.col("accuracy") >= 0.7, "assisting").otherwise("watching")
    return s.select("key", "n", F.round("accuracy", 6).alias("accuracy"), trust.alias("trust"))


def agreement(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, property, apart): properties that two scorers rate at least `least` apart; a missing rating is 0."""
    x, y = a.withColumnRenamed("level", "la"), b.withColumnRenamed("level", "lb")
    apart = F.abs(F.coalesce("la", F.lit(0)) - F.coalesce("lb", F.lit(0)))
    return x.join(y, ["doc_id", "property"], "full").select("doc_id", "property", apart.cast("int").alias("apart")).where(F.col("apart") >= least)


def uncovered(cells: DataFrame, outputs: DataFrame, key: list[str]) -> DataFrame:
    """Input keys that no output has."""
    return cells.select(*key).distinct().join(outputs.select(*key).distinct(), key, "left_anti")


def rotation(pages: DataFrame, done: DataFrame, kinds: list[str]) -> DataFrame:
    """(page, kind): the first kind, in order, that a page lacks; with none lacking, the one that is rarest overall."""
    order = F.posexplode(F.array(*map(F.lit, kinds)))
    every = pages.select("page").distinct().select("page", order.alias("nth", "kind"))
    counts = done.groupBy("kind").agg(F.count("*").alias("total"))
    have = done.select("page", "kind").distinct().withColumn("had", F.lit(True))
    df = every.join(have, ["page", "kind"], "left").join(F.broadcast(counts), "kind", "left")
    lacking = F.min_by(F.when(F.col("had").isNull(), F.col("kind")), F.when(F.col("had").isNull(), F.col("nth")))
    rare = F.min_by("kind", F.struct(F.coalesce("total", F.lit(0)), F.col("nth")))
    return df.groupBy("page").agg(F.coalesce(lacking, rare).alias("kind"))


def tree(folders: DataFrame) -> DataFrame:
    """(id, path, depth): folders (id, parent, name) under their parents, by a recursive query until a level is empty.

    The session's limits of depth and rows of recursive queries are lifted, so that no folder is left out.
    """
    for limit in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        folders.sparkSession.conf.set(limit, "-1")
    folders.createOrReplaceTempView("corpusloom_tree")
    return folders.sparkSession.sql(
        """with recursive t(id, path, depth) as (
        select id, name, 0 from corpusloom_tree where parent is null
        union all select f.id, concat(t.path, '/', f.name), t.depth + 1 from t join corpusloom_tree f on f.parent = t.id)
        select id, path, depth from t"""
    )


def gaps(scores: DataFrame, least: int) -> DataFrame:
    """(category, n): categories with fewer than `least` documents."""
    return scores.groupBy("category").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") < least)


def coverage_gaps(scores: DataFrame, evidence: DataFrame, least: int, sure: float, over: int = 20) -> DataFrame:
    """(kind, unit, n) of what a corpus lacks: `low_confidence` documents of each category, `thin_category` with fewer than `least` documents, and `claims_without_evidence`, documents that claim more than they show.

    scores: (doc_id, category, confidence); evidence: (doc_id, evidence, overclaim) from 0 to 100, as the stage of that
    name rates texts. Documents without a category are in none.
    """
    low = scores.where((F.col("confidence") < sure) & F.col("category").isNotNull()).groupBy("category").agg(F.countDistinct("doc_id").alias("n")).select(F.lit("low_confidence").alias("kind"), F.col("category").alias("unit"), "n")
    thin = gaps(scores.where("category is not null"), least).select(F.lit("thin_category").alias("kind"), F.col("category").alias("unit"), "n")
    bold = evidence.where(F.col("overclaim") > F.col("evidence") + over).select(F.lit("claims_without_evidence").alias("kind"), F.col("doc_id").cast("string").alias("unit"), (F.col("overclaim") - F.col("evidence")).cast("bigint").alias("n"))
    return low.unionByName(thin).unionByName(bold)
