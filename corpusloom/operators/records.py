"""Records: links beside files, fingerprints, counts of an index, observations, and which items to ask about next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import text
from corpusloom.operators.catalog import pair_assets, sparse_sentences
from corpusloom.operators.diagnostics import LINK

#: A name's last extension; names that begin with their only dot have none.
SUFFIX = r"^.+(\.[^.]+)$"
_name = lambda path: F.substring_index(path, "/", -1)
_parent = lambda path: F.regexp_replace(path, r"/?[^/]*$", "")


def with_sidecars(files: DataFrame, sidecars: list[str]) -> DataFrame:
    """The primary files with `sidecar_links`: the names of their sidecars in the same folder, null without any."""
    pairs = pair_assets(files, sidecars).select("dir", "stem", F.col("sidecars").alias("sidecar_links"))
    return files.where(~F.col("ext").isin(sidecars)).join(pairs, ["dir", "stem"], "left")


def doubted(claims: DataFrame) -> DataFrame:
    """Adds `doubt`: the kind that the shares (percent) of tagged words speak for, where they speak against `primary`; else null."""
    noun, verb, adjective = (F.coalesce(c, F.lit(0)) for c in ("noun", "verb", "adjective"))
    heavy = (F.col("primary") == "WHY") & (adjective < 5) & (noun > 40) | (F.col("primary") == "HOW") & (verb < 5) & (noun > 45)
    return claims.withColumn("doubt", F.when(heavy, "WHAT").when((F.col("primary") == "WHAT") & (adjective > 20) & (noun < 25), "WHY"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sha256, plain_sha256, size, root, n_sections, first, last): hashes of the text and of its lower-cased words, its tree of sections, its sparse anchors.

    doc_id is a key. Parts that a text doesn't have (no words, no sentences) are null.
    """
    plain = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    own = docs.select("doc_id", sha(F.col("text")).alias("sha256"), F.when(plain != "", sha(plain)).alias("plain_sha256"), F.octet_length("text").cast("bigint").alias("size"))
    tree = text.section_hashes(docs).groupBy("doc_id").agg(F.max(F.when(F.col("level") == 0, F.col("hash"))).alias("root"), F.count_if(F.col("level") == 1).alias("n_sections"))
    anchors = sparse_sentences(text.sentences(docs)).select("doc_id", "first", "last")
    return own.join(tree, "doc_id", "left").join(anchors, "doc_id", "left")


def index_statistics(pages: DataFrame, explorations: DataFrame, queue: DataFrame) -> DataFrame:
    """(statistic, n): pages, unexplored pages, explorations, queue length, and pages of each classification."""
    counts = pages.groupBy("classification").agg(F.count("*").alias("n"), F.count_if(F.col("exploration_count") == 0).alias("new"))
    total = lambda df, name, c: df.agg(F.coalesce(c, F.lit(0)).cast("bigint").alias("n")).select(F.lit(name).alias("statistic"), "n")
    classes = counts.where("classification is not null").select(F.concat(F.lit("class:"), "classification").alias("statistic"), F.col("n").cast("bigint"))
    parts = [total(counts, "unexplored", F.sum("new")), total(explorations, "explorations", F.count("*")), total(queue, "queue", F.count("*")), classes]
    out = total(counts, "pages", F.sum("n"))
    for part in parts:
        out = out.unionByName(part)
    return out


def observed(events: DataFrame) -> DataFrame:
    """Adds file_name, extension, source_folder, dest_folder, hour and weekday (Monday is 0) to events, streams too; (event_id, action, path, destination, ts)."""
    return events.withColumns({
        "file_name": _name("path"), "extension": F.lower(F.regexp_extract(_name("path"), SUFFIX, 1)), "source_folder": _parent("path"),
        "dest_folder": _parent("destination"), "hour": F.hour("ts"), "weekday": F.weekday("ts"),
    })


def links(docs: DataFrame, column: str = "text", pattern: str = LINK) -> DataFrame:
    """(doc_id, nth, link): every link of a text, in order."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("nth", "link"))


def questions(items: DataFrame, most: int = 100) -> DataFrame:
    """(doc_id, score): the `most` items whose decision would teach most (a report's feature), the best first, by id among equals.

    An item has the probability of approval, the answers of several judges, a cluster, a risk from 0 to 1 and whether it
    was asked. The score adds uncertainty, disagreement of the judges, the cluster's size against the largest one's, risk
    and the share of the cluster that is still open, and takes off the share that was asked. Asked items aren't returned.
    Clusters are counted and joined back, so none is gathered.
    """
    clusters = items.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("asked").alias("n_asked"))
    largest = clusters.agg(F.max("n").alias("largest"))
    df = items.where(~F.col("asked")).join(clusters, "cluster").join(F.broadcast(largest))  # one row
    share: Column = F.col("n_asked") / F.col("n")
    uncertain, apart = 1 - F.abs(2 * F.col("p") - 1), (F.size(F.array_distinct("answers")) - 1) / F.greatest(F.size("answers") - 1, F.lit(1))
    score = uncertain + apart + F.col("n") / F.col("largest") + F.col("risk") + (1 - share) - share
    return df.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)


def catalog(files: DataFrame, texts: list[str], stop: list[str], most: int = 3, sample: int = 4096, quick: int = 65536) -> DataFrame:
    """(doc_id, path, name, ext, size, md5, modified, tier, tags, status) of files (doc_id, path, name, ext, size, modified, bytes).

    Texts, by extension, are `text`, others `blob`. The quick hash takes the size and the first and last `quick` bytes,
    the last ones only of a file of more than twice as many. Tags are the most frequent words of three letters and more
    of a text's first bytes, or of the name where there are none; `untagged` without any.
    """
    ext = F.lower("ext")
    tier = F.when(ext.isin(texts), "text").otherwise("blob")
    raw = F.coalesce("bytes", F.lit(b""))
    n = F.length(raw)
    tail = F.when(n > 2 * quick, F.substring(raw, n - quick + 1, F.lit(quick))).otherwise(F.lit(b""))
    md5 = F.md5(F.concat(n.cast("string").cast("binary"), F.substring(raw, 1, quick), tail))
    head = F.when(tier == "text", F.lower(F.decode(F.substring(raw, 1, sample), "ISO-8859-1"))).otherwise("")
    word = "[a-z]{3,}"
    source = F.when(head.rlike(word), head).otherwise(F.lower("name"))
    words = files.select("doc_id", F.explode(F.regexp_extract_all(source, F.lit(word), 0)).alias("w")).where(~F.col("w").isin(stop)).groupBy("doc_id", "w").count()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "w"))
    tags = words.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "w"))), lambda x: x["w"]), ", ").alias("tags"))
    df = files.select("doc_id", "path", "name", ext.alias("ext"), "size", md5.alias("md5"), "modified", tier.alias("tier")).join(tags, "doc_id", "left")
    return df.withColumns({"tags": F.coalesce("tags", F.lit("untagged")), "status": F.lit("active")})
