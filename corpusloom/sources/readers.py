"""Readers: inventories of files, texts out of markup, front matter, merged lexicons and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named entities that are resolved.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def inventory(spark: SparkSession, roots: list[str], glob: str | None = None, least: int = 0, most: int | None = None, content: bool = True) -> DataFrame:
    """(path, root, name, ext, size, mtime, depth, content) of the files below the roots, in any store Spark reads.

    Content is read only if a later step uses it. Names that begin with a dot or an underscore are hidden from readers of Spark.
    """
    out = None
    for root in roots:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        df = (reader.option("pathGlobFilter", glob) if glob else reader).load(root).withColumn("root", F.lit(root))
        out = df if out is None else out.unionByName(df)
    out = out.where(F.col("length") >= least)
    if most is not None:
        out = out.where(F.col("length") <= most)
    name = F.substring_index("path", "/", -1)
    cols = [F.col("path"), F.col("root"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), (F.size(F.split("path", "/")) - 1).alias("depth")]
    return out.select(*cols, *([F.col("content")] if content else []))


def plain_text(html: Column, limit: int | None = None) -> Column:
    """Text of markup: scripts and styles dropped, blocks ended by line ends, tags dropped, entities resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|section|article|li|h[1-6]|tr)>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for k, v in ENTITIES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))
    return t if limit is None else F.substring(t, 1, limit)


def front_matter(text: Column) -> Column:
    """A map of the `key: value` lines between the leading --- lines; null without them."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return F.when(text.rlike(r"(?s)\A---\n.*?\n---(?:\n|\z)"), F.map_from_entries(pairs))


def body(text: Column) -> Column:
    """The text behind its front matter."""
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")


def platform(text: Column, marks: list[tuple[str, str]]) -> Column:
    """The first platform (mark, name) whose mark is in the text; unknown else."""
    out = F.lit("unknown")
    for mark, name in reversed(marks):
        out = F.when(F.contains(F.lower(text), F.lit(mark)), name).otherwise(out)
    return out


def merged_lexicon(seed: DataFrame, user: DataFrame, key: list[str], defaults: dict[str, object]) -> DataFrame:
    """The user's rows, the seed's where the user has none of the key; nulls take the defaults."""
    both = user.unionByName(seed.join(user.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return both.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in both.columns))


def admitted(files: DataFrame, skip_dirs: list[str], exts: list[str], most: int) -> DataFrame:
    """(doc_id, reason): why a file isn't taken; null if it is."""
    reason = F.when(F.arrays_overlap(F.split("dir", "/"), F.array(*map(F.lit, skip_dirs))), "directory").when(F.col("name").startswith("."), "hidden").when(~F.col("ext").isin(exts), "extension").when(F.col("size") > most, "size")
    return files.select("doc_id", reason.alias("reason"))
