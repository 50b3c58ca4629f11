"""Registries kept in many small JSON files: one row a key, with where it came from, over schemas that drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import folders, tables

#: The columns of a bucket of memories and what stands for those that a file lacks.
BUCKET = "bucket_id string, label string, owner string, visibility string, allowed_agents array<string>, vector_namespace string, requires_approval_to_share boolean"
BUCKET_DEFAULTS = {"owner": "operator", "visibility": "private", "allowed_agents": [], "requires_approval_to_share": True}


def read_all(spark: SparkSession, roots: list[str], name: str, schema: str, defaults: dict[str, object], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(schema.., path, changed_at) of every file of the name below the roots, nulls filled from defaults; and (file, problem) of what is wrong.

    Columns that a file lacks are null, columns that only some files have are reported as unknown, and files that are
    no JSON object or lack a required column are reported and left out. `path` is the file's folder. Files are listed by
    the data source of `folders`, as Spark's own readers pass over names that begin with an underscore.
    """
    files = folders.walk(spark, roots, exts=[folders.split_name(name)[1]], content="all").where(F.col("name") == name)
    raw = files.select(F.make_valid_utf8(F.col("content").cast("string")).alias("value"), F.col("path").alias("file"), F.col("mtime").alias("changed_at"))
    keys = F.json_object_keys("value")
    parsed = raw.withColumns({"x": F.from_json("value", schema), "keys": keys})
    known = [f.name for f in T._parse_datatype_string(schema).fields]
    is_object = F.col("keys").isNotNull() & F.col("x").isNotNull()
    lacking = [F.when(is_object & F.col(f"x.{c}").isNull(), F.lit(f"{c} is missing")) for c in required]
    unknown = F.transform(F.array_except("keys", F.array(*map(F.lit, known))), lambda k: F.concat(F.lit("unknown key "), k))
    problems = parsed.select("file", F.explode(F.concat(F.array_compact(F.array(F.when(~is_object, F.lit("no JSON object")), *lacking)), F.coalesce(unknown, F.array().cast("array<string>")))).alias("problem"))
    good = is_object
    for c in required:
        good = good & F.col(f"x.{c}").isNotNull()
    value = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(defaults[c]) if not isinstance(defaults[c], list) else F.array(*map(F.lit, defaults[c])).cast("array<string>")) if c in defaults else F.col(f"x.{c}")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return parsed.where(good).select(*(value(c).alias(c) for c in known), folder.alias("path"), "changed_at"), problems


def indexed(spark: SparkSession, roots: list[str], path: str, name: str = "_bucket.json") -> tuple[DataFrame, DataFrame]:
    """The keyed table of buckets after a run over the files below the roots, and the files' problems; of files that repeat a bucket the last changed counts."""
    rows, problems = read_all(spark, roots, name, BUCKET, BUCKET_DEFAULTS, ["bucket_id", "label"])
    return tables.upsert(rows, ["bucket_id"], path, order=["changed_at", "path"]), problems


def with_access(entries: DataFrame, category: str, access: str) -> DataFrame:
    """The capability registry (category, access, ..) after a category's access is set; a category that isn't there changes nothing."""
    return entries.withColumn("access", F.when(F.col("category") == category, F.lit(access)).otherwise(F.col("access")))


def access_of(asked: DataFrame, entries: DataFrame, other: str = "uncategorized") -> DataFrame:
    """Rows with a category, and the access of its entry; that of `other` where the category has none."""
    own, rest = entries.select("category", "access"), entries.where(F.col("category") == other).agg(F.max("access").alias("_other"))
    return asked.join(own, "category", "left").crossJoin(F.broadcast(rest)).withColumn("access", F.coalesce("access", "_other")).drop("_other")
