"""Readers of snapshots, registries, profiles, ledgers and hand-edited lists; and writers of ledgers, manifests and keyed tables.

Keyed tables are written as versions: a folder for each, of which the last complete one is current, so that a lost
executor or a failed job leaves the version before in place. A version that a batch of a stream wrote has the batch's
number in its name; a batch that is delivered again starts from the version before it and writes the same folder.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of a folder profile, and their defaults.
PROFILE = "name string, path string, role string, protected boolean, review_only boolean, threshold double"
DEFAULTS = {"role": "default", "protected": False, "review_only": False, "threshold": 0.98}


def snapshot(files: DataFrame) -> DataFrame:
    """(path, kind, size, sha1): a row for each file of an inventory with content, and for each folder above one."""
    one = files.select("path", F.lit("file").alias("kind"), "size", F.sha1("content").alias("sha1"))
    folder = F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
    dirs = files.select(folder.alias("path")).distinct().select("path", F.lit("dir").alias("kind"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("sha1"))
    return one.unionByName(dirs)


def text_of(content: Column) -> Column:
    """Text of bytes, with line ends made equal; what is not UTF-8 becomes the replacement character."""
    return F.replace(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def sampled(files: DataFrame, exts: list[str], most: int = 4096) -> DataFrame:
    """Adds `sample`: the first `most` characters of texts, empty for other files."""
    return files.withColumn("sample", F.when(F.lower("ext").isin(exts), F.substring(F.col("content").cast("string"), 1, most)).otherwise(""))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry or ledger of JSON lines; lines that don't fit the schema are refused."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Folder profiles of a JSON file {defaults, profiles}, nulls filled from its defaults, then DEFAULTS; and (profile, problem) of unknown keys."""
    raw = spark.read.option("multiLine", True).schema(f"defaults struct<{PROFILE.replace(' ', ': ').replace(',: ', ', ')}>, profiles array<struct<{PROFILE.replace(' ', ': ').replace(',: ', ', ')}>>").json(path)
    given = raw.select("defaults", F.explode("profiles").alias("p"))
    known = given.select("p.name", "p.path", *(F.coalesce(f"p.{c}", f"defaults.{c}", F.lit(v)).alias(c) for c, v in DEFAULTS.items()))
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.profiles"), "array<map<string,string>>")).alias("p"))
    names = [x.split()[0] for x in PROFILE.split(", ")]
    problems = text.select(F.col("p")["name"].alias("profile"), F.explode(F.map_keys("p")).alias("key")).where(~F.col("key").isin(names)).select("profile", F.concat(F.lit("unknown key "), "key").alias("problem"))
    return known, problems


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(name, approved, parts) of a hand-edited CSV file with NAME and APPROVE columns; blank answers are left out."""
    rows = spark.read.option("header", True).csv(path).select(F.trim("NAME").alias("name"), F.lower(F.trim("APPROVE")).alias("a")).where("a <> ''")
    return rows.select("name", F.col("a").isin("y", "yes", "1", "true", "x").cast("int").alias("approved"), F.split("name", "__").alias("parts"))


def imported(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Items with a body, with defaults for nulls, a content hash and whether the body was there before in this batch."""
    df = rows.where(F.trim(F.coalesce("body", F.lit(""))) != "")
    df = df.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns))
    return df.withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256))


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Adds rows to a ledger of JSON lines, in a folder for each value of `by`."""
    out = rows.write.mode("append")
    (out.partitionBy(by) if by else out).json(path)


def manifest(rows: DataFrame, key: list[str], path: str, most: int = 10_000) -> None:
    """Writes a row (key, part, rows) for each key and run of up to `most` of its rows, nested and in order.

    Rows are sorted over ranges and numbered there; a range's numbers go on from those of the key in the ranges before,
    so no key is numbered in one task, and parts depend on the rows alone. The numbered rows are kept in a table beside
    the manifest until it is written.
    """
    spark, rest = rows.sparkSession, [c for c in rows.columns if c not in key]
    own = f"{path}.{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(*key, *rest).withColumn("_range", F.spark_partition_id())
    ranged.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*rest))).write.parquet(own)
    numbered = spark.read.parquet(own)
    many = numbered.groupBy(*key, "_range").agg(F.max("_nth").alias("_many"))
    before = many.withColumn("_before", F.coalesce(F.sum("_many").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_many")
    before = before.toDF(*(f"_{c}" for c in [*key, "_range"]), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "_range"]]
    placed = numbered.join(before, same).select(*rows.columns, F.floor((F.col("_before") + F.col("_nth") - 1) / most).alias("part"))
    placed.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows")).write.mode("overwrite").json(path)
    remove(spark, own)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def versions(spark: SparkSession, path: str) -> list[tuple[int, int | None, str]]:
    """(number, batch, folder) of the complete versions of a keyed table, the oldest first; batch is null outside streams."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = [re.fullmatch(r"v(\d+)(?:-b(\d+))?", n) for n in names]
    return sorted((int(m[1]), int(m[2]) if m[2] else None, f"{path}/{m[0]}") for m in found if m)


def current(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame | None:
    """The last complete version; with before_batch, the last one that doesn't hold that batch of a stream or a later one."""
    found = [v for v in versions(spark, path) if before_batch is None or v[1] is None or v[1] < before_batch]
    return spark.read.parquet(found[-1][2]) if found else None


def replace(rows: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    """Writes rows as the next version of a table.

    A batch of a stream that is delivered again is written to the same folder as before, over what it left there.
    """
    spark = rows.sparkSession
    found = [v for v in versions(spark, path) if batch is None or v[1] is None or v[1] < batch]
    number = found[-1][0] + 1 if found else 0
    folder = f"{path}/v{number}" + ("" if batch is None else f"-b{batch}")
    rows.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def upsert(rows: DataFrame, key: list[str], path: str, order: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """Writes the next version of a keyed table: the new rows, and the old ones whose keys aren't among them.

    Of rows that repeat a key the one with the greatest `order` columns stays, the greatest in all columns among equals.
    """
    rest = [c for c in rows.columns if c not in key]
    first = order or []
    best = rows.groupBy(*key).agg(F.max(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(first)), *rest)).alias("_x")) if rest else rows.distinct()
    new = best.select(*key, *(F.col("_x")[c].alias(c) for c in rest)).select(*rows.columns) if rest else best
    old = current(rows.sparkSession, path, batch)
    return replace(new if old is None else new.unionByName(old.join(new.select(*key), key, "left_anti")), path, batch)
