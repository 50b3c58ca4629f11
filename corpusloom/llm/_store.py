"""Shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}/{name}"


#: The setting of the most rows in an Arrow batch, and that which deletes a query's shuffle files when it ends.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """df, computed once and reread from a table in the shared folder, which cuts its lineage.

    batch_rows bounds the Arrow batches of the job for rows that hold much. The job's shuffle files go when it ends;
    the session's settings are put back.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = {CLEAN: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path.rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], name: str) -> str:
    """The name, with as many marks in front as it takes to differ from all columns that are there."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name
