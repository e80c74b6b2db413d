"""Intermediate tables in the cluster's shared folder: they cut lineage and outlive executors.

All tables of an application are below one folder, which ``clean`` removes when
no result of it is read any more; ``drop_written`` removes one earlier.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one of this machine serves a local session; a cluster needs the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def folder(spark: SparkSession) -> str:
    """Where this application's tables are."""
    return f"{root(spark)}/tidemark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows of df, from a table they were written to, with the writer's options. The write's shuffle files go when it ends."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a written() table that no later plan reads."""
    if path := getattr(df, "_tidemark_path", None):
        removed(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote. Results that still read them are lost."""
    removed(spark, folder(spark))
