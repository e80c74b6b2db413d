"""Numbered folders that count once Spark has marked them as whole: what readers of a growing table follow."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def names(spark: SparkSession, path: str) -> dict[str, bool]:
    """Folders below a path, and whether Spark has marked each as whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    whole = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return {s.getPath().getName(): whole(s) for s in fs.listStatus(at) if s.isDirectory()}


def numbers(spark: SparkSession, path: str) -> dict[int, bool]:
    return {int(m[1]): whole for name, whole in names(spark, path).items() if (m := re.fullmatch(r"number=(\d+)", name))}


def head(spark: SparkSession, path: str) -> int:
    """The number of the last whole commit of a table, 0 before the first."""
    return max((n for n, whole in numbers(spark, f"{path}/log").items() if whole), default=0)


def following(spark: SparkSession, path: str) -> int:
    """The number of the next commit: none that an unfinished one has used."""
    return max(numbers(spark, f"{path}/log"), default=0) + 1
